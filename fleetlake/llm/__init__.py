"""Operations of a training-data pipeline over a table of texts.

Nothing outside this package imports it.  Texts are handled whole; inside a
task they are scanned as Arrow buffers with numpy (``textcore``).  Every
operator takes and returns DataFrames; ``catalogue`` registers its queries.
"""
