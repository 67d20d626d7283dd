import datetime as dt

import pytest
from pyspark.sql import types as T

LONG = "\n".join(f"line {k} of a very long text, word {k % 97} and word{k % 1013} again." for k in range(20000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box up every jug of liquid"

#: documents with every odd case, and extra columns named like results.
ODD_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType()),
    T.StructField("n_words", T.LongType()), T.StructField("items", T.StringType()),
    T.StructField("kept", T.StringType()), T.StructField("n_dropped", T.StringType()),
    T.StructField("row", T.StringType()), T.StructField("o", T.DateType()), T.StructField("t", T.IntegerType())])
ODD_TEXTS = [
    (1, None), (2, ""), (3, " \n\t \r"), (None, "a text without an id, which has some words"), (5, "a b c"),
    (5, "a b c"), (6, LONG), (7, PASSAGE + "."), (8, "Before it. " + PASSAGE.upper() + ", after it."),
    (9, PASSAGE + "."), (9, "another text of the same id\n\n" + PASSAGE), (None, None), (10, "é Ünïcode ÀÉ straße 日本語   x"),
    (11, "x" * 300_000), (12, "### $$$ *** ||| <> %% && ##"), (13, "one\ntwo\none line that repeats\none line that repeats\n"),
    (14, "One Line That Repeats \r\nthree"), (15, "Released under the MIT License.\nmail a.b@example.com now"),
]


def odd_rows():
    return [(i, t, None, "s", None, None, 1, "x", None, "y", "z", dt.date(2024, 1, 1), None) for i, t in ODD_TEXTS]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), ODD_SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


@pytest.fixture(scope="session")
def small_docs(spark):
    """sf0.001 documents and their rows as (doc_id, text)."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    return df, [(r.doc_id, r.text) for r in df.collect()]
