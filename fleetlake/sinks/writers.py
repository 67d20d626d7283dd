"""File sinks: CSV export (B6), append (B1, B10), partition overwrite.

Writes stay distributed: every task writes its own part file, nothing is
gathered on the driver.  CSV output is plain UTF-8 with a header per part
file (S12: Spark's writer adds no byte-order mark).
"""

from __future__ import annotations

from typing import Callable, Sequence

from pyspark.sql import DataFrame


def export_name(indicator: str, start: str, end: str) -> str:
    """The export's base name ``{indicator}_{start}_{end}``."""
    return f"{indicator}_{start}_{end}"


def export_csv(df: DataFrame, folder: str, name: str) -> str:
    """Header CSV under ``folder/name`` (multi-part); returns the path."""
    path = f"{folder.rstrip('/')}/{name}"
    (df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    return path


def append(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Append rows to a Parquet table."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite),
    the partition-level form of the reference's delete-then-insert hook."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def with_hooks(df: DataFrame, write: Callable[[DataFrame], None],
               before: Sequence[Callable[[], None]] = (), after: Sequence[Callable[[], None]] = ()) -> None:
    """B2: a write between hooks (for example delete-then-insert of a day); a
    hook that raises stops what follows, and after-hooks run only once the
    write is complete."""
    for hook in before:
        hook()
    write(df)
    for hook in after:
        hook()
