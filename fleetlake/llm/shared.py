"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from typing import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir

#: Paths written since each open ``scratch`` began, the innermost last.
_open: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a cut in the lineage
    that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    if _open:
        _open[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``written`` makes inside are deleted at the end.  What is
    to be read later goes through the function given, which writes it to stay
    (or to be deleted by the scratch around this one)."""
    mine: list[str] = []
    _open.append(mine)

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = shared_path(spark, name)
        if len(_open) > 1:
            _open[-2].append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield kept
    finally:
        _open.remove(mine)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in mine:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
