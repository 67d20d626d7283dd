"""Small stream files of closed days rewritten by size.

``ingest_days`` appends each micro-batch to a raw table under (day, batch);
after a few hundred micro-batches a day is many small files.  ``compact`` moves
the days that have closed into a table partitioned by day only, in files of
the session's target size, and then removes their raw folders.

Rows keep the id of the batch that brought them.  What a compaction finds
under an id replaces what an earlier one took from that id, so a run that was
stopped anywhere can be started again, and a batch that is sent again, or late
rows of a closed day, are taken in by the next run.  ``read`` shows each row
once at any time between runs.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .ingest import DEFAULT_TRIGGER, with_day

DAY, BATCH = "dt", "batch_id"


def ingest_days(stream: DataFrame, ts: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Every row into ``path/dt=<day>/batch_id=<micro-batch>``."""
    def write(rows: DataFrame, batch_id: int) -> None:
        (with_day(rows, ts).withColumn(BATCH, F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(DAY, BATCH).parquet(path))

    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(**(trigger or DEFAULT_TRIGGER)).start())


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows under ``path`` (none when there is no such folder)."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _schema(rows: T.StructType) -> T.StructType:
    names = (DAY, BATCH)
    fields = [f for f in rows.fields if f.name not in names]
    return T.StructType(fields + [T.StructField(BATCH, T.LongType()), T.StructField(DAY, T.DateType())])


def _without(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``old`` whose (day, batch) ``new`` does not have."""
    return old.join(new.select(DAY, BATCH).distinct(), [DAY, BATCH], "left_anti").select(*old.columns)


def compact(spark: SparkSession, raw: str, target: str, rows: T.StructType, closed_before: dt.date) -> list[dt.date]:
    """Take the raw days before ``closed_before`` into ``target``; returns them."""
    schema = _schema(rows)
    fresh = _table(spark, raw, schema).where(F.col(DAY) < F.lit(closed_before))
    days = sorted(r[0] for r in fresh.select(DAY).distinct().collect())       # one per closed day
    if not days:
        return []
    have = _table(spark, target, schema).where(F.col(DAY).isin(days))
    staged = f"{target}_staged"
    # rebalance: files of the advisory size, a large day over several tasks.
    _without(have, fresh).unionByName(fresh).hint("rebalance", DAY).write.mode("overwrite").partitionBy(DAY).parquet(staged)
    (spark.read.schema(schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(DAY).parquet(target))
    _remove(spark, [f"{raw}/{DAY}={d}" for d in days] + [staged])
    return days


def _remove(spark: SparkSession, paths: Sequence[str]) -> None:
    for path in paths:
        file = spark._jvm.org.apache.hadoop.fs.Path(path)
        file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, True)


def read(spark: SparkSession, raw: str, target: str, rows: T.StructType) -> DataFrame:
    """All rows, open days and closed ones."""
    schema = _schema(rows)
    fresh = _table(spark, raw, schema)
    return _without(_table(spark, target, schema), fresh).unionByName(fresh)
