"""Micro-batch ingest (J1, J4) and device-type topics.

Streams read files (or Kafka when its connector is present), keep every row
in the raw layer, and commit progress in a checkpoint under the shared
folder, so a restarted query resumes after the last committed batch and adds
no duplicates.  Production uses a one-minute processing-time trigger; tests
use ``availableNow`` (process what is there, then stop).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

DEFAULT_TRIGGER = {"processingTime": "1 minute"}


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame over files arriving under ``path`` (schema required)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def kafka_stream(spark: SparkSession, bootstrap_servers: str, topics: str,
                 max_offsets_per_trigger: int | None = None, starting: str = "earliest") -> DataFrame:
    """A7/J1 over Kafka (connector needed): key/value as text plus offsets."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers)
         .option("subscribe", topics).option("startingOffsets", starting))
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return r.load().select(F.col("key").cast("string"), F.col("value").cast("string"),
                           "topic", "partition", "offset", "timestamp")


def read_for(spark: SparkSession, sync_type: str, path: str, schema: T.StructType,
             fmt: str = "parquet") -> DataFrame:
    """A continuous sync reads a stream, a scheduled one a batch."""
    if sync_type in ("stream", "continuous"):
        return file_stream(spark, path, schema, fmt)
    return spark.read.schema(schema).format(fmt).load(path)


def ingest(stream: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None,
           trigger: dict | None = None, query_name: str | None = None) -> StreamingQuery:
    """Append every row to the raw layer (Parquet, optionally by day).

    The file sink is exactly-once with its checkpoint: a batch re-run after a
    failure replaces its own output instead of adding to it.
    """
    w = (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    if partition_by:
        w = w.partitionBy(*partition_by)
    if query_name:
        w = w.queryName(query_name)
    return w.trigger(**(trigger or DEFAULT_TRIGGER)).start()


def ingest_batches(stream: DataFrame, path: str, checkpoint: str, batch: str = "batch_id",
                   partition_by: tuple[str, ...] = (), trigger: dict | None = None) -> StreamingQuery:
    """Append every row to the raw layer with the micro-batch that brought
    it, as its first partition column.  A batch sent again overwrites itself."""
    def write(rows: DataFrame, batch_id: int) -> None:
        (rows.withColumn(batch, F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(batch, *partition_by).parquet(path))

    return (stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
            .trigger(**(trigger or DEFAULT_TRIGGER)).start())


def with_day(df: DataFrame, ts: str, out: str = "dt") -> DataFrame:
    return df.withColumn(out, F.to_date(ts))
