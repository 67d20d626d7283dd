"""Real-time sliding-window metrics with a watermark (J2, J6): open windows
upserted per micro-batch (J5), closed windows appended once.

Event time must be ``TIMESTAMP`` for ``withWatermark``; ``timestamp_ntz``
columns are cast (the session time zone is UTC, so wall times are kept).
Rows older than the watermark are dropped from the aggregates by Spark (J6);
they are still in the raw layer, which ``ingest`` writes unconditionally, and
``late_rows`` finds them there.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import exact_sum
from ..sinks.upsert import KeyedTable


def sliding_metrics(stream: DataFrame, ts: str, size: str, slide: str, dims: Sequence[str],
                    value: str = "value", watermark: str = "10 minutes", scale: int | None = None) -> DataFrame:
    """Windowed count and exact sum per ``dims``; state is dropped once the
    watermark passes a window's end."""
    ev = stream.withColumn("__et", F.col(ts).cast("timestamp")).withWatermark("__et", watermark)
    w = F.window("__et", size, slide)
    return (ev.groupBy(w.alias("w"), *dims)
            .agg(F.count(F.lit(1)).alias("events"), exact_sum(value, scale).alias("value_sum"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), *dims,
                    "events", "value_sum"))


def upsert_batches(table: KeyedTable):
    """A ``foreachBatch`` function that upserts each micro-batch by key.

    Only the table partitions the batch touches are rewritten (recent windows
    in a windowed aggregate), and a batch whose rows the table already holds
    is skipped, so every batch is applied once even when the stream replays it.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id=batch_id)
    return apply


ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb_state(spark) -> None:
    """Keep aggregation state in RocksDB (off-heap, spills to local disk and is
    snapshotted to the checkpoint) unless the session chose a provider.  Must
    be set before a query's first start; a checkpoint keeps its provider."""
    key = "spark.sql.streaming.stateStore.providerClass"
    current = spark.conf.get(key, None)
    if not current or current.endswith("HDFSBackedStateStoreProvider") and \
            key not in dict(spark.sparkContext.getConf().getAll()):
        spark.conf.set(key, ROCKSDB_PROVIDER)


def _start(writer, spark: SparkSession, checkpoint: str, trigger: dict | None, state_partitions: int | None) -> StreamingQuery:
    """Start a stateful query.  Window state grows with the number of open
    windows x keys; it lives in RocksDB rather than on the JVM heap.
    ``state_partitions`` sets how many state stores it keeps (fixed in the
    checkpoint at the first start); the session's settings are only changed
    while the query starts."""
    provider, partitions = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {k: spark.conf.get(k, None) for k in (provider, partitions)}
    use_rocksdb_state(spark)
    if state_partitions:
        spark.conf.set(partitions, str(state_partitions))
    try:
        return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_upserting(agg: DataFrame, table: KeyedTable, checkpoint: str,
                  trigger: dict | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """``agg`` in update mode; every micro-batch is upserted into ``table``."""
    return _start(agg.writeStream.outputMode("update").foreachBatch(upsert_batches(table)),
                  agg.sparkSession, checkpoint, trigger, state_partitions)


def run_appending(agg: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = (),
                  trigger: dict | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """``agg`` in append mode into the exactly-once file sink.  A window
    is written once, when the watermark has passed its end; nothing is ever
    rewritten, and windows still open are kept in the state."""
    writer = agg.writeStream.outputMode("append").format("parquet").option("path", path)
    return _start(writer.partitionBy(*partition_by) if partition_by else writer,
                  agg.sparkSession, checkpoint, trigger, state_partitions)


def late_rows(raw: DataFrame, ts: str, size: str, slide: str, watermark: str, batch: str = "batch_id") -> DataFrame:
    """The rows of a raw table that came too late for their last window:
    it had ended at the watermark their micro-batch began with, which is the
    latest time in earlier batches less the delay (as ``interval`` text).

    One row per micro-batch passes through the running maximum, and is then
    sent to all tasks: joined by a shuffle, a batch's rows would be read by one
    task."""
    before = Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    known = raw.groupBy(batch).agg(F.max(ts).alias("__t")) \
        .select(F.col(batch).alias("__b"), (F.max("__t").over(before) - F.expr(f"interval {watermark}")).alias("__known"))
    end = F.window(F.col(ts), slide).getField("start") + F.expr(f"interval {size}")
    return raw.withColumn("__end", end).join(F.broadcast(known), (F.col(batch) == F.col("__b")) & (F.col("__end") <= F.col("__known"))) \
        .drop("__b", "__known", "__end")


def window_table(spark: SparkSession, root: str, dims: Sequence[str], grain: str = "day") -> KeyedTable:
    """The keyed sink for ``sliding_metrics``: key (window_start, dims),
    partitioned by the window's day, so a batch rewrites only the days whose
    windows it touches."""
    return KeyedTable(spark, root, ["window_start", *dims], partition_by=F.to_date(F.date_trunc(grain, "window_start")))
