"""Keyed upsert (B3, B4, F6, H1) and the table it keeps.

``upsert(existing, incoming, keys)`` keeps, per key, the incoming row when
there is one and the existing row otherwise; within one batch the latest row
wins.  It is one shuffle on the key for the anti-join; the in-batch choice is
a ``max_by`` aggregate, combined map-side, so a key holding a third of the
batch never lands in one task whole.
"""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """H1: the row with the greatest ``order_by`` per key (ties: any one row)."""
    keys = list(keys)
    others = [c for c in df.columns if c not in keys]
    order = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_by])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others]).select(*df.columns)


def stamp(df: DataFrame, run_ts: str, column: str = "created_at") -> DataFrame:
    """Ingest stamp, a literal passed in once per run (never the clock)."""
    return df.withColumn(column, F.lit(run_ts))


def upsert(existing: DataFrame | None, incoming: DataFrame, keys: Sequence[str],
           order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """Replace whole rows by key; last write wins.

    ``order_by`` orders rows of the same key inside ``incoming`` (ingest order);
    without it the batch must already hold one row per key.  A null key
    matches a null key.
    """
    keys = list(keys)
    batch = latest_per_key(incoming, keys, order_by) if order_by else incoming
    if existing is None:
        return batch
    taken = batch.select(*[F.col(k).alias(f"__{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [existing[k].eqNullSafe(taken[f"__{k}"]) for k in keys])
    kept = existing.join(taken, same, "left_anti")
    return batch.unionByName(kept.select(*batch.columns))


class KeyedTable:
    """A Parquet table upserted by key through dynamic partition overwrite.

    Rows are placed in partitions by a function of the key: a hash bucket of
    the key columns (``buckets``), or a column or expression that the caller
    derives from the key (``partition_by``, for example the day of a window
    start that is part of the key).  So a key always lives in one partition,
    and an upsert reads and rewrites only the partitions its batch touches.

    One upsert joins the batch with those partitions, writes the result to a
    staged table and overwrites the partitions from it.  The staged table is
    complete once its success marker is there: a crash before that changes
    nothing, one after it is made good by the next upsert, which first
    overwrites from what is staged.  The first upsert writes the table itself,
    which is there once its own marker is.  Each row carries the id of the batch that
    wrote it, so a micro-batch sent again is recognised in the partitions it
    touches and skipped.  A table has one writer; readers see a partition
    change when it is overwritten.

    Null keys and null partition values are values like any other.
    """

    #: Folder of each row's partition, and the batch that wrote the row.
    PLACE, BATCH = "__place", "__batch"

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str],
                 partition_by: str | Column | None = None, buckets: int = 64):
        self.spark, self.root, self.keys = spark, root.rstrip("/"), list(keys)
        self.data, self.staged = f"{self.root}/data", f"{self.root}/staged"
        if partition_by is None:
            partition_by = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(buckets))
        value = F.col(partition_by) if isinstance(partition_by, str) else partition_by
        # A letter in front keeps folder names text.
        self.place = F.coalesce(F.concat(F.lit("p"), value.cast("string")), F.lit("none"))

    def _file(self, path: str):
        file = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return file.getFileSystem(self.spark._jsc.hadoopConfiguration()), file

    def _complete(self, path: str) -> bool:
        """Whether a write to ``path`` has been committed."""
        fs, file = self._file(f"{path}/_SUCCESS")
        return fs.exists(file)

    def _rows(self, path: str, schema=None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(path)

    def read(self) -> DataFrame | None:
        """The table as of now, without the columns of its own."""
        return self._rows(self.data).drop(self.PLACE, self.BATCH) if self._complete(self.data) else None

    def applied(self, batch_id: int) -> bool:
        """Whether a micro-batch, or a later one, has written rows that are
        still there."""
        return self._complete(self.data) and not self._rows(self.data).where(F.col(self.BATCH) >= batch_id).isEmpty()

    def upsert(self, incoming: DataFrame, order_by: Sequence[str | Column] | None = None,
               batch_id: int | None = None) -> list[str]:
        """Upsert ``incoming``; returns the partition values rewritten
        (``[]`` when nothing was done)."""
        self.recover()
        batch = latest_per_key(incoming, self.keys, order_by) if order_by else incoming
        batch = batch.withColumn(self.BATCH, F.lit(batch_id).cast("long")).withColumn(self.PLACE, self.place)
        batch = batch.persist()  # read twice: for its partitions and for its rows
        try:
            # At most the number of buckets, or of partition values in the batch.
            touched = sorted(r[0] for r in batch.select(self.PLACE).distinct().collect())
            if not touched:
                return []
            if not self._complete(self.data):
                self._write(batch, self.data)
            else:
                existing = self._rows(self.data, batch.schema).where(F.col(self.PLACE).isin(touched))
                if batch_id is not None and not existing.where(F.col(self.BATCH) >= batch_id).isEmpty():
                    return []
                self._write(upsert(existing, batch, self.keys), self.staged)
                self._publish()
        finally:
            batch.unpersist()
        return [p[1:] if p != "none" else None for p in touched]

    def _write(self, rows: DataFrame, path: str) -> None:
        # rebalance: AQE sizes the write tasks per partition value, so a
        # bucket is neither one huge task nor scattered over every task.
        rows.hint("rebalance", self.PLACE).write.mode("overwrite").partitionBy(self.PLACE).parquet(path)

    def _publish(self) -> None:
        (self._rows(self.staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(self.PLACE).parquet(self.data))
        fs, file = self._file(self.staged)
        fs.delete(file, True)

    def recover(self) -> None:
        """Overwrite from a staged table that was complete but not published."""
        if self._complete(self.staged):
            self._publish()
