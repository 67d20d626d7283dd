"""Full and incremental reads with a committed watermark.

A sync reads ``(watermark, upper]`` of its increment column, writes the rows,
and only then commits the next watermark (S7), so a crash between the two
replays the batch; the keyed upsert makes that replay harmless.

``run_stream_sync`` runs the same definition continuously: the stream's
checkpoint is its state, the definition's watermark is where it begins, and
``write`` is the same.

The batch statistics that decide the next watermark (row count and max id)
are observed while the batch is written, so the source is read once and no
second copy of the increment is made.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.predicates import literal, parse_day
from ..session import shared_root

# Initial watermark per increment-column type (C1).  The
# datetime seed is the Unix epoch written in UTC+8.
INITIAL_WATERMARK = {
    "datetime": "1970-01-01 08:00:00",
    "int": "0",
    "date": "1970-01-01",
}
MODES = ("full", "inc")


class UnsupportedIncrement(ValueError):
    pass


@dataclass(frozen=True)
class SyncSpec:
    """One sync definition: what to read and how far it got."""
    name: str
    inc_or_full: str = "inc"
    inc_column: str | None = "create_time"
    inc_column_type: str | None = "datetime"
    last_watermark: str | None = None
    source_id: int | None = None
    target_id: int | None = None

    def __post_init__(self):
        if self.inc_or_full not in MODES:
            raise ValueError(f"inc_or_full must be one of {MODES}")
        if self.inc_or_full == "inc" and self.inc_column_type not in INITIAL_WATERMARK:
            # Unknown types are rejected instead of silently getting a time predicate.
            raise UnsupportedIncrement(f"unsupported increment type {self.inc_column_type!r}")


def initial_watermark(inc_column_type: str) -> str:
    """C1."""
    try:
        return INITIAL_WATERMARK[inc_column_type]
    except KeyError:
        raise UnsupportedIncrement(f"unsupported increment type {inc_column_type!r}") from None


def seeded(spec: SyncSpec) -> SyncSpec:
    """An incremental spec without a watermark starts from the type's seed."""
    if spec.inc_or_full == "inc" and spec.last_watermark in (None, ""):
        return replace(spec, last_watermark=initial_watermark(spec.inc_column_type))
    return spec


def updated(old: SyncSpec, new: SyncSpec) -> SyncSpec:
    """Reset the watermark when the spec becomes incremental or the column
    type changes; otherwise keep the stored one."""
    if new.inc_or_full != "inc":
        return replace(new, last_watermark=None)
    if old.inc_or_full != "inc" or old.inc_column_type != new.inc_column_type:
        return replace(new, last_watermark=initial_watermark(new.inc_column_type))
    return replace(new, last_watermark=old.last_watermark)


def _ts(text: str) -> dt.datetime:
    """A watermark or bound; an offset in the text is applied."""
    return parse_day(text)


def _day(text: str) -> dt.date:
    return dt.date.fromisoformat(text[:10])


def increment_predicate(spec: SyncSpec, upper: str | None = None,
                        run_day: str | None = None) -> Column | None:
    """A3-A5: the batch predicate for a spec.

    * int: ``c > wm`` (no upper bound);
    * datetime: ``wm < c <= upper`` (upper passed in once per run);
    * date: whole days ``wm < day(c) <= run_day - 1``, written as a range on
      the raw column so the scan can use it: ``c >= wm + 1 day`` and
      ``c < run_day``.
    Full copies have no predicate (A2).
    """
    spec = seeded(spec)
    if spec.inc_or_full == "full":
        return None
    c, wm, kind = F.col(spec.inc_column), spec.last_watermark, spec.inc_column_type
    if kind == "int":
        return c > F.lit(int(wm))
    if kind == "datetime":
        if upper is None:
            raise ValueError("datetime increments need the run's upper bound")
        return (c > literal(_ts(wm))) & (c <= literal(_ts(upper)))
    if kind == "date":
        if run_day is None:
            raise ValueError("date increments need the run day")
        lo = dt.datetime.combine(_day(wm) + dt.timedelta(days=1), dt.time())
        hi = dt.datetime.combine(_day(run_day), dt.time())
        return (c >= literal(lo)) & (c < literal(hi))
    raise UnsupportedIncrement(kind)


def read_increment(source: DataFrame, spec: SyncSpec, upper: str | None = None,
                   run_day: str | None = None) -> DataFrame:
    """A1-A5: the rows of this run (the filter reaches the scan / JDBC query)."""
    pred = increment_predicate(spec, upper, run_day)
    return source if pred is None else source.filter(pred)


def batch_measures(spec: SyncSpec, upper: str | None = None, run_day: str | None = None) -> tuple[Column, Column]:
    """C3/C4/C6 as two aggregates of a batch: its rows and the next watermark.

    * int: the max of the increment column, or the old watermark when the
      batch is empty (state untouched, C6);
    * datetime: the run's upper bound (everything up to it has been read);
    * date: the day before the run day.
    """
    spec = seeded(spec)
    if spec.inc_or_full == "full":
        nxt = F.max(F.lit(None).cast("string"))
    elif spec.inc_column_type == "int":
        nxt = F.coalesce(F.max(spec.inc_column).cast("string"), F.lit(str(spec.last_watermark)))
    elif spec.inc_column_type == "datetime":
        nxt = F.coalesce(F.max(F.lit(upper)), F.lit(upper))
    else:
        day = (_day(run_day) - dt.timedelta(days=1)).isoformat()
        nxt = F.coalesce(F.max(F.lit(day)), F.lit(day))
    return F.count(F.lit(1)), nxt


def batch_stats(batch: DataFrame, spec: SyncSpec, upper: str | None = None,
                run_day: str | None = None) -> DataFrame:
    """The batch's measures as one row: task, inc_column_type, batch_rows,
    next_watermark."""
    n, nxt = batch_measures(spec, upper, run_day)
    return batch.agg(n.alias("batch_rows"), nxt.alias("next_watermark")) \
        .select(F.lit(spec.name).alias("task"), F.lit(seeded(spec).inc_column_type).alias("inc_column_type"),
                "batch_rows", "next_watermark")


# ---------------------------------------------------------------- state

STATE_SCHEMA = T.StructType([
    T.StructField("task", T.StringType(), False),
    T.StructField("last_watermark", T.StringType(), True),
    T.StructField("enabled", T.BooleanType(), False),
    T.StructField("updated_at", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
])


class StateStore:
    """Append-only commit log of task states under a shared folder.

    A commit appends one small file; the current state of a task is its row
    with the highest ``seq``.  Nothing is overwritten in place, so a failed
    commit leaves the previous state readable, and what a commit does not set
    (the enabled flag, the watermark) is carried over (C5).
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        """``path`` defaults to one fixed folder under the one that
        ``spark.checkpoint.dir`` names, the same for every application."""
        self.spark = spark
        self.path = path or f"{shared_root(spark)}/fleetlake/sync_state"

    def _log(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(STATE_SCHEMA).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def current(self) -> DataFrame:
        log = self._log()
        if log is None:
            return self.spark.createDataFrame([], STATE_SCHEMA)
        latest = log.groupBy("task").agg(F.max_by(F.struct(*log.columns), "seq").alias("s"))
        return latest.select("s.*")

    def _row(self, task: str):
        rows = self.current().filter(F.col("task") == task).take(1)
        return rows[0] if rows else None

    def get(self, task: str, default: str = "0") -> str:
        row = self._row(task)
        return row.last_watermark if row and row.last_watermark is not None else default

    def enabled(self, task: str) -> bool:
        """Whether the task may run; a task without a state may."""
        row = self._row(task)
        return row is None or row.enabled

    def _append(self, rows: DataFrame) -> None:
        # Commit order: later than every logged commit, even if the clock stepped back.
        log = self._log()
        last = log.agg(F.max("seq")).collect()[0][0] if log is not None else None
        seq = max(int(dt.datetime.now().timestamp() * 1e6), (last or 0) + 1)
        (rows.withColumn("seq", F.lit(seq).cast("long")).select(*STATE_SCHEMA.fieldNames())
         .coalesce(1).write.mode("append").parquet(self.path))

    def set_enabled(self, task: str, enabled: bool, updated_at: str) -> None:
        self._append(self.spark.createDataFrame(
            [(task, self.get(task, default=None), enabled, updated_at)],
            "task string, last_watermark string, enabled boolean, updated_at string"))

    def reset(self, spec: SyncSpec, updated_at: str) -> None:
        """The watermark of a changed definition takes the place of the
        stored one."""
        self._append(self.spark.createDataFrame(
            [(spec.name, spec.last_watermark, self.enabled(spec.name), updated_at)],
            "task string, last_watermark string, enabled boolean, updated_at string"))

    def commit(self, stats: DataFrame, updated_at: str) -> None:
        """Append the next watermark of each task in ``stats`` (C3/C4); tasks
        whose batch was empty keep their state untouched (C6)."""
        flags = self.current().select(F.col("task").alias("__task"), F.col("enabled").alias("__enabled"))
        done = stats.filter(F.col("batch_rows") > 0)
        self._append(done.join(flags, done["task"] == flags["__task"], "left").select(
            "task", F.col("next_watermark").alias("last_watermark"),
            F.coalesce("__enabled", F.lit(True)).alias("enabled"), F.lit(updated_at).alias("updated_at")))


def run_sync(spark: SparkSession, source: DataFrame, spec: SyncSpec, write, state: StateStore,
             upper: str | None = None, run_day: str | None = None,
             run_ts: str | None = None, gate=None) -> dict:
    """One sync run in commit order (S7): read -> gate -> write -> state.

    ``gate(batch)`` may raise to stop before anything is written (B7).
    ``write(batch)`` performs the sink write; its first job over the batch
    also yields the row count and the next watermark, so the watermark
    committed is that of the rows written.  A disabled task is not run.
    """
    if not state.enabled(spec.name):
        return {"task": spec.name, "batch_rows": 0, "next_watermark": state.get(spec.name, default=None),
                "inc_column_type": spec.inc_column_type}
    stored = state.get(spec.name, default=None) if spec.inc_or_full == "inc" else None
    if stored is not None:
        spec = replace(spec, last_watermark=stored)
    batch = read_increment(source, spec, upper, run_day)
    if batch.isEmpty():                   # C6: nothing written, state untouched
        return batch_stats(batch.limit(0), spec, upper, run_day).collect()[0].asDict()
    if gate is not None:
        gate(batch)
    seen = Observation()
    n, nxt = batch_measures(spec, upper, run_day)
    write(batch.observe(seen, n.alias("batch_rows"), nxt.alias("next_watermark")))
    stats = {"task": spec.name, "inc_column_type": seeded(spec).inc_column_type, **seen.get}
    if spec.inc_or_full == "inc":
        state.commit(spark.createDataFrame([stats], "task string, inc_column_type string, batch_rows long, "
                                                    "next_watermark string"), run_ts or upper or run_day or "")
    return stats


def lower_bound(spec: SyncSpec) -> Column | None:
    """Where a definition begins, without an end: a stream takes what comes."""
    spec = seeded(spec)
    if spec.inc_or_full == "full":
        return None
    kind, wm = spec.inc_column_type, spec.last_watermark
    if kind == "int":
        return F.col(spec.inc_column) > F.lit(int(wm))
    if kind == "datetime":
        return F.col(spec.inc_column) > literal(_ts(wm))
    return F.col(spec.inc_column) >= literal(dt.datetime.combine(_day(wm) + dt.timedelta(days=1), dt.time()))


def run_stream_sync(source: DataFrame, spec: SyncSpec, write, checkpoint: str, state: StateStore | None = None,
                    trigger: dict | None = None) -> StreamingQuery:
    """The continuous run of a definition over a streaming ``source``.

    Each micro-batch goes through ``write``, which must bear being called
    again with the same rows (an upsert); empty ones do not (C6).  A watermark
    that scheduled runs left in ``state`` is where the stream begins."""
    stored = state.get(spec.name, default=None) if state is not None and spec.inc_or_full == "inc" else None
    first = lower_bound(replace(spec, last_watermark=stored) if stored is not None else spec)

    def apply(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(batch)

    rows = source if first is None else source.where(first)
    return (rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
            .trigger(**(trigger or {"processingTime": "1 minute"})).start())
