"""Layer tables ODS -> DWD -> ADS.

* ODS: raw documents, partitioned by day and batch, kept forever.  A batch
  adds to its days; sent again, it replaces only itself.
* DWD: flattened detail rows that passed the quality rules, by day, 90 days.
* ADS: hourly/daily roll-ups and the cube, by day, 365 days.

DWD and ADS writes use dynamic partition overwrite, so a re-run of a day
replaces only that day's partitions.  Reads of a layer for a time range also get the
matching ``dt`` predicate, so Spark prunes partitions instead of listing and
opening every day (``PartitionFilters`` in the plan).

A ``dt`` folder holds one slot of the layers' grain (a day, or a week, month,
quarter or year for sparse tables) and is named by its first day.  Bounds given
as days or times always pass through ``slot_start``, and a folder goes only
when its last day has expired.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.predicates import literal, time_literal, wall_time
from ..operators.quality import Rule, flag_rules
from ..operators.rollups import cube_rollup, partials, time_rollup
from ..sources.documents import document_time, flatten

# Retention per layer in days (None = forever).
RETENTION_DAYS = {"ods": None, "dwd": 90, "ads": 365}


def _day(d) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(str(d)[:10])


def _is_day(text: str) -> bool:
    try:
        dt.date.fromisoformat(text[:10])
        return True
    except ValueError:
        return False


#: Months of the grains that are whole months.
_MONTHS = {"month": 1, "quarter": 3, "year": 12}


def slot_start(day, grain: str) -> dt.date:
    """The first day of the slot that holds ``day``."""
    day = _day(day)
    if grain == "day":
        return day
    if grain == "week":
        return day - dt.timedelta(days=day.weekday())
    return dt.date(day.year, (day.month - 1) // _MONTHS[grain] * _MONTHS[grain] + 1, 1)


def slot_end(start: dt.date, grain: str) -> dt.date:
    """The last day of the slot that begins on ``start``."""
    span = {"day": 1, "week": 7}.get(grain) or 31 * _MONTHS[grain] + 1
    return slot_start(start + dt.timedelta(days=span), grain) - dt.timedelta(days=1)


def retention(df: DataFrame, dt_col: str, run_day, days: int | None, ts: str | None = None,
              grain: str = "day") -> DataFrame:
    """Keep the last ``days`` days up to ``run_day``.

    The predicate goes on ``dt_col`` (partition pruning on a layer table) and,
    when given, on the raw timestamp ``ts`` too (row-group pruning in the scan;
    needed to cut inside a slot coarser than a day).
    """
    if days is None:
        return df
    cutoff = _day(run_day) - dt.timedelta(days=days)
    out = df.filter(F.col(dt_col) >= F.lit(slot_start(cutoff, grain)))
    if ts is not None:
        out = out.filter(F.col(ts) >= time_literal(cutoff))
    return out


def time_range_with_partitions(df: DataFrame, ts: str, start: dt.datetime, end: dt.datetime,
                               dt_col: str = "dt", grain: str = "day") -> DataFrame:
    """Range on the time column plus the derived range of slots on the
    partition column, so a layer read prunes partitions (the hand-added rewrite)."""
    first, last = (slot_start(wall_time(t).date(), grain) for t in (start, end))
    return df.filter((F.col(ts) >= literal(start)) & (F.col(ts) <= literal(end))
                     & (F.col(dt_col) >= F.lit(first)) & (F.col(dt_col) <= F.lit(last)))


@dataclass
class Layers:
    spark: SparkSession
    root: str
    #: What one ``dt`` folder holds; coarser than a day for sparse tables.
    grain: str = "day"

    def slot(self, c) -> Column:
        """The ``dt`` folder of a day or time."""
        return F.to_date(F.date_trunc(self.grain, c))

    def path(self, layer: str, name: str) -> str:
        return f"{self.root.rstrip('/')}/{layer}/{name}"

    def write(self, df: DataFrame, layer: str, name: str, dt_col: str = "dt", batch_col: str | None = None) -> None:
        """Dynamic partition overwrite by day.

        The ``rebalance`` hint lets AQE size the write tasks by the day column:
        small days are coalesced into few files, a hot day is split over
        several tasks instead of landing in one.
        """
        (df.hint("rebalance", dt_col).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic")
         .partitionBy(dt_col, *([batch_col] if batch_col else [])).parquet(self.path(layer, name)))

    def read(self, layer: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, name))

    def ods_documents(self, docs: DataFrame, batch_id: str) -> None:
        """ODS: raw documents (``doc_id`` and the document's columns) by day
        and batch.

        The day comes from a ``dt`` column when the producer has it, else from
        the document's ``timestamp`` (a time that cannot be read has no day).
        """
        day = F.col("dt") if "dt" in docs.columns else document_time("timestamp")
        self.write(docs.withColumn("dt", self.slot(day)).withColumn("batch_id", F.lit(batch_id)), "ods", "device_documents", batch_col="batch_id")

    def dwd_devices(self, rules: list[Rule], days=None) -> tuple[DataFrame, DataFrame]:
        """DWD: flatten the ODS documents and flag them with the quality
        rules, in one pass and one write (``dq_pass`` per row).

        ``days`` limits the run to the days that new batches touched; the slot
        of each is rebuilt from all its batches.  Returns (passing rows, rejected rows)
        as reads of that table; the ``dq_pass`` filter is pushed into the scan.
        """
        ods = self.read("ods", "device_documents")
        if days is not None:
            ods = ods.filter(self._in_slots(days))
        self.write(flag_rules(flatten(ods, keep=("dt",)), rules), "dwd", "device_checked")
        return self.dwd_good(), self.dwd_rejects()

    def dwd_good(self) -> DataFrame:
        t = self.read("dwd", "device_checked")
        return t.filter(F.col("dq_pass")).drop("dq_pass", "dq_failed_rules")

    def dwd_rejects(self) -> DataFrame:
        return self.read("dwd", "device_checked").filter(~F.col("dq_pass"))

    def ads_partials(self, rows: DataFrame, ts: str, dims: list[str], device: str, value: str = "value",
                     scale: int | None = None, name: str = "hourly_partials") -> None:
        """ADS: hourly partials of the slots that ``rows`` (whole slots of
        detail) hold; days, weeks and cubes are merged from this table alone."""
        parts = partials(rows, ts, dims, device, value, scale)
        self.write(parts.withColumn("dt", self.slot("bucket_start")), "ads", name)

    def ads_rollups(self, value: str = "battery_pct", scale: int | None = None,
                    tables: tuple[str, ...] = ("hourly", "daily", "cube"), days=None) -> None:
        """ADS: hourly and daily roll-ups and the type x status cube per day
        (each partitioned by slot; ``tables`` picks which to rebuild, ``days``
        the days that changed)."""
        dwd = self.dwd_good()
        if days is not None:
            dwd = dwd.filter(self._in_slots(days))
        if "hourly" in tables:
            hourly = time_rollup(dwd, "event_time", "hour", ["device_type"], value=value, scale=scale)
            self.write(hourly.withColumn("dt", self.slot("bucket_start")), "ads", "hourly")
        if "daily" in tables:
            daily = time_rollup(dwd, "event_time", "day", ["device_type"], value=value, scale=scale,
                                distinct_of="device_id")
            self.write(daily.withColumn("dt", self.slot("event_date")), "ads", "daily")
        if "cube" in tables:
            cube = cube_rollup(dwd, ["device_type", "status"], value=value, scale=scale, fixed=["dt"])
            self.write(cube, "ads", "cube")

    def _in_slots(self, days) -> Column:
        return F.col("dt").isin(sorted({slot_start(d, self.grain) for d in days}))

    def apply_retention(self, run_day) -> dict[str, int]:
        """Drop the slots whose last day is older than each layer's retention
        (dynamic overwrite cannot delete, so old ``dt=`` folders are removed
        directly)."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        removed = {}
        for layer, days in RETENTION_DAYS.items():
            if days is None:
                continue
            cutoff = _day(run_day) - dt.timedelta(days=days)
            base = jvm.org.apache.hadoop.fs.Path(f"{self.root.rstrip('/')}/{layer}")
            fs = base.getFileSystem(conf)
            if not fs.exists(base):
                continue
            n = 0
            for table_status in fs.listStatus(base):
                if not table_status.isDirectory():
                    continue
                for part in fs.listStatus(table_status.getPath()):
                    name = part.getPath().getName()
                    if name.startswith("dt=") and _is_day(name[3:]) and slot_end(_day(name[3:]), self.grain) < cutoff:
                        fs.delete(part.getPath(), True)
                        n += 1
            removed[layer] = n
        return removed
