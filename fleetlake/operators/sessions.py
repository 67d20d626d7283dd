"""Activity sessions per device, split so a hot device is not one task.

Two consecutive events of a device belong to one session when the later one
comes at most ``gap`` after the earlier one (``session_window`` semantics:
a session reaches to its last event + gap, inclusive).

1. Events of a device in one slot of ``gap`` length are at most ``gap``
   apart, so they are one session: each (device, slot) is a plain aggregate,
   combined in every task before the shuffle, however dense a device is.
2. Sessions are built per (device, time bucket) with ``session_window`` over
   the slots: the shuffle key includes the bucket, so a device's slots spread
   over many tasks.  The gap is per row, ``(last - start) + gap``, so a slot
   reaches exactly to ``last + gap``.
3. Partial sessions that touch across a bucket edge are merged the same way.
   Those of one bucket are more than ``gap`` apart, so only sessions cut by a
   bucket edge are joined again.

Events without a time are in no session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int = 1800,
             bucket: str = "day") -> DataFrame:
    """One row per session: ``key, session_start, session_last, events``."""
    gap = gap_seconds * 1_000_000
    spans = [F.min("session_start").alias("session_start"), F.max("session_last").alias("session_last"),
             F.sum("events").alias("events")]
    reach = F.concat((_micros(F.col("session_last")) - _micros(F.col("session_start")) + F.lit(gap)).cast("string"),
                     F.lit(" microseconds"))
    window = F.session_window("session_start", reach).alias("__w")
    slots = df.filter(F.col(ts).isNotNull()) \
        .groupBy(key, F.floor(_micros(F.col(ts)) / F.lit(gap)).alias("__slot")) \
        .agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_last"), F.count(F.lit(1)).alias("events"))
    partial = slots.groupBy(key, F.date_trunc(bucket, "session_start").alias("__b"), window).agg(*spans)
    return partial.groupBy(key, window).agg(*spans).drop("__w")


def usage(sessions_df: DataFrame, key: str) -> DataFrame:
    """Per device: span, active and idle time (hours), number of sessions
    (power cycles), start of the last session, last activity."""
    span = _micros(F.max("session_last")) - _micros(F.min("session_start"))
    active = F.sum(_micros(F.col("session_last")) - _micros(F.col("session_start")))
    return sessions_df.groupBy(key).agg(
        (span / F.lit(3.6e9)).alias("total_hours"),
        (active / F.lit(3.6e9)).alias("active_hours"),
        ((span - active) / F.lit(3.6e9)).alias("idle_hours"),
        F.count(F.lit(1)).alias("power_cycles"),
        F.max("session_start").alias("last_activated"),
        F.max("session_last").alias("create_time"))
