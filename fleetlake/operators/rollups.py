"""Roll-ups (G4-G9, H1, H2).

Every aggregate here is a ``groupBy``/``cube``/``window`` with partial
(map-side) aggregation, so a hot group is combined in each task before the
shuffle and never travels whole.  Sums are exact decimals of the measure's
declared scale (order-independent), returned as double; a measure without a
declared scale is real-valued and summed as it is.

Roll-ups of a growing table are kept as partials (``partials``), one row per
hour, dimensions and bucket of devices, which ``merge`` and ``merge_cube``
combine to any coarser grain: counts, sums and extremes are merged as they
are, and the distinct devices as bitmaps, so they stay exact.
"""

from __future__ import annotations

from typing import Sequence

import datetime as dt
import re
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import exact_sum, known_number, total
from ..sinks.upsert import latest_per_key


def measures(value: str, scale: int | None, prefix: str = "value") -> list[Column]:
    """Rows, and sum, average, minimum and maximum of the known values (NaN
    counts as missing in all four); ``scale`` is the measure's declared number
    of decimals (see ``total``)."""
    known = known_number(value)
    whole = exact_sum(value, scale)
    return [F.count(F.lit(1)).alias("events"), whole.alias(f"{prefix}_sum"),
            (whole / F.count(known)).alias(f"{prefix}_avg"),
            F.min(F.when(known.isNotNull(), F.col(value))).alias(f"{prefix}_min"),
            F.max(F.when(known.isNotNull(), F.col(value))).alias(f"{prefix}_max")]


def time_rollup(df: DataFrame, ts: str, grain: str, dims: Sequence[str], value: str = "value",
                scale: int | None = None, distinct_of: str | None = None) -> DataFrame:
    """Per ``grain`` ('hour', 'day', ...) and dimensions.

    'day' produces a DATE column ``event_date``; finer grains a wall time
    ``bucket_start`` (``date_trunc``).
    """
    if grain == "day":
        key = F.to_date(ts).alias("event_date")
    else:
        key = F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("bucket_start")
    aggs = measures(value, scale)
    if distinct_of:
        aggs.append(F.countDistinct(distinct_of).alias("devices"))
    return df.groupBy(key, *dims).agg(*aggs)


def cube_rollup(df: DataFrame, dims: Sequence[str | Column], value: str = "value",
                scale: int | None = None, fixed: Sequence[str] = ()) -> DataFrame:
    """Every combination of ``dims`` in one pass (``cube`` + ``grouping_id``).

    ``fixed`` columns are grouped in every combination (for example the day
    partition of a layer table), via grouping sets.
    """
    if not fixed:
        return df.cube(*dims).agg(*measures(value, scale), F.grouping_id().alias("grouping_level"))
    return _sets(df, list(dims), fixed).agg(*measures(value, scale), F.grouping_id().alias("grouping_level"))


def _sets(df: DataFrame, names: list[str], fixed: Sequence[str]):
    """Every combination of ``names``, the ``fixed`` columns in each."""
    sets = [[F.col(c) for c in [*fixed, *combo]]
            for r in range(len(names), -1, -1) for combo in combinations(names, r)]
    return df.groupingSets(sets, *[F.col(c) for c in [*fixed, *names]])


#: Columns of a partial besides its time, dimensions and device bucket.
PARTIAL = ["events", "known", "value_sum", "value_min", "value_max", "devices"]


def partials(df: DataFrame, ts: str, dims: Sequence[str], device: str, value: str = "value",
             scale: int | None = None, grain: str = "hour") -> DataFrame:
    """G5/G6 kept incrementally: mergeable measures per ``bucket_start``,
    dimensions and ``device_bucket`` (32,768 device numbers each, so a hot hour
    is many rows and a bitmap at most 4 KB).  ``device`` is a whole number;
    rows without one count as rows but not as devices."""
    known = known_number(value)
    return df.groupBy(F.date_trunc(grain, F.col(ts)).cast("timestamp_ntz").alias("bucket_start"), *dims,
                      F.bitmap_bucket_number(F.col(device)).alias("device_bucket")).agg(
        F.count(F.lit(1)).alias("events"), F.count(known).alias("known"), total(value, scale).alias("value_sum"),
        F.min(F.when(known.isNotNull(), F.col(value))).alias("value_min"),
        F.max(F.when(known.isNotNull(), F.col(value))).alias("value_max"),
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col(device))).alias("devices"))


def _merged() -> list[Column]:
    return [F.sum(c).alias(c) for c in PARTIAL[:3]] + [F.min("value_min").alias("value_min"), F.max("value_max").alias("value_max")]


def _final(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key from rows that are one per key and device bucket."""
    out = buckets.groupBy(*keys).agg(*_merged(), F.sum(F.bitmap_count("devices")).alias("devices"))
    whole = F.col("value_sum").cast("double")
    return out.select(*keys, "events", whole.alias("value_sum"), (whole / F.col("known")).alias("value_avg"),
                      "value_min", "value_max", "devices")


def merge(parts: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Measures and exact devices per ``keys`` (columns of the partials, or
    expressions of them) from partials alone."""
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    buckets = parts.groupBy(*named, "device_bucket").agg(*_merged(), F.bitmap_or_agg("devices").alias("devices"))
    return _final(buckets, buckets.columns[:len(named)])


def merge_cube(parts: DataFrame, dims: Sequence[str]) -> DataFrame:
    """G6 from partials alone: every combination of ``dims`` with its exact
    devices and the grouping level."""
    buckets = _sets(parts, list(dims), ["device_bucket"]).agg(
        *_merged(), F.bitmap_or_agg("devices").alias("devices"), F.grouping_id().alias("grouping_level"))
    return _final(buckets, [*dims, "grouping_level"])


_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def duration(text: str) -> dt.timedelta:
    """``"15 minutes"`` as a time span."""
    found = re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", text.lower())
    if not found or found[2] not in _UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return dt.timedelta(seconds=int(found[1]) * _UNITS[found[2]])


def sliding_rollup(df: DataFrame, ts: str, size: str, slide: str, dims: Sequence[str],
                   value: str = "value", scale: int | None = None) -> DataFrame:
    """H2/J2 (batch twin): windows of ``size`` every ``slide``, start inclusive,
    end exclusive.

    Rows are aggregated once, into panes as long as the slide; a window is the
    sum of its ``size / slide`` panes, so only panes are multiplied and
    shuffled again.  ``size`` must be a multiple of ``slide``."""
    panes_each, rest = divmod(duration(size), duration(slide))
    if rest:
        raise ValueError(f"{size!r} is not a multiple of {slide!r}")
    panes = df.groupBy(F.window(ts, slide).alias("w"), *dims) \
        .agg(F.count(F.lit(1)).alias("events"), total(value, scale).alias("value_sum"))
    back = F.explode(F.array(*[F.col("w.start") - F.expr(f"{i} * interval {slide}") for i in range(panes_each)]))
    return (panes.select(back.alias("window_start"), *dims, "events", "value_sum").groupBy("window_start", *dims)
            .agg(F.sum("events").alias("events"), F.sum("value_sum").cast("double").alias("value_sum"))
            .select("window_start", (F.col("window_start") + F.expr(f"interval {size}")).alias("window_end"),
                    *dims, "events", "value_sum"))


def latest_state(df: DataFrame, key: str, order_by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """H1: the latest row per key (``max_by`` over a struct, combined map-side)."""
    picked = latest_per_key(df.select(key, *cols, *[c for c in order_by if c not in cols]),
                            [key], list(order_by))
    return picked.select(key, *cols)


def status_counts(df: DataFrame, key: str, order_by: Sequence[str], dims: Sequence[str]) -> DataFrame:
    """Current state per device, then devices per state."""
    latest = latest_state(df, key, order_by, dims)
    return latest.groupBy(*dims).agg(F.count(F.lit(1)).alias("devices"))


def batch_volume(df: DataFrame, task: str | Column, id_col: str) -> DataFrame:
    """Rows per task with the id bounds of its batch."""
    return df.groupBy(task).agg(F.count(F.lit(1)).alias("batch_rows"),
                                F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id"))


def delays(df: DataFrame, event_time: str, arrival: str) -> DataFrame:
    """Seconds from event to arrival per event day."""
    late = F.timestamp_diff("SECOND", F.col(event_time), F.col(arrival))
    return df.groupBy(F.to_date(event_time).alias("event_date")).agg(
        F.count(F.lit(1)).alias("volume"), (F.sum(late).cast("double") / F.count(late)).alias("delay_avg"),
        F.min(late).alias("delay_min"), F.max(late).alias("delay_max"))
