"""Anomalies and their recoveries in a stream.

Each anomalous event is joined with the later normal events of its device
within a time bound: a stream-stream left outer join, whose state both
watermarks bound, because a pair can only meet within ``bound`` and the delay.
An anomaly without a match comes out once, with nulls, when the watermark has
passed its bound.  Pairs are appended to an exactly-once file sink;
``resolutions`` reduces them to the first recovery of each anomaly.

State and pairs grow with the normal events of a device inside one bound, so
the bound is to be a small multiple of the time between events.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.predicates import literal

#: Columns of a pair: the anomaly's id, device and time, and the recovery's time.
PAIR = ("anomaly_id", "device", "detected", "recovered")


def recovery_pairs(events: DataFrame, key: str, ts: str, tiebreak: str, is_anomaly: Column,
                   bound: str, watermark: str) -> DataFrame:
    """Q2 on a stream (or, for the same rows, on a table): each anomaly with
    every normal event of its device that is later, by (``ts``, ``tiebreak``),
    and at most ``bound`` after it."""
    flag = F.coalesce(is_anomaly, F.lit(False))

    def side(which: Column, *names: str) -> DataFrame:
        rows = events.where(which).select(F.col(tiebreak).alias(names[0]), F.col(key).alias(names[1]),
                                          F.col(ts).cast("timestamp").alias(names[2]))
        return rows.withWatermark(names[2], watermark)

    bad = side(flag, "anomaly_id", "device", "detected_at")
    good = side(~flag, "good_id", "good_device", "good_at")
    later = (F.col("device") == F.col("good_device")) & (F.col("good_at") >= F.col("detected_at")) \
        & (F.col("good_at") <= F.col("detected_at") + F.expr(f"interval {bound}")) \
        & ((F.col("good_at") > F.col("detected_at")) | (F.col("good_id") > F.col("anomaly_id")))
    return bad.join(good, later, "left_outer").select(
        "anomaly_id", "device", F.col("detected_at").cast("timestamp_ntz").alias("detected"),
        F.col("good_at").cast("timestamp_ntz").alias("recovered"))


def settled_until(query: StreamingQuery) -> dt.datetime | None:
    """The watermark of a query's last micro-batch as a wall time in UTC."""
    times = [p["eventTime"].get("watermark") for p in query.recentProgress if p["eventTime"]]
    return max((dt.datetime.fromisoformat(t).replace(tzinfo=None) for t in times if t), default=None)


def resolutions(pairs: DataFrame, bound: str, until: dt.datetime | None = None) -> DataFrame:
    """One row per anomaly: its first recovery within the bound, if any.  With
    ``until``, the anomalies whose bound had ended before: they are final."""
    if until is not None:
        pairs = pairs.where(F.col("detected") + F.expr(f"interval {bound}") < literal(until))
    return pairs.groupBy("anomaly_id", "device", "detected").agg(F.min("recovered").alias("resolved")) \
        .withColumn("is_resolved", F.col("resolved").isNotNull())
