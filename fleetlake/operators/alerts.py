"""Anomalies (Q2, D9) and multi-level threshold alerts (Q3).

Rules are data: a list of (condition, label) pairs becomes a ``when`` chain
(first match wins), and per-type thresholds are a literal table that Spark
joins as its size allows.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import datetime_text
from .sequence import next_match_time


def first_label(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """A rule list as one ``CASE WHEN`` (first matching rule wins)."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default)) if default is not None else out


def anomalies(events: DataFrame, key: str, ts: str, tiebreak: str, is_anomaly: Column,
              severity_rules: Sequence[tuple[Column, str]], anomaly_type: Column,
              description: Column, bucket: str = "hour") -> DataFrame:
    """Q2: one row per anomalous event with the contract columns.

    Resolution = first later non-anomalous event of the same device (see
    ``next_match_time``).  ``alertCount`` = anomalies of the device that share
    that resolution (the episode); counted with a ``groupBy`` and joined back,
    so a long episode is combined map-side rather than held in one window.

    Only (key, ts, tiebreak, flag) of the events goes through the sequence
    step; the anomalies' other columns are joined back by ``tiebreak``, which
    must be unique.
    """
    narrow = events.select(key, ts, tiebreak, F.coalesce(is_anomaly, F.lit(False)).alias("__anom"))
    resolved = next_match_time(narrow, key, ts, tiebreak, ~F.col("__anom"), bucket=bucket, out="__resolved") \
        .filter("__anom").select(F.col(key).alias("__key"), F.col(tiebreak).alias("__id"), "__resolved")
    episodes = resolved.groupBy(F.col("__key").alias("__k"), F.col("__resolved").alias("__r")) \
        .agg(F.count(F.lit(1)).alias("alertCount"))
    counted = resolved.join(episodes, resolved["__key"].eqNullSafe(episodes["__k"])
                            & resolved["__resolved"].eqNullSafe(episodes["__r"])) \
        .select("__id", "__resolved", "alertCount")
    anom = events.filter(is_anomaly)
    joined = anom.join(counted, anom[tiebreak] == counted["__id"])
    return joined.select(
        datetime_text(ts).alias("createTime"),
        F.col(key).cast("string").alias("vin"),
        anomaly_type.alias("anomalyType"),
        first_label(severity_rules).alias("severity"),
        description.alias("description"),
        datetime_text(ts).alias("detectedTime"),
        datetime_text("__resolved").alias("resolvedTime"),
        F.col("__resolved").isNotNull().alias("isResolved"),   # D9
        F.col("alertCount").cast("bigint").alias("alertCount"),
    )


def threshold_table(spark: SparkSession, thresholds: dict[str, tuple[float, float]],
                    key: str = "event_type") -> DataFrame:
    """Per-key (warn, critical) thresholds as a literal table."""
    rows = [(k, float(w), float(c)) for k, (w, c) in thresholds.items()]
    return spark.createDataFrame(rows, f"{key} string, warn double, crit double")


def threshold_alerts(df: DataFrame, value: str, table: DataFrame, key: str = "event_type",
                     default: tuple[float, float] | None = None) -> DataFrame:
    """Q3: ``critical`` when value >= crit, else ``warning`` when >= warn;
    rows below both levels are not alerts.  Keys without a row use ``default``."""
    how = "left" if default is not None else "inner"
    joined = df.join(table, key, how)
    if default is not None:
        joined = joined.withColumn("warn", F.coalesce("warn", F.lit(default[0]))) \
                       .withColumn("crit", F.coalesce("crit", F.lit(default[1])))
    level = F.when(F.col(value) >= F.col("crit"), "critical").when(F.col(value) >= F.col("warn"), "warning")
    threshold = F.when(F.col(value) >= F.col("crit"), F.col("crit")).otherwise(F.col("warn"))
    return (joined.withColumn("level", level).filter(F.col("level").isNotNull())
            .withColumn("threshold", threshold).drop("warn", "crit"))
