"""Metric-table queries: keyed upsert, range query, suffix typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import datetime_text, exact_sum, narrow_decimal, seconds_exact
from ..operators.predicates import time_literal
from ..operators.projection import cast_by_suffix
from ..session import scratch_path
from ..sinks.upsert import KeyedTable, stamp, upsert
from ..sources.tables import table
from . import params as P
from .catalogue import query
from .metric_store import get_metrics

KEYS = ["user_id", "event_type"]


def metric_batch(ev, run_ts):
    """Metric rows of one batch: one per (device, event type), stamped."""
    agg = ev.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.sum(F.col("value").cast("decimal(38,2)")).alias("total_value"),
        F.max("ts").alias("last_event_time"))
    # K6: the store keeps plain floats.
    return stamp(agg.withColumn("total_value", narrow_decimal("total_value")), run_ts)


_BATCH_SQL = """
SELECT user_id, event_type, count(*) AS event_count,
       CAST(sum(CAST(round(value * 100) AS HUGEINT)) AS DOUBLE) / 100 AS total_value,
       max(ts) AS last_event_time, '{stamp}' AS created_at
FROM events WHERE {where} GROUP BY user_id, event_type
"""


@query("metric_upsert", "B3 B4 H1 K6 F6", f"""
WITH o AS ({_BATCH_SQL.format(stamp=P.OLD_STAMP, where=f"ts < TIMESTAMP '{P.UPSERT_OLD_BEFORE}'")}),
     n AS ({_BATCH_SQL.format(stamp=P.NEW_STAMP, where=f"ts >= TIMESTAMP '{P.UPSERT_NEW_FROM}'")})
SELECT * FROM n
UNION ALL
SELECT * FROM o WHERE NOT EXISTS
  (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)
""")
def metric_upsert(spark, sf_dir):
    """Old metric table (events before Jan 20) upserted with a new batch
    (events from Jan 15): overlapping keys take the new row."""
    ev = table(spark, sf_dir, "events")
    old = metric_batch(ev.filter(F.col("ts") < time_literal(P.UPSERT_OLD_BEFORE)), P.OLD_STAMP)
    new = metric_batch(ev.filter(F.col("ts") >= time_literal(P.UPSERT_NEW_FROM)), P.NEW_STAMP)
    return upsert(old, new, KEYS)


@query("metric_table_upsert", "B3 B4 K6 F6", f"""
WITH o AS ({_BATCH_SQL.format(stamp=P.OLD_STAMP, where=f"ts < TIMESTAMP '{P.UPSERT_OLD_BEFORE}'")}),
     n AS ({_BATCH_SQL.format(stamp=P.NEW_STAMP, where=f"ts >= TIMESTAMP '{P.UPSERT_NEW_FROM}'")})
SELECT * FROM n
UNION ALL
SELECT * FROM o WHERE NOT EXISTS
  (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)
""")
def metric_table_upsert(spark, sf_dir):
    """The same two batches written into a keyed metric table (hash-bucketed
    by key; each upsert rewrites only the buckets its batch touches)."""
    ev = table(spark, sf_dir, "events")
    t = KeyedTable(spark, scratch_path(spark, "metric_table"), KEYS, buckets=16)
    old = metric_batch(ev.filter(F.col("ts") < time_literal(P.UPSERT_OLD_BEFORE)), P.OLD_STAMP)
    t.upsert(old.withColumn("__seq", F.lit(1)))
    new = metric_batch(ev.filter(F.col("ts") >= time_literal(P.UPSERT_NEW_FROM)), P.NEW_STAMP)
    # A key several times in a batch: an unfinished row, replaced by the later one.
    t.upsert(new.withColumn("event_count", F.lit(0).cast("long")).withColumn("__seq", F.lit(0))
             .unionByName(new.withColumn("__seq", F.lit(1))), order_by=["__seq"])
    return t.read().drop("__seq")


@query("metric_range_query", "D5 E8 A9 E2", f"""
SELECT ts, user_id, event_type, value FROM events
WHERE ts >= TIMESTAMP '{P.EVENT_START} 00:00:00' AND ts <= TIMESTAMP '{P.EVENT_END} 00:00:00'
  AND event_type = 'purchase'
""")
def metric_range_query(spark, sf_dir):
    """Keys + default metric over a closed time range with dimensions given as
    a
    JSON list of objects (a null value is skipped), through the metric endpoint call."""
    return get_metrics(table(spark, sf_dir, "events"), P.EVENT_START, P.EVENT_END,
                       dimensions='[{"EVENT_TYPE": "purchase"}, {"user_id": null}]',
                       key_columns=["ts", "user_id", "event_type"],
                       value_columns=["value", "props"], timestamp_column="ts")


@query("infer_metric_types", "D6 D3 B4", f"""
SELECT user_id, event_type, count(*) AS event_count,
       CAST(sum(CAST(round(value * 100) AS HUGEINT)) AS DOUBLE) / 100 / count(*) AS avg_value,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS active_duration,
       strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen,
       '{P.NEW_STAMP}' AS created_at
FROM events GROUP BY user_id, event_type
""")
def infer_metric_types(spark, sf_dir):
    """Metric rows arriving as text under configured upper-case names, typed by
    name suffix (``*_ID``/``*_COUNT`` long, ``AVG_*``/``*_DURATION`` double)."""
    ev = table(spark, sf_dir, "events")
    raw = ev.groupBy("user_id", "event_type").agg(
        F.count(F.lit(1)).cast("string").alias("EVENT_COUNT"),
        (exact_sum("value", 2) / F.count(F.lit(1))).cast("string").alias("AVG_VALUE"),
        seconds_exact(F.min("ts"), F.max("ts")).cast("string").alias("ACTIVE_DURATION"),
        datetime_text(F.max("ts")).alias("LAST_SEEN"))
    raw = raw.select(F.col("user_id").cast("string").alias("USER_ID"),
                     F.col("event_type").alias("EVENT_TYPE"),
                     "EVENT_COUNT", "AVG_VALUE", "ACTIVE_DURATION", "LAST_SEEN")
    return stamp(cast_by_suffix(raw), P.NEW_STAMP)
