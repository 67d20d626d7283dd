"""Indicator, paging, totals and task statistics queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.paging import page as page_rows, seek_page as seek_rows
from ..operators.predicates import closed_range, point_lookup as lookup
from ..operators.sessions import sessions, usage
from ..sources.tables import table
from ..session import scratch_path
from . import params as P
from .api import export_indicator_data
from .catalogue import query
from .indicators import (INDICATORS, TASK_SOURCES, IndicatorQuery, export_rows, export_summary,
                         indicator, project, total)
from .standins import event_view, task_view

EVENT_Q = IndicatorQuery("robot_event", P.EVENT_START, P.EVENT_END, vin=P.EVENT_VIN)


@query("indicator_event", "E1 E2 D8 I1 K1", f"""
SELECT CAST(user_id AS VARCHAR) AS vin, event_type AS eventType,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS eventTime, props AS description,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS recordTime
FROM events
WHERE CAST(user_id AS VARCHAR) = '{P.EVENT_VIN}'
  AND ts >= TIMESTAMP '{P.EVENT_START} 00:00:00' AND ts <= TIMESTAMP '{P.EVENT_END} 00:00:00'
""")
def indicator_event(spark, sf_dir):
    """Event indicator of one device over a closed day range (end at midnight)."""
    return indicator(event_view(spark, sf_dir), EVENT_Q)


@query("indicator_total", "G1 S3", f"""
SELECT count(*) AS total FROM events
WHERE CAST(user_id AS VARCHAR) = '{P.EVENT_VIN}'
  AND ts >= TIMESTAMP '{P.EVENT_START} 00:00:00' AND ts <= TIMESTAMP '{P.EVENT_END} 00:00:00'
""")
def indicator_total(spark, sf_dir):
    return total(event_view(spark, sf_dir), EVENT_Q)


TASK_SQL_BASE = """
WITH ends AS (SELECT l_orderkey, max(l_shipdate) AS end_ts FROM lineitem GROUP BY l_orderkey),
tasks AS (
  SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS vin, o_orderpriority AS task_type,
         o_orderstatus AS status, o_orderdate AS start_ts, e.end_ts,
         CAST(epoch(e.end_ts) - epoch(o_orderdate) AS BIGINT) AS dur
  FROM orders o LEFT JOIN ends e ON o.o_orderkey = e.l_orderkey)
"""


@query("indicator_task", "K12 D8 E2 S8", TASK_SQL_BASE + f"""
SELECT vin, task_type AS taskType, status AS taskStatus,
       strftime(start_ts, '%Y-%m-%d %H:%M:%S') AS startTime,
       strftime(end_ts, '%Y-%m-%d %H:%M:%S') AS endTime, dur AS duration
FROM tasks
WHERE start_ts >= TIMESTAMP '{P.TASK_START} 00:00:00' AND start_ts <= TIMESTAMP '{P.TASK_END} 00:00:00'
""")
def indicator_task(spark, sf_dir):
    """Task indicator: start-time range, duration in seconds (negative kept, null
    when the order has no lines)."""
    q = IndicatorQuery("robot_task", P.TASK_START, P.TASK_END)
    return indicator(task_view(spark, sf_dir), q, sources=TASK_SOURCES)


@query("task_stats", "G8 K12", TASK_SQL_BASE + """
SELECT vin, task_type AS taskType, count(*) AS tasks, count(dur) AS finished,
       CAST(sum(dur) AS BIGINT) AS total_duration,
       CAST(sum(dur) AS DOUBLE) / count(dur) AS avg_duration,
       min(dur) AS min_duration, max(dur) AS max_duration
FROM tasks GROUP BY vin, task_type
""")
def task_stats(spark, sf_dir):
    """Per device and task type: count, finished count, duration sum/avg/min/max."""
    t = task_view(spark, sf_dir)
    return (t.groupBy(F.col("vin").cast("string").alias("vin"), F.col("task_type").alias("taskType"))
            .agg(F.count(F.lit(1)).alias("tasks"),
                 F.count("task_usage_time").alias("finished"),
                 F.sum("task_usage_time").alias("total_duration"),
                 F.min("task_usage_time").alias("min_duration"),
                 F.max("task_usage_time").alias("max_duration"))
            .withColumn("avg_duration",
                        F.col("total_duration").cast("double") / F.col("finished")))


@query("page", "I1 I2 S2", f"""
SELECT event_id, ts, user_id, event_type, value FROM events
ORDER BY ts, event_id LIMIT {P.PAGE_SIZE} OFFSET {(P.PAGE_NO - 1) * P.PAGE_SIZE}
""")
def page(spark, sf_dir):
    """Page 3 of 20 rows in (ts, event_id) order."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return page_rows(ev, ["ts", "event_id"], P.PAGE_NO, P.PAGE_SIZE)


_EXPORT_SQL = f"""
SELECT CAST(user_id AS VARCHAR) AS "Device ID", event_type AS "Event type",
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS "Event time", props AS "Description",
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS "Record time"
FROM events
WHERE ts >= TIMESTAMP '{P.EXPORT_START} 00:00:00' AND ts <= TIMESTAMP '{P.EXPORT_END} 00:00:00'
"""
EXPORT_Q = IndicatorQuery("robot_event", P.EXPORT_START, P.EXPORT_END)


@query("export_labelled", "D4 I3 B6", _EXPORT_SQL)
def export_labelled(spark, sf_dir):
    """Export: every row of the event indicator in range, columns named by label."""
    return export_rows(event_view(spark, sf_dir), EXPORT_Q)


@query("export_limited", "D4 I3", _EXPORT_SQL + f"ORDER BY ts, event_id LIMIT {P.EXPORT_LIMIT}")
def export_limited(spark, sf_dir):
    """The same export with a limit that the caller states."""
    return export_rows(event_view(spark, sf_dir), EXPORT_Q, limit=P.EXPORT_LIMIT)


@query("export_truncated", "I3 G1", f"""
SELECT count(*) AS matching, least(count(*), {P.EXPORT_LIMIT}) AS exported,
       count(*) > {P.EXPORT_LIMIT} AS truncated
FROM events
WHERE ts >= TIMESTAMP '{P.EXPORT_START} 00:00:00' AND ts <= TIMESTAMP '{P.EXPORT_END} 00:00:00'
""")
def export_truncated(spark, sf_dir):
    """What the limit of the export left out, for its caller to see."""
    return export_summary(event_view(spark, sf_dir), EXPORT_Q, P.EXPORT_LIMIT)


@query("export_csv", "B6 D4 S12", _EXPORT_SQL)
def export_csv_read_back(spark, sf_dir):
    """The export written as CSV and read back."""
    path, _ = export_indicator_data(event_view(spark, sf_dir), P.EXPORT_START, P.EXPORT_END, "robot_event",
                                    scratch_path(spark, "export"))
    return spark.read.option("header", True).option("escape", '"').csv(path)


SEEK_AFTER = ("2024-01-15 00:00:00", 0)


@query("seek_page", "I1 I2", f"""
SELECT event_id, ts, user_id, event_type, value FROM events
WHERE ts > TIMESTAMP '{SEEK_AFTER[0]}' OR (ts = TIMESTAMP '{SEEK_AFTER[0]}' AND event_id > {SEEK_AFTER[1]})
ORDER BY ts, event_id LIMIT {P.PAGE_SIZE}
""")
def seek_page(spark, sf_dir):
    """Key-set page: the 20 rows after a (ts, event_id) key the client holds."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    after = (dt.datetime.fromisoformat(SEEK_AFTER[0]), SEEK_AFTER[1])
    return seek_rows(ev, ["ts", "event_id"], after, P.PAGE_SIZE)


@query("point_lookup", "E11 I4", """
SELECT * FROM orders WHERE o_orderkey = 1234
""")
def point_lookup(spark, sf_dir):
    """One task row by id (the caller raises when it is missing)."""
    return lookup(table(spark, sf_dir, "orders"), "o_orderkey", 1234)


USAGE_SOURCES = {"createTime": "create_time", "vin": "vin", "totalHours": "total_hours",
                 "activeHours": "active_hours", "idleHours": "idle_hours",
                 "powerCycles": "power_cycles", "lastActivated": "last_activated"}


@query("indicator_usage", "D8 S10", f"""
WITH e AS (SELECT user_id, ts FROM events
           WHERE ts >= TIMESTAMP '{P.EXPORT_START} 00:00:00' AND ts <= TIMESTAMP '{P.EXPORT_END} 00:00:00'),
g AS (SELECT user_id, ts,
             CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                    OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE
                  THEN 1 ELSE 0 END AS new_s FROM e),
s AS (SELECT user_id, ts, sum(new_s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid
      FROM g),
ss AS (SELECT user_id, sid, min(ts) AS st, max(ts) AS la FROM s GROUP BY user_id, sid)
SELECT strftime(max(la), '%Y-%m-%d %H:%M:%S') AS createTime, CAST(user_id AS VARCHAR) AS vin,
       (epoch_us(max(la)) - epoch_us(min(st))) / 3.6e9 AS totalHours,
       sum(epoch_us(la) - epoch_us(st)) / 3.6e9 AS activeHours,
       ((epoch_us(max(la)) - epoch_us(min(st))) - sum(epoch_us(la) - epoch_us(st))) / 3.6e9 AS idleHours,
       count(*) AS powerCycles,
       strftime(max(st), '%Y-%m-%d %H:%M:%S') AS lastActivated
FROM ss GROUP BY user_id
""")
def indicator_usage(spark, sf_dir):
    """Usage indicator from real rows: activity sessions (gaps of at most 30
    minutes) per device."""
    ev = table(spark, sf_dir, "events").filter(closed_range("ts", P.EXPORT_START, P.EXPORT_END))
    per_device = usage(sessions(ev.select("user_id", "ts"), "user_id", "ts", 1800), "user_id")
    per_device = per_device.withColumn("vin", F.col("user_id").cast("string"))
    return project(INDICATORS["robot_usage"], per_device, USAGE_SOURCES)
