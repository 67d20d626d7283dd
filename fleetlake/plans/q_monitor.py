"""Monitoring queries: anomalies with resolution, threshold alerts, ingest health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import seconds_exact
from ..operators.alerts import anomalies, first_label, threshold_alerts as alerts
from ..operators.alerts import threshold_table
from ..operators.rollups import delays
from ..sources.tables import table
from . import params as P
from .catalogue import query
from .standins import props_k

# Anomaly severity bands on the event value, anomaly kinds by
# the event's code ``k``, and per-type (warning, critical) thresholds.
SEVERITY_BANDS = [(100.0, "critical"), (30.0, "major")]
ANOMALY_KINDS = [(25, "sensor_fault"), (50, "comm_loss"), (75, "power_fault")]
OTHER_KIND = "overheat"
THRESHOLDS = {"click": (100.0, 200.0), "view": (100.0, 200.0),
              "purchase": (80.0, 150.0), "signup": (120.0, 250.0)}
DEFAULT_THRESHOLD = (60.0, 120.0)


@query("anomaly_resolution", "Q2 D9", """
WITH err AS (
  SELECT e.*,
         (SELECT min(x.ts) FROM events x
          WHERE x.user_id = e.user_id AND x.event_type <> 'error'
            AND (x.ts > e.ts OR (x.ts = e.ts AND x.event_id > e.event_id))) AS resolved_ts
  FROM events e WHERE e.event_type = 'error')
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS createTime, CAST(user_id AS VARCHAR) AS vin,
       CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) < 25 THEN 'sensor_fault'
            WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) < 50 THEN 'comm_loss'
            WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) < 75 THEN 'power_fault'
            ELSE 'overheat' END AS anomalyType,
       CASE WHEN value >= 100.0 THEN 'critical' WHEN value >= 30.0 THEN 'major' ELSE 'minor' END
         AS severity,
       props AS description,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS detectedTime,
       strftime(resolved_ts, '%Y-%m-%d %H:%M:%S') AS resolvedTime,
       resolved_ts IS NOT NULL AS isResolved,
       count(*) OVER (PARTITION BY user_id, resolved_ts) AS alertCount
FROM err
""")
def anomaly_resolution(spark, sf_dir):
    """Each error event as an anomaly, resolved by the device's next non-error event."""
    ev = table(spark, sf_dir, "events")
    k = props_k()
    severity = [(F.col("value") >= F.lit(t), label) for t, label in SEVERITY_BANDS]
    severity.append((F.lit(True), "minor"))
    kind = first_label([(k < F.lit(t), label) for t, label in ANOMALY_KINDS], default=OTHER_KIND)
    return anomalies(ev, "user_id", "ts", "event_id", F.col("event_type") == "error",
                     severity, kind, F.col("props"), bucket="hour")


@query("threshold_alerts", "Q3", """
WITH t(event_type, warn, crit) AS (VALUES ('click', 100.0, 200.0), ('view', 100.0, 200.0),
                                          ('purchase', 80.0, 150.0), ('signup', 120.0, 250.0)),
j AS (SELECT e.event_id, e.user_id, e.event_type, e.value,
             COALESCE(CAST(t.warn AS DOUBLE), 60.0) AS warn, COALESCE(CAST(t.crit AS DOUBLE), 120.0) AS crit
      FROM events e LEFT JOIN t ON e.event_type = t.event_type)
SELECT event_id, user_id, event_type, value,
       CASE WHEN value >= crit THEN 'critical' ELSE 'warning' END AS level,
       CASE WHEN value >= crit THEN crit ELSE warn END AS threshold
FROM j WHERE value >= warn
""")
def threshold_alerts(spark, sf_dir):
    """Warning / critical levels per event type; below both levels no alert."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return alerts(ev, "value", threshold_table(spark, THRESHOLDS), default=DEFAULT_THRESHOLD)


@query("ingest_health", "G9", f"""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS event_date, count(*) AS volume,
       count(*) FILTER (WHERE event_type = 'error') AS error_events,
       count(*) FILTER (WHERE event_type = 'error') / count(*) AS error_rate,
       count(*) FILTER (WHERE NOT (value >= {P.MIN_VALUE})
                           OR TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL
                           OR value IS NULL) AS bad_rows,
       count(*) FILTER (WHERE NOT (value >= {P.MIN_VALUE})
                           OR TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL
                           OR value IS NULL) / count(*) AS bad_rate,
       max(ts) AS last_event_time,
       (epoch_us(CAST(CAST(ts AS DATE) + INTERVAL 1 DAY AS TIMESTAMP)) - epoch_us(max(ts))) / 1e6
         AS lag_seconds
FROM events GROUP BY CAST(ts AS DATE)
""")
def ingest_health(spark, sf_dir):
    """Per day: volume, error and bad-row rates, last event and its lag to day end."""
    ev = table(spark, sf_dir, "events")
    bad = ~(F.col("value") >= F.lit(P.MIN_VALUE)) | props_k().isNull()
    day = F.to_date("ts").alias("event_date")
    agg = ev.groupBy(day).agg(
        F.count(F.lit(1)).alias("volume"),
        F.count_if(F.col("event_type") == "error").alias("error_events"),
        F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_rows"),
        F.max("ts").alias("last_event_time"))
    day_end = F.date_add("event_date", 1).cast("timestamp_ntz")
    return agg.select(
        "event_date", "volume", "error_events",
        (F.col("error_events") / F.col("volume")).alias("error_rate"),
        "bad_rows", (F.col("bad_rows") / F.col("volume")).alias("bad_rate"),
        "last_event_time", seconds_exact("last_event_time", day_end).alias("lag_seconds"))


@query("ingest_delay", "G9", """
SELECT CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS event_date, count(*) AS volume,
       CAST(sum(epoch(l_shipdate) - epoch(o_orderdate)) AS DOUBLE) / count(*) AS delay_avg,
       CAST(min(epoch(l_shipdate) - epoch(o_orderdate)) AS BIGINT) AS delay_min,
       CAST(max(epoch(l_shipdate) - epoch(o_orderdate)) AS BIGINT) AS delay_max
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def ingest_delay(spark, sf_dir):
    """Delay between a record's event time and its arrival, per event day: a
    line's order date and ship date."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    rows = li.join(orders, li.l_orderkey == orders.o_orderkey)
    return delays(rows, "o_orderdate", "l_shipdate")
