"""Layer queries: device documents (ODS -> DWD), quality, roll-ups (ADS), retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import percent_value
from ..operators.quality import ErrorLimitExceeded, Rule, error_summary, flag_rules, limited_write
from ..operators.predicates import time_literal
from ..operators.rollups import batch_volume as volume, cube_rollup, merge, merge_cube, sliding_rollup as sliding
from ..operators.rollups import status_counts, time_rollup
from ..sinks.writers import overwrite_partitions, with_hooks
from ..sources.documents import (STATUSES, alerts_long, field, flatten, flatten_variants, metrics_long, read_variants,
                                 readable, variant_metrics)
from ..sources.tables import table
from . import params as P
from .catalogue import query
from ..session import scratch_path
from .layers import Layers, retention
from .standins import order_documents, props_k

KNOWN_TYPES = ["click", "error", "purchase", "signup", "view"]

DOC_SQL = """
WITH li AS (
  SELECT l_orderkey, CAST(count(*) AS DOUBLE) AS lines, max(l_quantity) AS max_quantity,
         min(l_extendedprice) AS min_price, max(l_discount) AS max_discount,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned
  FROM lineitem GROUP BY l_orderkey),
d AS (
  SELECT o_orderkey AS doc_id, c_name AS device_id, date_trunc('second', o_orderdate) AS event_time,
         o_orderpriority AS device_type, o_orderstatus AS status, n_name AS district, c_mktsegment AS street,
         CAST(round(max_discount * 100) AS INTEGER) AS battery_pct, o_totalprice, li.*
  FROM orders LEFT JOIN li ON o_orderkey = l_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)
"""


@query("device_doc_flatten", "A8 D10 K10", DOC_SQL + """
SELECT doc_id, device_id, event_time, device_type, status, district, street, battery_pct,
       CASE WHEN lines IS NULL THEN 1 ELSE 4 END AS n_metrics, CAST(coalesce(n_returned, 0) AS INTEGER) AS n_alerts
FROM d
""")
def device_doc_flatten(spark, sf_dir):
    """Nested device documents flattened to one detail row each."""
    return flatten(order_documents(spark, sf_dir)).drop("ip_address", "latitude", "longitude")


@query("metrics_long", "D10 K9", DOC_SQL + """
SELECT doc_id, device_id, device_type, 'total_price' AS metric, o_totalprice AS metric_value FROM d
UNION ALL SELECT doc_id, device_id, device_type, 'lines', lines FROM d WHERE lines IS NOT NULL
UNION ALL SELECT doc_id, device_id, device_type, 'max_quantity', max_quantity FROM d WHERE lines IS NOT NULL
UNION ALL SELECT doc_id, device_id, device_type, 'min_price', min_price FROM d WHERE lines IS NOT NULL
""")
def metrics_long_q(spark, sf_dir):
    """The metrics map exploded to long form."""
    return metrics_long(order_documents(spark, sf_dir))


@query("alerts_explode", "D10", """
SELECT o_orderkey AS doc_id, c_name AS device_id, l_partkey || '-' || l_suppkey || '-' || l_linenumber AS alert_id,
       l_linestatus AS severity, 'returned ' || CAST(trunc(l_quantity) AS BIGINT) AS message,
       date_trunc('second', l_shipdate) AS alert_time
FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
WHERE l_returnflag = 'R'
""")
def alerts_explode(spark, sf_dir):
    """One row per alert of the documents that carry alerts."""
    return alerts_long(order_documents(spark, sf_dir))


@query("percent_parse", "K10", """
SELECT l_orderkey, l_linenumber, l_discount, CAST(round(l_discount * 100) AS INTEGER) || '%' AS discount_text,
       CAST(round(l_discount * 100) AS INTEGER) AS discount_pct,
       CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(round(l_tax * 100) AS INTEGER) END AS tax_pct
FROM lineitem
""")
def percent_parse(spark, sf_dir):
    """Percent text (``"55%"``) to a number; anything else to null."""
    li = table(spark, sf_dir, "lineitem")

    def percent(c):
        return F.concat(F.round(F.col(c) * 100).cast("int").cast("string"), F.lit("%"))

    tax = F.when(F.col("l_returnflag") == "R", F.lit("n/a%")).otherwise(percent("l_tax"))
    return li.select("l_orderkey", "l_linenumber", "l_discount", percent("l_discount").alias("discount_text"),
                     tax.alias("tax_text")) \
        .select("l_orderkey", "l_linenumber", "l_discount", "discount_text",
                percent_value("discount_text").alias("discount_pct"), percent_value("tax_text").alias("tax_pct"))


def event_rules():
    return [Rule("value_min", F.col("value") >= F.lit(P.MIN_VALUE)),
            Rule("k_parsable", props_k().isNotNull()),
            Rule("known_type", F.col("event_type").isin(KNOWN_TYPES))]


_DQ_FLAGS = f"""
WITH f AS (
  SELECT event_id,
         COALESCE(value >= {P.MIN_VALUE}, false) AS value_min,
         COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL, false) AS k_parsable,
         COALESCE(event_type IN ('click', 'error', 'purchase', 'signup', 'view'), false) AS known_type
  FROM events)
"""


@query("dq_split", "Q1", _DQ_FLAGS + """
SELECT event_id, value_min, k_parsable, known_type,
       value_min AND k_parsable AND known_type AS dq_pass,
       concat_ws(',', CASE WHEN NOT value_min THEN 'value_min' END,
                      CASE WHEN NOT k_parsable THEN 'k_parsable' END,
                      CASE WHEN NOT known_type THEN 'known_type' END) AS dq_failed_rules
FROM f
""")
def dq_split(spark, sf_dir):
    """Rule flags, pass flag and failed rule names per event."""
    ev = table(spark, sf_dir, "events")
    return flag_rules(ev, event_rules(), keep=["event_id"])


@query("error_limit_check", "B7", f"""
SELECT count(*) AS total_rows,
       count(*) FILTER (WHERE NOT (value >= {P.MIN_VALUE})
                           OR TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL
                           OR value IS NULL) AS bad_rows,
       bad_rows / total_rows AS bad_ratio,
       CAST({P.ERROR_LIMIT_RECORDS} AS BIGINT) AS record_limit,
       CAST({P.ERROR_LIMIT_RATIO} AS DOUBLE) AS ratio_limit,
       bad_rows <= {P.ERROR_LIMIT_RECORDS} AND bad_rows / total_rows <= {P.ERROR_LIMIT_RATIO} AS passed
FROM events
""")
def error_limit_check(spark, sf_dir):
    """Bad-record count and ratio against the copy job's limits (0 records, 2 %)."""
    ev = table(spark, sf_dir, "events")
    bad = ~(F.col("value") >= F.lit(P.MIN_VALUE)) | props_k().isNull()
    return error_summary(ev, bad, P.ERROR_LIMIT_RECORDS, P.ERROR_LIMIT_RATIO)


@query("batch_volume", "G4", """
SELECT event_type, count(*) AS batch_rows, min(event_id) AS first_id, max(event_id) AS last_id
FROM events GROUP BY event_type
""")
def batch_volume(spark, sf_dir):
    """Rows per task (one task per event type) with the batch's id bounds."""
    return volume(table(spark, sf_dir, "events"), "event_type", "event_id")


_MEASURES_SQL = """count(*) AS events,
       CAST(sum(CAST(round(value * 100) AS HUGEINT)) AS DOUBLE) / 100 AS value_sum,
       CAST(sum(CAST(round(value * 100) AS HUGEINT)) AS DOUBLE) / 100 / count(value) AS value_avg,
       min(value) AS value_min, max(value) AS value_max"""


@query("hourly_rollup", "G5", f"""
SELECT date_trunc('hour', ts) AS bucket_start, event_type, {_MEASURES_SQL}
FROM events GROUP BY 1, 2
""")
def hourly_rollup(spark, sf_dir):
    return time_rollup(table(spark, sf_dir, "events"), "ts", "hour", ["event_type"], scale=P.VALUE_SCALE)


@query("daily_rollup", "G5", f"""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS event_date, event_type, {_MEASURES_SQL},
       count(DISTINCT user_id) AS devices
FROM events GROUP BY 1, 2
""")
def daily_rollup(spark, sf_dir):
    return time_rollup(table(spark, sf_dir, "events"), "ts", "day", ["event_type"], scale=P.VALUE_SCALE,
                       distinct_of="user_id")


@query("multi_dim_cube", "G6", f"""
SELECT event_type, event_date, {_MEASURES_SQL},
       CAST(GROUPING(event_type, event_date) AS BIGINT) AS grouping_level
FROM (SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS event_date FROM events) e
GROUP BY CUBE (event_type, event_date)
""")
def multi_dim_cube(spark, sf_dir):
    """Every combination of event type and day, with the grouping level."""
    ev = table(spark, sf_dir, "events").withColumn("event_date", F.to_date("ts"))
    return cube_rollup(ev, ["event_type", "event_date"], scale=P.VALUE_SCALE)


def _kept_partials(spark, sf_dir):
    """The hourly partials after two increments: the first days, then the
    last ones with the day between them once more."""
    ev = table(spark, sf_dir, "events")
    lay = Layers(spark, scratch_path(spark, "partials"))
    for days in (F.col("ts") < time_literal(P.UPSERT_OLD_BEFORE), F.col("ts") >= time_literal(P.UPSERT_NEW_FROM)):
        lay.ads_partials(ev.filter(days), "ts", ["event_type"], "user_id", scale=P.VALUE_SCALE)
    return lay.read("ads", "hourly_partials")


@query("daily_from_hours", "G5 B9", f"""
SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS event_date, event_type, {_MEASURES_SQL},
       count(DISTINCT user_id) AS devices
FROM events GROUP BY 1, 2
""")
def daily_from_hours(spark, sf_dir):
    """The daily roll-up with exact devices from hourly partials kept in two
    increments; the events are not scanned again."""
    return merge(_kept_partials(spark, sf_dir), [F.to_date("bucket_start").alias("event_date"), "event_type"])


@query("cube_from_hours", "G6 B9", f"""
SELECT event_type, event_date, {_MEASURES_SQL}, count(DISTINCT user_id) AS devices,
       CAST(GROUPING(event_type, event_date) AS BIGINT) AS grouping_level
FROM (SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS event_date FROM events) e
GROUP BY CUBE (event_type, event_date)
""")
def cube_from_hours(spark, sf_dir):
    """The cube with exact devices in every combination, from the same
    partials."""
    parts = _kept_partials(spark, sf_dir).withColumn("event_date", F.to_date("bucket_start"))
    return merge_cube(parts, ["event_type", "event_date"])


@query("sliding_rollup", "H2 J2", """
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type,
       count(*) AS events, CAST(sum(CAST(round(value * 100) AS HUGEINT)) AS DOUBLE) / 100 AS value_sum
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS window_start
      FROM (SELECT *, unnest(generate_series(0, 3)) AS i FROM events) x) y
GROUP BY window_start, event_type
""")
def sliding_rollup(spark, sf_dir):
    """One-hour windows sliding every 15 minutes, per event type."""
    return sliding(table(spark, sf_dir, "events"), "ts", "1 hour", "15 minutes", ["event_type"], scale=P.VALUE_SCALE)


@query("device_status_count", "G7 H1", """
WITH latest AS (
  SELECT * FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT event_type AS device_type,
       (['online', 'offline', 'fault', 'maintenance'])[TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 + 1]
         AS status,
       count(*) AS devices
FROM latest GROUP BY 1, 2
""")
def device_status_count(spark, sf_dir):
    """Current state per device (its latest event), then devices per type and status."""
    ev = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (props_k() % 4).cast("int") + 1)
    ev = ev.select("user_id", "ts", "event_id", F.col("event_type").alias("device_type"),
                   status.alias("status"))
    return status_counts(ev, "user_id", ["ts", "event_id"], ["device_type", "status"])


@query("retention_filter", "B9", f"""
SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS dt FROM events
WHERE CAST(ts AS DATE) >= DATE '{P.RETENTION_RUN_DAY}' - INTERVAL {P.RETENTION_DAYS} DAY
""")
def retention_filter(spark, sf_dir):
    """Detail rows kept by a 10-day retention ending at the run day."""
    ev = table(spark, sf_dir, "events").withColumn("dt", F.to_date("ts"))
    return retention(ev, "dt", P.RETENTION_RUN_DAY, P.RETENTION_DAYS, ts="ts")


@query("ads_daily_layers", "B9 D10 Q1 G5 A8", DOC_SQL + """
SELECT CAST(CAST(event_time AS DATE) AS TIMESTAMP) AS event_date, device_type, count(*) AS events,
       CAST(sum(battery_pct) AS DOUBLE) AS value_sum, CAST(sum(battery_pct) AS DOUBLE) / count(battery_pct) AS value_avg,
       min(battery_pct) AS value_min, max(battery_pct) AS value_max, count(DISTINCT device_id) AS devices
FROM d WHERE status IS NOT NULL AND battery_pct IS NOT NULL GROUP BY 1, 2
""")
def ads_daily_layers(spark, sf_dir):
    """ODS documents -> DWD detail (quality-split) -> ADS daily roll-up, each a
    day-partitioned table in the shared folder; returns the ADS table.  The
    documents arrive in two batches that share days, one of them sent twice."""
    lay = Layers(spark, scratch_path(spark, "layers"), grain="year")     # few orders a day
    docs = order_documents(spark, sf_dir)
    done = F.col("status") == "F"
    lay.ods_documents(docs.filter(done), "finished")
    for _ in range(2):
        lay.ods_documents(docs.filter(~F.coalesce(done, F.lit(False))), "open")
    lay.dwd_devices(device_rules())
    lay.ads_rollups(value="battery_pct", scale=0, tables=("daily",))
    return lay.read("ads", "daily").drop("dt")


def device_rules():
    """DWD quality rules on flattened device rows."""
    return [Rule("known_status", F.col("status").isNotNull()),
            Rule("time_ok", F.col("event_time").isNotNull()),
            Rule("battery_ok", F.col("battery_pct").isNotNull())]


_UNREADABLE = 97                     # every such document arrives cut off


def _json_documents(spark, sf_dir):
    """The device documents as JSON lines in files, some cut off in the middle."""
    docs = order_documents(spark, sf_dir).drop("dt")
    text = F.to_json(F.struct(*docs.columns))
    path = scratch_path(spark, "json_documents")
    docs.select(F.when(F.col("doc_id") % _UNREADABLE == 0, F.substring(text, 1, 60)).otherwise(text).alias("value")) \
        .write.text(path)
    return read_variants(spark, path)


@query("json_documents", "A8 D10 K9 K10", DOC_SQL + f"""
SELECT doc_id, device_id, event_time, device_type, status, district, street, battery_pct,
       CASE WHEN lines IS NULL THEN 1 ELSE 4 END AS n_metrics, CAST(coalesce(n_returned, 0) AS INTEGER) AS n_alerts
FROM d WHERE doc_id % {_UNREADABLE} <> 0
""")
def json_documents(spark, sf_dir):
    """JSON documents read as VARIANT and flattened, unreadable ones left out."""
    return flatten_variants(_json_documents(spark, sf_dir)).drop("ip_address", "latitude", "longitude")


@query("json_metrics", "A8 D10 K9", DOC_SQL + f""", m AS (
SELECT doc_id, device_id, device_type, 'total_price' AS metric, o_totalprice AS metric_value FROM d
UNION ALL SELECT doc_id, device_id, device_type, 'lines', lines FROM d WHERE lines IS NOT NULL
UNION ALL SELECT doc_id, device_id, device_type, 'max_quantity', max_quantity FROM d WHERE lines IS NOT NULL
UNION ALL SELECT doc_id, device_id, device_type, 'min_price', min_price FROM d WHERE lines IS NOT NULL)
SELECT * FROM m WHERE doc_id % {_UNREADABLE} <> 0
""")
def json_metrics(spark, sf_dir):
    """Every key of the documents' metrics objects as a row."""
    return variant_metrics(_json_documents(spark, sf_dir))


@query("json_rejects", "A8 Q1 B7", f"""
SELECT count(*) AS documents, count(*) FILTER (WHERE o_orderkey % {_UNREADABLE} = 0) AS unreadable,
       CAST(coalesce(sum(CASE WHEN o_orderkey % {_UNREADABLE} = 0 THEN 60 END), 0) AS BIGINT) AS unreadable_chars
FROM orders
""")
def json_rejects(spark, sf_dir):
    """How many texts are no JSON document, and how long they are."""
    docs = _json_documents(spark, sf_dir)
    bad = ~readable(docs)
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(bad).alias("unreadable"),
                    F.coalesce(F.sum(F.when(bad, F.length("value"))), F.lit(0)).cast("long").alias("unreadable_chars"))


@query("props_variant", "K9", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       json_extract_string(props, '$.missing') AS missing FROM events
""")
def props_variant(spark, sf_dir):
    """Fields of the events' JSON text through VARIANT."""
    ev = table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("doc"))
    return ev.select("event_id", field("$.k", "int").alias("k"), field("$.missing", "string").alias("missing"))


@query("limited_publish", "B7 B1", f"""
WITH c AS (SELECT count(*) AS total_rows, count(*) FILTER (WHERE NOT (value >= {P.MIN_VALUE}) OR value IS NULL) AS low_rows,
                  count(*) FILTER (WHERE event_type = 'error') AS error_rows FROM events)
SELECT 'low values' AS load, total_rows, low_rows AS bad_rows, true AS passed, total_rows AS published FROM c
UNION ALL SELECT 'errors', total_rows, error_rows, false, 0 FROM c
""")
def limited_publish(spark, sf_dir):
    """Two loads of the events under the limit of 2 % bad rows, each counted
    while it is staged: one is published, the other refused."""
    out = scratch_path(spark, "limited_publish")
    ev = table(spark, sf_dir, "events")
    loads = {"low values": ~(F.col("value") >= F.lit(P.MIN_VALUE)), "errors": F.col("event_type") == "error"}
    log = []
    for n, (name, bad) in enumerate(loads.items()):
        target, published = f"{out}/target{n}", 0
        try:
            summary = limited_write(ev, bad, f"{out}/staged{n}", lambda rows: rows.write.parquet(target),
                                    record_limit=1 << 62, ratio_limit=P.ERROR_LIMIT_RATIO)
            published = spark.read.parquet(target).count()
        except ErrorLimitExceeded as refused:
            summary = refused.summary
        log.append((name, summary["total_rows"], summary["bad_rows"], summary["passed"], published))
    return spark.createDataFrame(log, "load string, total_rows long, bad_rows long, passed boolean, published long")


@query("day_replace", "B2 B9", f"""
SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS dt FROM events
WHERE NOT (CAST(ts AS DATE) = DATE '{P.EVENT_START}' AND event_type = 'error')
""")
def day_replace(spark, sf_dir):
    """A day deleted and inserted again between hooks: the day's partition is
    overwritten by its corrected rows (no errors), all others stay."""
    path = f"{scratch_path(spark, 'day_replace')}/events"
    ev = table(spark, sf_dir, "events").withColumn("dt", F.to_date("ts"))
    ev.write.partitionBy("dt").parquet(path)
    day = F.col("dt") == F.lit(P.EVENT_START).cast("date")
    corrected = ev.where(day & (F.col("event_type") != "error"))
    steps = []
    with_hooks(corrected, lambda rows: overwrite_partitions(rows, path, ["dt"]),
               before=[lambda: steps.append("before")], after=[lambda: steps.append("after")])
    return spark.read.schema(ev.schema).parquet(path).select(*ev.columns)
