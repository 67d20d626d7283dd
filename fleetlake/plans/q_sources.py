"""Scan, copy, watermark and message queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import uuid_text
from ..operators.predicates import open_range, parse_day, where
from ..session import scratch_path
from ..sources.connectors import Source, read_query, read_table, write_table
from ..sources.incremental import SyncSpec, batch_stats, read_increment
from ..sources.messages import append_segments, bounded_log_read, bounded_slice, keyed_json
from ..sources.tables import table
from . import params as P
from .catalogue import query

ID_SPEC = SyncSpec("events_by_id", "inc", "event_id", "int", str(P.ID_WATERMARK))
TIME_SPEC = SyncSpec("events_by_time", "inc", "ts", "datetime", P.TIME_WATERMARK)
DATE_SPEC = SyncSpec("orders_by_day", "inc", "o_orderdate", "date", P.DATE_WATERMARK)


@query("incremental_id_scan", "A1 A3", f"""
SELECT * FROM events WHERE event_id > {P.ID_WATERMARK}
""")
def incremental_id_scan(spark, sf_dir):
    """Rows after the id watermark (``c > wm``, no upper bound)."""
    return read_increment(table(spark, sf_dir, "events"), ID_SPEC)


@query("incremental_datetime_scan", "A4", f"""
SELECT * FROM events
WHERE ts > TIMESTAMP '{P.TIME_WATERMARK}' AND ts <= TIMESTAMP '{P.TIME_UPPER}'
""")
def incremental_datetime_scan(spark, sf_dir):
    """``wm < ts <= upper``: half-open below, closed above."""
    return read_increment(table(spark, sf_dir, "events"), TIME_SPEC, upper=P.TIME_UPPER)


@query("incremental_date_scan", "A5 K11", f"""
SELECT * FROM orders
WHERE CAST(o_orderdate AS DATE) > DATE '{P.DATE_WATERMARK}'
  AND CAST(o_orderdate AS DATE) <= DATE '{P.DATE_RUN_DAY}' - INTERVAL 1 DAY
""")
def incremental_date_scan(spark, sf_dir):
    """Whole days after the date watermark up to the day before the run day."""
    return read_increment(table(spark, sf_dir, "orders"), DATE_SPEC, run_day=P.DATE_RUN_DAY)


@query("full_copy", "A2 B1", """
SELECT * FROM customer
""")
def full_copy(spark, sf_dir):
    """Copy ``customer`` in full to a fresh target folder and read it back."""
    target = Source("files", path=scratch_path(spark, "full_copy"))
    src = Source("files", path=sf_dir)
    df = read_table(spark, src, "customer.parquet")
    write_table(df, target, "customer", mode="append")
    return read_table(spark, target, "customer")


@query("bounded_offset_read", "A7", f"""
SELECT * FROM events WHERE event_id > {P.OFFSET_START}
ORDER BY event_id LIMIT {P.OFFSET_MAX}
""")
def bounded_offset_read(spark, sf_dir):
    """At most 1,000 records after offset 99 (the id is the log offset)."""
    return bounded_slice(table(spark, sf_dir, "events"), "event_id", P.OFFSET_START, P.OFFSET_MAX)


@query("next_watermark", "C3 C4 C6 G2", f"""
SELECT 'events_by_id' AS task, 'int' AS inc_column_type, count(*) AS batch_rows,
       COALESCE(CAST(max(event_id) AS VARCHAR), '{P.ID_WATERMARK}') AS next_watermark
FROM events WHERE event_id > {P.ID_WATERMARK}
UNION ALL
SELECT 'events_by_time', 'datetime', count(*), '{P.TIME_UPPER}'
FROM events WHERE ts > TIMESTAMP '{P.TIME_WATERMARK}' AND ts <= TIMESTAMP '{P.TIME_UPPER}'
UNION ALL
SELECT 'orders_by_day', 'date', count(*),
       CAST(DATE '{P.DATE_RUN_DAY}' - INTERVAL 1 DAY AS DATE)::VARCHAR
FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '{P.DATE_WATERMARK}'
  AND CAST(o_orderdate AS DATE) <= DATE '{P.DATE_RUN_DAY}' - INTERVAL 1 DAY
""")
def next_watermark(spark, sf_dir):
    """One row per sync: batch size and the watermark to commit after the write."""
    ev = table(spark, sf_dir, "events")
    orders = table(spark, sf_dir, "orders")
    a = batch_stats(read_increment(ev, ID_SPEC), ID_SPEC)
    b = batch_stats(read_increment(ev, TIME_SPEC, upper=P.TIME_UPPER), TIME_SPEC, upper=P.TIME_UPPER)
    c = batch_stats(read_increment(orders, DATE_SPEC, run_day=P.DATE_RUN_DAY), DATE_SPEC,
                    run_day=P.DATE_RUN_DAY)
    return a.unionByName(b).unionByName(c)


@query("to_keyed_json", "B5 K2 K8 J3", """
SELECT event_type AS topic, CAST(user_id AS VARCHAR) AS key,
       CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 7) AS BIGINT) % 12 AS INTEGER) AS partition,
       '{"event_id":' || event_id
       || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
       || '","user_id":' || user_id
       || ',"event_type":' || to_json(event_type)
       || ',"value":' || CAST(value AS VARCHAR)
       || ',"props":' || to_json(props) || '}' AS value
FROM events
""")
def to_keyed_json(spark, sf_dir):
    """One message per event: topic = event type, key = device, value = row
    JSON, partition by key."""
    ev = table(spark, sf_dir, "events")
    return keyed_json(ev, "user_id", topic=F.col("event_type"), partitions=12)


@query("bounded_log_read", "A7", f"""
SELECT * FROM events WHERE event_id > {P.OFFSET_START} AND event_id % 5 <> 3
ORDER BY event_id LIMIT {P.OFFSET_MAX}
""")
def bounded_log(spark, sf_dir):
    """At most 1,000 records after offset 99 of a log with gaps, kept in
    segments: only the segments that hold them are read."""
    root = scratch_path(spark, "event_log")
    append_segments(table(spark, sf_dir, "events").where(F.col("event_id") % 5 != 3), root, "event_id", P.SEGMENT)
    return bounded_log_read(spark, root, "event_id", P.OFFSET_START, P.OFFSET_MAX)


@query("query_text_read", "A1 E8", f"""
SELECT c_mktsegment, n_name, count(*) AS orders, max(o_orderdate) AS last_order
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus = 'F' AND n_name <> 'FRANCE' GROUP BY c_mktsegment, n_name
""")
def query_text_read(spark, sf_dir):
    """A configured query text run by the source; a later filter is added
    around it."""
    text = ("SELECT c_mktsegment, n_name, count(*) AS orders, max(o_orderdate) AS last_order FROM {orders} "
            "JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey "
            "WHERE o_orderstatus = 'F' GROUP BY c_mktsegment, n_name")
    return read_query(spark, Source("files", path=sf_dir), text).where(F.col("n_name") != "FRANCE")


@query("iso_range", "K3 K4 E3", """
SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-09 22:30:00'
""")
def iso_range(spark, sf_dir):
    """Events between a day and an ISO time with an offset, both as text."""
    start, end = parse_day(P.EVENT_START), parse_day("2024-01-10T06:30:00+08:00")
    return where(table(spark, sf_dir, "events"), open_range("ts", start, end))


@query("plain_identifiers", "K7", """
SELECT event_id, substr(md5(props), 1, 8) || '-' || substr(md5(props), 9, 4) || '-' || substr(md5(props), 13, 4) || '-'
       || substr(md5(props), 17, 4) || '-' || substr(md5(props), 21, 12) AS identifier,
       substr(md5(props), 1, 6) AS short FROM events
""")
def plain_identifiers(spark, sf_dir):
    """Binary identifiers as plain text: 16 bytes as a UUID, others as hex."""
    raw = F.unhex(F.md5("props"))
    return table(spark, sf_dir, "events").select("event_id", uuid_text(raw).alias("identifier"),
                                                 uuid_text(F.substring(raw, 1, 3)).alias("short"))
