"""Streaming twins: the same results as the batch queries, produced by
Structured Streaming over the events file (``availableNow`` trigger)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators.predicates import literal
from ..session import scratch_path
from ..sources.messages import publish
from ..sources.tables import table
from ..streaming import compaction
from ..streaming.anomalies import PAIR, recovery_pairs, resolutions, settled_until
from ..streaming.ingest import file_stream, ingest, ingest_batches, with_day
from ..streaming.metrics import late_rows, run_appending, run_upserting, sliding_metrics, window_table
from . import params as P
from .catalogue import query
from .q_layers import KNOWN_TYPES


def _events_stream(spark, sf_dir):
    """Event files arriving in the table folder (the file source lists a folder
    or a glob, so the single events file is matched by pattern)."""
    schema = table(spark, sf_dir, "events").schema
    return file_stream(spark, f"{sf_dir.rstrip('/')}/events*.parquet", schema)


@query("stream_ingest_ods", "J1", """
SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS dt FROM events
""")
def stream_ingest_ods(spark, sf_dir):
    """Micro-batch ingest of events into a day-partitioned raw table, read back."""
    out = scratch_path(spark, "stream_ods")
    q = ingest(with_day(_events_stream(spark, sf_dir), "ts"), f"{out}/data", f"{out}/_checkpoint",
               partition_by=["dt"], trigger={"availableNow": True})
    q.awaitTermination()
    return spark.read.parquet(f"{out}/data")


@query("stream_sliding_rollup", "J2 J5 J6", """
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type,
       count(*) AS events, CAST(sum(CAST(round(value * 100) AS HUGEINT)) AS DOUBLE) / 100 AS value_sum
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS window_start
      FROM (SELECT *, unnest(generate_series(0, 3)) AS i FROM events) x) y
GROUP BY window_start, event_type
""")
def stream_sliding_rollup(spark, sf_dir):
    """Watermarked sliding windows in update mode, upserted per micro-batch."""
    out = scratch_path(spark, "stream_sliding")
    agg = sliding_metrics(_events_stream(spark, sf_dir), "ts", "1 hour", "15 minutes",
                          ["event_type"], watermark="1 hour", scale=P.VALUE_SCALE)
    target = window_table(spark, f"{out}/table", ["event_type"])
    # One state store per core: each holds an even share of the open windows.
    q = run_upserting(agg, target, f"{out}/_checkpoint", trigger={"availableNow": True},
                      state_partitions=spark.sparkContext.defaultParallelism)
    q.awaitTermination()
    return target.read()


@query("stream_late_rows", "J6 J1", """
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, event_type,
       count(*) AS events, CAST(sum(CAST(round(value * 100) AS HUGEINT)) AS DOUBLE) / 100 AS value_sum
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY GROUP BY ALL
""")
def stream_late_rows(spark, sf_dir):
    """Recent events arrive first, older ones with a second file: the watermark
    (2 days) drops those from the aggregates, although the raw files keep them."""
    out = scratch_path(spark, "stream_late")
    ev = table(spark, sf_dir, "events")
    cut = ev.agg(F.max("ts")).head()[0] - dt.timedelta(days=10)
    recent = F.col("ts") >= literal(cut)
    ev.filter(recent).write.parquet(f"{out}/arriving/first")
    aggregate = None
    for late in (False, True):
        if late:
            ev.filter(~recent).write.parquet(f"{out}/arriving/second")
        stream = file_stream(spark, f"{out}/arriving/*", ev.schema)
        agg = sliding_metrics(stream, "ts", "1 day", "1 day", ["event_type"], watermark="2 days", scale=P.VALUE_SCALE)
        aggregate = window_table(spark, f"{out}/table", ["event_type"])
        run_upserting(agg, aggregate, f"{out}/_checkpoint", trigger={"availableNow": True},
                      state_partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return aggregate.read()


_CLOSED = """date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY"""


@query("stream_closed_windows", "J2 J6", """
SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type,
       count(*) AS events, CAST(sum(CAST(round(value * 100) AS HUGEINT)) AS DOUBLE) / 100 AS value_sum
FROM (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS window_start
      FROM (SELECT *, unnest(generate_series(0, 3)) AS i FROM events) x) y
WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
GROUP BY window_start, event_type
""")
def stream_closed_windows(spark, sf_dir):
    """Sliding windows appended once each, when the watermark has passed them;
    those still open at the end are not there."""
    out = scratch_path(spark, "stream_closed")
    agg = sliding_metrics(_events_stream(spark, sf_dir), "ts", "1 hour", "15 minutes", ["event_type"], watermark="1 hour", scale=P.VALUE_SCALE)
    run_appending(agg, f"{out}/data", f"{out}/_checkpoint", trigger={"availableNow": True},
                  state_partitions=spark.sparkContext.defaultParallelism).awaitTermination()
    return spark.read.schema(agg.schema).parquet(f"{out}/data")


@query("stream_late_side", "J6 J1", f"""
SELECT *, CAST(1 AS BIGINT) AS batch_id FROM events
WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 10 DAY AND {_CLOSED}
""")
def stream_late_side(spark, sf_dir):
    """The rows that ``stream_late_rows`` leaves out: the second file's rows
    whose day had closed before it arrived, from the raw layer."""
    out = scratch_path(spark, "stream_late_side")
    ev = table(spark, sf_dir, "events")
    cut = ev.agg(F.max("ts")).head()[0] - dt.timedelta(days=10)
    recent = F.col("ts") >= literal(cut)
    for name, part in (("first", recent), ("second", ~recent)):
        ev.filter(part).write.parquet(f"{out}/arriving/{name}")
        ingest_batches(file_stream(spark, f"{out}/arriving/*", ev.schema), f"{out}/raw", f"{out}/_checkpoint",
                       trigger={"availableNow": True}).awaitTermination()
    raw = spark.read.schema(ev.schema.add("batch_id", "long")).parquet(f"{out}/raw")
    return late_rows(raw, "ts", "1 day", "1 day", "2 days")


_BOUND, _DELAY = "12 hours", "1 hour"


@query("stream_anomaly_resolution", "Q2 D9", """
WITH settled AS (
  SELECT date_trunc('milliseconds', least(max(ts) FILTER (WHERE event_type = 'error'),
                                          max(ts) FILTER (WHERE event_type <> 'error')) - INTERVAL 1 HOUR) AS until FROM events)
SELECT e.event_id AS anomaly_id, e.user_id AS device, e.ts AS detected, min(o.ts) AS resolved,
       min(o.ts) IS NOT NULL AS is_resolved
FROM events e LEFT JOIN events o
  ON o.user_id = e.user_id AND o.event_type <> 'error' AND o.ts <= e.ts + INTERVAL 12 HOUR
 AND (o.ts > e.ts OR o.ts = e.ts AND o.event_id > e.event_id)
WHERE e.event_type = 'error' AND e.ts + INTERVAL 12 HOUR < (SELECT until FROM settled)
GROUP BY 1, 2, 3
""")
def stream_anomaly_resolution(spark, sf_dir):
    """Errors and their first recovery within 12 hours, by a stream-stream
    left outer join; those without one are there too, once it is certain."""
    out = scratch_path(spark, "stream_anomalies")
    pairs = recovery_pairs(_events_stream(spark, sf_dir), "user_id", "ts", "event_id",
                           F.col("event_type") == "error", _BOUND, _DELAY)
    q = run_appending(pairs, f"{out}/data", f"{out}/_checkpoint", trigger={"availableNow": True},
                      state_partitions=spark.sparkContext.defaultParallelism)
    q.awaitTermination()
    return resolutions(spark.read.schema(pairs.schema).parquet(f"{out}/data").select(*PAIR), _BOUND, settled_until(q))


@query("stream_topics", "J3 B5 K2", """
SELECT event_type AS topic, CAST(user_id AS VARCHAR) AS key,
       CAST(CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 7) AS BIGINT) % 3 AS INTEGER) AS partition,
       '{"event_id":' || event_id
       || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
       || '","user_id":' || user_id
       || ',"event_type":' || to_json(event_type)
       || ',"value":' || CAST(value AS VARCHAR)
       || ',"props":' || to_json(props) || '}' AS value
FROM events
""")
def stream_topics(spark, sf_dir):
    """A topic per event type with three partitions each, written by a stream
    and read back."""
    out = scratch_path(spark, "stream_topics")
    publish(_events_stream(spark, sf_dir), f"{out}/topics", f"{out}/_checkpoint", "user_id", "event_type", KNOWN_TYPES,
            trigger={"availableNow": True}).awaitTermination()
    return spark.read.schema("key string, value string, topic string, partition int").parquet(f"{out}/topics") \
        .select("topic", "key", "partition", "value")


@query("stream_compaction", "B9 J1", """
SELECT *, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS dt FROM events
""")
def stream_compaction(spark, sf_dir):
    """Events arriving in several files, a micro-batch each; the days that
    have closed are rewritten by size, the last day stays as it came."""
    out = scratch_path(spark, "stream_compaction")
    ev = table(spark, sf_dir, "events")
    ev.repartition(4).write.parquet(f"{out}/arriving/all")
    compaction.ingest_days(file_stream(spark, f"{out}/arriving/*", ev.schema, max_files_per_trigger=1), "ts",
                           f"{out}/raw", f"{out}/_checkpoint", trigger={"availableNow": True}).awaitTermination()
    last = ev.agg(F.max(F.to_date("ts"))).head()[0]
    compaction.compact(spark, f"{out}/raw", f"{out}/closed", ev.schema, last)
    return compaction.read(spark, f"{out}/raw", f"{out}/closed", ev.schema).select(*ev.columns, "dt")
