"""Sync runs end to end: one definition as scheduled batches and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.predicates import time_literal
from ..session import scratch_path
from ..sinks.upsert import KeyedTable
from ..sources.incremental import StateStore, SyncSpec, run_stream_sync, run_sync, updated
from ..sources.tables import table
from ..streaming.ingest import read_for
from . import params as P
from .catalogue import query


@query("sync_two_ways", "J4 C1 C3 C4 C5 A4", """
SELECT 'batch' AS mode, * FROM events UNION ALL SELECT 'stream' AS mode, * FROM events
""")
def sync_two_ways(spark, sf_dir):
    """Events arrive in two files; after each, one definition runs as a
    scheduled batch (state store) and as a stream (checkpoint), both through
    the same keyed writer.  Both targets equal the full copy."""
    out = scratch_path(spark, "sync_two_ways")
    ev = table(spark, sf_dir, "events")
    spec = SyncSpec("events", "inc", "ts", "datetime")
    state = StateStore(spark, f"{out}/state")
    targets = {mode: KeyedTable(spark, f"{out}/{mode}", ["event_id"], buckets=8) for mode in ("batch", "stream")}
    early = F.col("ts") < time_literal(P.UPSERT_OLD_BEFORE)
    for name, part, upper in (("first", early, P.UPSERT_OLD_BEFORE), ("second", ~early, P.NEW_STAMP)):
        ev.where(part).write.parquet(f"{out}/arriving/{name}")
        run_sync(spark, read_for(spark, "scheduled", f"{out}/arriving/*", ev.schema), spec, targets["batch"].upsert,
                 state, upper=upper)
        run_stream_sync(read_for(spark, "continuous", f"{out}/arriving/*", ev.schema), spec, targets["stream"].upsert,
                        f"{out}/_checkpoint", trigger={"availableNow": True}).awaitTermination()
    batch, stream = (targets[m].read().select(F.lit(m).alias("mode"), *ev.columns) for m in targets)
    return batch.unionByName(stream)


@query("sync_states", "C1 C2 C3 C4 C5 C6 A3 A5", f"""
SELECT * FROM (VALUES
  (1, 'seeded', 'int', 0, NULL), (2, 'first run', 'int', (SELECT count(*) FROM orders WHERE o_orderkey <= 20000 AND o_orderkey > 0),
   (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders WHERE o_orderkey <= 20000)),
  (3, 'nothing new', 'int', 0, (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders WHERE o_orderkey <= 20000)),
  (4, 'the rest', 'int', (SELECT count(*) FROM orders WHERE o_orderkey > 20000), (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders)),
  (5, 'disabled', 'int', 0, (SELECT CAST(max(o_orderkey) AS VARCHAR) FROM orders)),
  (6, 'by day', 'date', (SELECT count(*) FROM orders WHERE o_orderdate < DATE '{P.DATE_RUN_DAY}' AND o_orderdate >= DATE '1970-01-02'),
   CAST(DATE '{P.DATE_RUN_DAY}' - INTERVAL 1 DAY AS DATE)::VARCHAR)
) AS t(step, run, inc_column_type, batch_rows, last_watermark)
""")
def sync_states(spark, sf_dir):
    """What each of several runs of a sync read, and the watermark its state
    has afterwards: seed, advance, empty and disabled runs, and the reset when
    the increment column changes its type."""
    out = scratch_path(spark, "sync_states")
    orders = table(spark, sf_dir, "orders")
    some = orders.where(F.col("o_orderkey") <= 20000)
    state = StateStore(spark, f"{out}/state")
    spec = SyncSpec("orders", "inc", "o_orderkey", "int")
    target = KeyedTable(spark, f"{out}/target", ["o_orderkey"], buckets=8)
    log = [(1, "seeded", "int", 0, state.get("orders", default=None))]

    def run(name, source, spec, **bounds):
        stats = run_sync(spark, source, spec, target.upsert, state, **bounds)
        log.append((len(log) + 1, name, spec.inc_column_type, stats["batch_rows"], state.get("orders")))

    run("first run", some, spec)
    run("nothing new", some, spec)
    run("the rest", orders, spec)
    state.set_enabled("orders", False, P.RUN_DAY)
    run("disabled", orders, spec)
    state.set_enabled("orders", True, P.RUN_DAY)
    by_day = updated(spec, SyncSpec("orders", "inc", "o_orderdate", "date"))
    state.reset(by_day, P.RUN_DAY)
    run("by day", orders, by_day, run_day=P.DATE_RUN_DAY)
    return spark.createDataFrame(log, "step int, run string, inc_column_type string, batch_rows long, last_watermark string")
