"""Streaming twins: output = batch result, restart adds nothing, late rows dropped."""

import datetime as dt
import tempfile

from fleetlake.operators.rollups import sliding_rollup
from fleetlake.streaming.ingest import file_stream, ingest, ingest_batches, with_day
from fleetlake.streaming.metrics import late_rows, run_appending, run_upserting, sliding_metrics, window_table

SCHEMA = "id long, ts timestamp_ntz, kind string, value double"


def _write(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_equals_batch_and_restart_is_idempotent(spark):
    src = tempfile.mkdtemp(prefix="fl-src-")
    out = tempfile.mkdtemp(prefix="fl-out-")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=7 * i), "a" if i % 3 else "b", float(i % 11) + 0.25)
            for i in range(200)]
    _write(spark, src, rows[:100], "part1")
    schema = spark.createDataFrame([], SCHEMA).schema

    def run():
        s = file_stream(spark, f"{src}/*", schema)
        agg = sliding_metrics(s, "ts", "1 hour", "15 minutes", ["kind"], watermark="1 day")
        table = window_table(spark, f"{out}/table", ["kind"])
        q = run_upserting(agg, table, f"{out}/ckpt", trigger={"availableNow": True})
        q.awaitTermination()
        return table

    run()
    _write(spark, src, rows[100:], "part2")
    table = run()                      # restart from the checkpoint, new file only
    first = _rows(table.read())
    table = run()                      # nothing new: same result
    assert _rows(table.read()) == first
    assert table.applied(0)
    # a replayed batch id is skipped by the sink
    replay = spark.createDataFrame([(t0, t0, "zz", 1, 1.0)], table.read().schema)
    assert table.upsert(replay, batch_id=0) == []
    assert _rows(table.read()) == first
    batch = sliding_rollup(spark.createDataFrame(rows, SCHEMA), "ts", "1 hour", "15 minutes", ["kind"])
    assert first == _rows(batch)


def test_late_row_dropped_from_aggregate_kept_in_raw(spark):
    src = tempfile.mkdtemp(prefix="fl-src-")
    out = tempfile.mkdtemp(prefix="fl-out-")
    t0 = dt.datetime(2024, 1, 1)
    schema = spark.createDataFrame([], SCHEMA).schema
    _write(spark, src, [(1, t0, "a", 1.0), (2, t0 + dt.timedelta(hours=5), "a", 2.0)], "p1")
    late = [(3, t0 + dt.timedelta(minutes=5), "a", 4.0)]       # 5 h behind the max seen

    def run_agg():
        s = file_stream(spark, f"{src}/*", schema, max_files_per_trigger=1)
        agg = sliding_metrics(s, "ts", "1 hour", "1 hour", ["kind"], watermark="10 minutes")
        table = window_table(spark, f"{out}/table", ["kind"])
        q = run_upserting(agg, table, f"{out}/ckpt", trigger={"availableNow": True})
        q.awaitTermination()
        return table

    run_agg()
    _write(spark, src, late, "p2")
    table = run_agg()
    got = {(r.window_start, r.kind): r.events for r in table.read().collect()}
    assert got[(t0, "a")] == 1            # the late row did not reach the aggregate

    raw = tempfile.mkdtemp(prefix="fl-raw-")
    s = file_stream(spark, f"{src}/*", schema)
    q = ingest(with_day(s, "ts"), f"{raw}/data", f"{raw}/ckpt", partition_by=["dt"],
               trigger={"availableNow": True})
    q.awaitTermination()
    assert spark.read.parquet(f"{raw}/data").count() == 3     # but it is in the raw layer


def test_closed_windows_are_appended_once_and_late_rows_are_found(spark):
    src, out = tempfile.mkdtemp(prefix="fl-src-"), tempfile.mkdtemp(prefix="fl-out-")
    t0 = dt.datetime(2024, 1, 1)
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = [(i, t0 + dt.timedelta(minutes=11 * i), "a" if i % 3 else "b", i % 7 + 0.5) for i in range(100)]
    late = [(1000 + i, t0 + dt.timedelta(minutes=7 * i), "a", 1.0) for i in range(20)]
    edge = t0 + dt.timedelta(minutes=11 * 99)
    parts = [("p1", rows), ("p2", late + [(2000, edge + dt.timedelta(hours=8), "a", 2.0)]), ("p3", [])]
    seen = []
    for name, part in parts:
        if part:
            _write(spark, src, part, name)
        s = file_stream(spark, f"{src}/*", schema)
        run_appending(sliding_metrics(s, "ts", "1 hour", "15 minutes", ["kind"], watermark="2 hours"), f"{out}/windows",
                      f"{out}/ckpt", trigger={"availableNow": True}, state_partitions=3).awaitTermination()
        ingest_batches(s, f"{out}/raw", f"{out}/ckpt2", trigger={"availableNow": True}).awaitTermination()
        seen.append(_rows(spark.read.parquet(f"{out}/windows")))
    last = edge + dt.timedelta(hours=8)
    batch = sliding_rollup(spark.createDataFrame(rows, SCHEMA), "ts", "1 hour", "15 minutes", ["kind"])
    want = [[r for r in _rows(batch) if r[1] <= top - dt.timedelta(hours=2)] for top in (edge, last)]
    assert seen == [want[0], want[1], want[1]]
    raw = spark.read.parquet(f"{out}/raw")
    assert raw.count() == 121
    found = late_rows(raw, "ts", "1 hour", "15 minutes", "2 hours")
    # The last quarter hour of a late row's windows had ended an hour after its start.
    closed = {i for i, t, _, _ in late if t - (t - t0) % dt.timedelta(minutes=15) + dt.timedelta(hours=1) <= edge - dt.timedelta(hours=2)}
    assert {r.id for r in found.collect()} == closed == set(range(1000, 1020))


def test_late_rows_of_one_batch_are_spread(spark):
    """Joined by a shuffle, all rows of a micro-batch were read by one task."""
    t0, key = dt.datetime(2024, 1, 1), "spark.sql.autoBroadcastJoinThreshold"
    rows = [(i, t0 + dt.timedelta(hours=i), 0) for i in range(48)] + [(100 + i, t0 + dt.timedelta(hours=i), 1) for i in range(48)]
    raw = spark.createDataFrame(rows, "id long, ts timestamp_ntz, batch_id long")
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        found = late_rows(raw, "ts", "1 hour", "1 hour", "2 hours")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        # The first batch ended at hour 47: what ended by hour 45 is late.
        assert sorted(r.id for r in found.collect()) == list(range(100, 145))
    finally:
        spark.conf.set(key, before)
