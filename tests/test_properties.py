"""Properties from the test strategy: unique upsert keys, cube totals, replay safety."""

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlake.plans.catalogue import queries
from fleetlake.session import scratch_path
from fleetlake.sinks.upsert import KeyedTable, upsert
from fleetlake.sources.incremental import StateStore, SyncSpec, run_sync
from conftest import SF01

rows_st = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 100)), min_size=0, max_size=30)


@settings(max_examples=10, deadline=None)
@given(old=rows_st, new=rows_st)
def test_upsert_keys_unique_and_idempotent(spark, old, new):
    existing = dict(old)          # an existing keyed table holds each key once
    o = spark.createDataFrame([(k, v, 0) for k, v in existing.items()], "k int, v int, seq int")
    n = spark.createDataFrame([(k, v, i + 1) for i, (k, v) in enumerate(new)], "k int, v int, seq int")
    once = upsert(o, n, ["k"], order_by=["seq"])
    keys = [r.k for r in once.collect()]
    assert len(keys) == len(set(keys))
    assert set(keys) == {k for k, _ in old} | {k for k, _ in new}
    twice = upsert(once, n, ["k"], order_by=["seq"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_cube_total_equals_row_count(spark):
    cube = queries()["multi_dim_cube"](spark, SF01)
    total = cube.filter("grouping_level = 3").collect()[0]["events"]
    assert total == spark.read.parquet(f"{SF01}/events.parquet").count()
    per_type = cube.filter("grouping_level = 1").agg(F.sum("events")).collect()[0][0]
    assert per_type == total


def test_crash_between_write_and_commit_replays_harmlessly(spark):
    """The write happens, the state commit does not; the next run reads the
    same batch again and the keyed upsert absorbs it."""
    src = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "user_id", "value")
    table = KeyedTable(spark, scratch_path(spark, "replay"), ["event_id"], buckets=8)
    state = StateStore(spark, scratch_path(spark, "replay_state"))
    spec = SyncSpec("ev", "inc", "event_id", "int", "9000")

    class Crash(RuntimeError):
        pass

    def crash_after_write(b):
        table.upsert(b)
        raise Crash()
    try:
        run_sync(spark, src, spec, crash_after_write, state)
    except Crash:
        pass
    assert state.get("ev", default=None) is None          # nothing committed
    stats = run_sync(spark, src, spec, lambda b: table.upsert(b), state)
    assert stats["batch_rows"] == 999 and state.get("ev") == "9999"
    got = table.read()
    assert got.count() == 999 and got.select("event_id").distinct().count() == 999
