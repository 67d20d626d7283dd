"""Watermark reads, state commits and the keyed upsert."""

import datetime as dt
import os

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from fleetlake.sinks.upsert import latest_per_key, upsert
from fleetlake.sources.incremental import (SyncSpec, StateStore, UnsupportedIncrement, batch_stats,
                                           initial_watermark, read_increment, run_sync, updated)


def test_initial_watermarks_c1():
    assert initial_watermark("datetime") == "1970-01-01 08:00:00"
    assert initial_watermark("int") == "0"
    assert initial_watermark("date") == "1970-01-01"
    with pytest.raises(UnsupportedIncrement):
        SyncSpec("x", "inc", "c", "uuid")          # S6: unknown type rejected


def test_reset_c2():
    old = SyncSpec("x", "inc", "c", "int", "500")
    assert updated(old, SyncSpec("x", "inc", "c", "int")).last_watermark == "500"
    assert updated(old, SyncSpec("x", "inc", "c", "datetime")).last_watermark == "1970-01-01 08:00:00"
    full = SyncSpec("x", "full", None, None)
    assert updated(full, SyncSpec("x", "inc", "c", "date")).last_watermark == "1970-01-01"


def test_datetime_bounds(spark):
    rows = [(1, dt.datetime(2024, 1, 10)), (2, dt.datetime(2024, 1, 10, 0, 0, 0, 1)),
            (3, dt.datetime(2024, 1, 20)), (4, dt.datetime(2024, 1, 20, 0, 0, 1))]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    spec = SyncSpec("t", "inc", "ts", "datetime", "2024-01-10 00:00:00")
    got = sorted(r.id for r in read_increment(df, spec, upper="2024-01-20 00:00:00").collect())
    assert got == [2, 3]     # equal to wm excluded, just above kept, at upper kept, above excluded


def test_date_mode_whole_days(spark):
    rows = [(1, dt.datetime(2024, 1, 1, 23)), (2, dt.datetime(2024, 1, 2)),
            (3, dt.datetime(2024, 1, 4, 23, 59)), (4, dt.datetime(2024, 1, 5))]
    df = spark.createDataFrame(rows, "id long, d timestamp_ntz")
    spec = SyncSpec("t", "inc", "d", "date", "2024-01-01")
    assert sorted(r.id for r in read_increment(df, spec, run_day="2024-01-05").collect()) == [2, 3]


def test_empty_batch_keeps_watermark_c6(spark):
    df = spark.createDataFrame([(1,), (2,)], "id long")
    spec = SyncSpec("t", "inc", "id", "int", "5")
    row = batch_stats(read_increment(df, spec), spec).collect()[0]
    assert row.batch_rows == 0 and row.next_watermark == "5"


@settings(max_examples=8, deadline=None)
@given(cuts=st.lists(st.integers(min_value=0, max_value=120), min_size=1, max_size=4))
def test_increments_partition_the_input(spark, cuts):
    """Union of successive increments = full copy, with no overlap."""
    df = spark.range(0, 100).withColumnRenamed("id", "id")
    wm, seen = "0", []
    for upper in sorted(cuts) + [10**6]:
        spec = SyncSpec("p", "inc", "id", "int", wm)
        batch = read_increment(df, spec).filter(F.col("id") <= upper)
        ids = [r.id for r in batch.collect()]
        seen.extend(ids)
        nxt = batch_stats(batch, spec).collect()[0].next_watermark
        wm = nxt
    assert sorted(seen) == [i for i in range(1, 100)]   # ids > 0
    assert len(seen) == len(set(seen))


def test_run_sync_commit_order(spark, tmp_dir):
    df = spark.range(1, 11)
    state = StateStore(spark, f"{tmp_dir}/state")
    spec = SyncSpec("s", "inc", "id", "int")
    written = []
    stats = run_sync(spark, df, spec, lambda b: written.append(b.count()), state)
    assert stats["batch_rows"] == 10 and written == [10] and state.get("s") == "10"
    # a failing gate stops before the write and leaves the state untouched
    df2 = spark.range(1, 16)

    def gate(batch):
        raise RuntimeError("too many bad rows")
    with pytest.raises(RuntimeError):
        run_sync(spark, df2, spec, lambda b: written.append(b.count()), state, gate=gate)
    assert written == [10] and state.get("s") == "10"
    # next good run picks up after 10 only
    stats = run_sync(spark, df2, spec, lambda b: written.append(b.count()), state)
    assert written == [10, 5] and state.get("s") == "15"
    # empty run: nothing written, state untouched
    stats = run_sync(spark, df2, spec, lambda b: written.append(b.count()), state)
    assert stats["batch_rows"] == 0 and written == [10, 5]


def test_upsert_cases(spark):
    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 20, 1), ("c", 30, 1), ("c", 31, 2)], "k string, v int, seq int")
    out = {r.k: r.v for r in upsert(old, new, ["k"], order_by=["seq"]).collect()}
    assert out == {"a": 1, "b": 20, "c": 31}     # existing kept, replaced, last of two wins
    twice = upsert(upsert(old, new, ["k"], ["seq"]), new, ["k"], ["seq"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, upsert(old, new, ["k"], ["seq"]).collect()))


def test_latest_per_key_hot_key(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), F.col("id").alias("seq"))
    got = {r.k: r.seq for r in latest_per_key(df, ["k"], ["seq"]).collect()}
    assert got == {0: 4999, 1: 4998}


def test_state_is_shared_between_applications(tmp_dir):
    """A second application that shares the folder goes on where the first ended."""
    import subprocess
    import sys
    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from fleetlake.sources.incremental import StateStore, SyncSpec, run_sync
spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {tmp_dir!r}).getOrCreate())
seen = []
run_sync(spark, spark.range(1, 11), SyncSpec("t", "inc", "id", "int"), lambda b: seen.append(b.count()), StateStore(spark))
print("COPIED", sum(seen), StateStore(spark).get("t"))
"""
    out = [subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300).stdout
           for _ in range(2)]
    assert ["COPIED 10 10" in out[0], "COPIED 0 10" in out[1]] == [True, True]


def test_state_keeps_the_enabled_flag_and_raises_on_broken_files(spark, tmp_dir):
    state = StateStore(spark, f"{tmp_dir}/state")
    spec = SyncSpec("s", "inc", "id", "int")
    run_sync(spark, spark.range(1, 5), spec, lambda b: b.count(), state)
    state.set_enabled("s", False, "2024-01-01 00:00:00")
    assert not state.enabled("s") and state.get("s") == "4"
    ran = []
    assert run_sync(spark, spark.range(1, 9), spec, lambda b: ran.append(b.count()), state)["batch_rows"] == 0
    assert ran == [] and state.get("s") == "4"
    state.commit(spark.createDataFrame([("s", 1, "6")], "task string, batch_rows long, next_watermark string"), "x")
    assert not state.enabled("s") and state.get("s") == "6"           # a commit keeps the flag
    with open(f"{tmp_dir}/state/part-broken.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        state.get("s")


def test_commit_takes_the_watermark_of_the_rows_written(spark, tmp_dir):
    state, rows = StateStore(spark, f"{tmp_dir}/state"), []
    stats = run_sync(spark, spark.range(1, 8), SyncSpec("w", "inc", "id", "int"),
                     lambda b: rows.extend(r.id for r in b.collect()), state)
    assert max(rows) == 7 and stats["next_watermark"] == "7" and state.get("w") == "7"
