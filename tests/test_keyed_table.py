"""Keyed upsert that rewrites only touched partitions."""

import os

import pytest
from pyspark.sql import functions as F

from fleetlake.session import scratch_path
from fleetlake.sinks.upsert import KeyedTable, upsert
from conftest import SF01


def test_bucketed_upsert_matches_full_upsert(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    old = ev.filter("event_id < 8000").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    new = ev.filter("event_id >= 6000").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    t = KeyedTable(spark, scratch_path(spark, "kt"), ["user_id", "event_type"], buckets=16)
    t.upsert(old)
    t.upsert(new)
    want = sorted(map(tuple, upsert(old, new, ["user_id", "event_type"]).collect()))
    assert sorted(map(tuple, t.read().select(*old.columns).collect())) == want


def _files(t):
    return {f"{d}/{f}" for d, _, names in os.walk(t.data.replace("file:", "")) for f in names if f.endswith(".parquet")}


def test_only_touched_partitions_rewritten_and_replay_skipped(spark):
    t = KeyedTable(spark, scratch_path(spark, "kt2"), ["day", "k"], partition_by="day")
    first = spark.createDataFrame([("2024-01-01", "a", 1), ("2024-01-02", "b", 2)], "day string, k string, v int")
    t.upsert(first, batch_id=0)
    before = _files(t)
    second = spark.createDataFrame([("2024-01-02", "b", 20), ("2024-01-02", "c", 3), ("2024-01-02", "c", 4)],
                                   "day string, k string, v int")
    touched = t.upsert(second, order_by=["v"], batch_id=1)
    assert touched == ["2024-01-02"]
    assert len(before) == 2 and len(before & _files(t)) == 1                       # the other day's file stays
    assert t.read().schema == first.schema
    got = sorted((r.day, r.k, r.v) for r in t.read().collect())
    assert got == [("2024-01-01", "a", 1), ("2024-01-02", "b", 20), ("2024-01-02", "c", 4)]
    assert t.upsert(second, batch_id=1) == [] and t.applied(1) and not t.applied(2)  # replay skipped
    assert t.upsert(first.limit(0), batch_id=2) == []


def test_null_keys_and_null_partitions(spark):
    t = KeyedTable(spark, scratch_path(spark, "kt3"), ["k"], partition_by="day")
    schema = "day string, k string, v int"
    t.upsert(spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("x/y=1", None, 3)], schema))
    assert t.upsert(spark.createDataFrame([(None, "a", 10), ("x/y=1", None, 30)], schema)) == [None, "x/y=1"]
    got = sorted(((r.day, r.k, r.v) for r in t.read().collect()), key=repr)
    assert got == sorted([(None, "a", 10), (None, "b", 2), ("x/y=1", None, 30)], key=repr)


def test_crashes_before_and_after_the_staged_table_is_complete(spark, monkeypatch):
    t = KeyedTable(spark, scratch_path(spark, "kt4"), ["k"], buckets=2)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    t.upsert(rows, batch_id=0)

    def crash(*_):
        raise OSError("lost")
    bad = rows.withColumn("v", F.when(F.col("k") == "b", F.raise_error(F.lit("lost")).cast("int")).otherwise(9))
    with pytest.raises(Exception):
        t.upsert(bad, batch_id=1)
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2)]
    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", crash)
        with pytest.raises(OSError):
            t.upsert(rows.withColumn("v", F.lit(9)), batch_id=1)
    assert sorted(map(tuple, t.read().collect())) == [("a", 1), ("b", 2)]
    again = KeyedTable(spark, t.root, ["k"], buckets=2)
    assert again.upsert(rows.withColumn("v", F.lit(9)), batch_id=1) == []           # what was staged is published
    assert sorted(map(tuple, again.read().collect())) == [("a", 9), ("b", 9)]
    assert not os.path.exists(t.staged.replace("file:", ""))


def test_store_metrics_keeps_the_last_row_of_a_key(spark):
    from fleetlake.plans.metric_store import store_metrics
    t = KeyedTable(spark, scratch_path(spark, "kt6"), ["robot_id"], buckets=2)
    store_metrics(t, spark.createDataFrame([(1, 3), (2, 5), (1, 7), (None, 1), (None, 2)], "ROBOT_ID long, TASK_COUNT long"),
                  "2024-01-01 00:00:00")
    assert sorted(((r.robot_id, r.task_count) for r in t.read().collect()), key=repr) == [(1, 7), (2, 5), (None, 2)]
