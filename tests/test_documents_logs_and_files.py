"""VARIANT documents, staged writes under a limit, segmented logs, topics, compaction."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from fleetlake.operators.quality import ErrorLimitExceeded, limited_write
from fleetlake.sources.documents import (flatten_variants, read_variants, unreadable, variant_alerts, variant_metrics)
from fleetlake.sources.messages import append_segments, bounded_log_read, publish, segments_for
from fleetlake.streaming import compaction
from fleetlake.streaming.ingest import file_stream

DOCS = [
    '{"doc_id": 1, "device_id": "CAM-1", "timestamp": "2024-01-01 10:00:00", "device_type": "camera", "status": "online", '
    '"location": {"district": "north", "latitude": 1.5}, "metrics": {"frame_rate": 25, "uptime": 3.5, "codec": "h264"}, '
    '"streaming_quality": "hd", "battery_level": "80%"}',
    '{"doc_id": 2, "device_id": "ENV-2", "timestamp": "2024-01-01T11:00:00", "metrics": {"pm25": 12}, "alerts": '
    '[{"alert_id": "a", "severity": "high", "message": "m", "timestamp": "2024-01-01 11:00:01"}, {"alert_id": "b"}, 7]}',
    '{"doc_id": "x", "device_id": 9, "timestamp": "never", "location": "nowhere", "metrics": [1], "alerts": {}}',
    '{}', '[1, 2]', '"text"', 'null', '{"doc_id": 3', '', 'no json',
]


def test_variants_keep_what_can_be_read(spark, tmp_dir):
    with open(f"{tmp_dir}/docs.json", "w") as f:
        f.write("\n".join(DOCS) + "\n")
    docs = read_variants(spark, f"{tmp_dir}/docs.json")
    assert docs.count() == 10
    assert sorted(r.value for r in unreadable(docs).collect()) == sorted(DOCS[4:])
    flat = flatten_variants(docs).collect()
    assert len(flat) == 4
    one, two = (next(r for r in flat if r.doc_id == i) for i in (1, 2))
    assert (one.district, one.street, one.latitude, one.battery_pct, one.n_metrics, one.n_alerts) == ("north", None, 1.5, 80, 3, 0)
    assert (two.event_time, two.district, two.n_metrics, two.n_alerts) == (dt.datetime(2024, 1, 1, 11), None, 1, 3)
    odd = next(r for r in flat if r.device_id == "9")
    assert (odd.doc_id, odd.event_time, odd.district, odd.n_metrics, odd.n_alerts) == (None, None, None, 0, 0)
    got = {(r.device_id, r.metric): r.metric_value for r in variant_metrics(docs).collect() if r.doc_id}
    assert got == {("CAM-1", "frame_rate"): 25, ("CAM-1", "uptime"): 3.5, ("CAM-1", "codec"): None, ("ENV-2", "pm25"): 12}
    alerts = [(r.alert_id, r.severity, r.alert_time) for r in variant_alerts(docs).collect() if r.doc_id == 2]
    assert sorted(alerts, key=repr) == sorted([("a", "high", dt.datetime(2024, 1, 1, 11, 0, 1)), ("b", None, None), (None,) * 3], key=repr)


def test_limit_is_checked_in_the_write_that_stages(spark, tmp_dir):
    rows = spark.range(1000).withColumn("v", F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id")))
    published = []
    summary = limited_write(rows, F.col("v") < 0, f"{tmp_dir}/a", lambda r: published.append(r.count()), record_limit=10)
    assert (summary["total_rows"], summary["bad_rows"], summary["passed"], published) == (1000, 10, True, [1000])
    with pytest.raises(ErrorLimitExceeded) as refused:
        limited_write(rows, F.col("v") < 0, f"{tmp_dir}/b", lambda r: published.append(r.count()), record_limit=9)
    assert refused.value.summary["bad_rows"] == 10 and published == [1000]
    assert spark.read.parquet(f"{tmp_dir}/b").count() == 1000                  # kept for inspection
    empty = limited_write(rows.limit(0), F.col("v") < 0, f"{tmp_dir}/c", lambda r: published.append(r.count()))
    assert empty["passed"] and published == [1000, 0]


def test_bounded_reads_open_only_their_segments(spark, tmp_dir):
    offsets = [o for o in range(3000) if o % 7 and not 1000 <= o < 1900]       # gaps, one of whole segments
    rows = spark.createDataFrame([(o, f"m{o}") for o in offsets], "offset long, value string")
    append_segments(rows.where("offset < 2000"), tmp_dir, "offset", 100)
    append_segments(rows.where("offset >= 1900"), tmp_dir, "offset", 100)      # one segment once more
    for start, limit in ((None, 5), (None, 10_000), (0, 100), (99, 85), (950, 60), (985, 200), (2990, 50), (2999, 3), (1500, 1)):
        got = bounded_log_read(spark, tmp_dir, "offset", start, limit)
        want = [o for o in offsets if start is None or o > start][:limit]
        assert [r.offset for r in got.orderBy("offset").collect()] == want
        used = segments_for(spark, tmp_dir, start, limit)
        assert set(o // 100 for o in want) <= set(used) and len(used) <= len(set(o // 100 for o in want)) + 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment" in plan or "PartitionFilters: [segment" in plan


def test_log_index_grows_by_appends_and_reads_list_their_segments(spark, tmp_dir):
    """It had a file per segment, written by one task, and every read listed the whole log."""
    def rows(lo, hi, step=1):
        return spark.range(lo, hi, step).select(F.col("id").alias("offset"), F.concat(F.lit("m"), "id").alias("value"))

    def read(start, limit):
        return [r.offset for r in bounded_log_read(spark, tmp_dir, "offset", start, limit).orderBy("offset").collect()]

    append_segments(rows(0, 400), tmp_dir, "offset", 10)
    assert _files(f"{tmp_dir}/index") <= 8 and _files(f"{tmp_dir}/data") == 40
    got = bounded_log_read(spark, tmp_dir, "offset", 99, 15)
    assert [r.offset for r in got.orderBy("offset").collect()] == list(range(100, 115)) and len(got.inputFiles()) == 2
    append_segments(rows(0, 400), tmp_dir, "offset", 10)                       # again: nothing changes
    assert read(99, 15) == list(range(100, 115))
    append_segments(rows(100, 110, 5), tmp_dir, "offset", 10)                  # a segment with fewer records
    assert read(99, 15) == [100, 105, *range(110, 123)]
    assert segments_for(spark, tmp_dir, 99, 2) == [10] and segments_for(spark, tmp_dir, 99, 3) == [10, 11]
    assert read(399, 5) == [] and bounded_log_read(spark, tmp_dir, "offset", 399, 5).columns == ["offset", "value"]
    append_segments(rows(410, 420).unionByName(spark.createDataFrame([(None, "none")], "offset long, value string")), tmp_dir, "offset", 10)
    assert read(399, 5) == list(range(410, 415)) and len(read(None, 1000)) == 402


def test_topics_keep_a_key_in_one_partition(spark, tmp_dir):
    rows = [(i, i % 11 if i % 13 else None, "ab"[i % 2]) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, device long, kind string")
    for n, part in enumerate(("id < 120", "id >= 120")):
        df.where(part).write.parquet(f"{tmp_dir}/in/p{n}")
        publish(file_stream(spark, f"{tmp_dir}/in/*", df.schema), f"{tmp_dir}/out", f"{tmp_dir}/ckpt", "device", "kind", ["a", "b"],
                trigger={"availableNow": True}).awaitTermination()
    out = spark.read.parquet(f"{tmp_dir}/out")
    assert out.count() == 200
    where = out.groupBy("topic", "key").agg(F.countDistinct("partition").alias("n")).collect()
    assert all(r.n <= 1 for r in where) and out.where("partition is not null").select("partition").distinct().count() == 3
    files = [f for d, _, names in os.walk(f"{tmp_dir}/out") for f in names if f.endswith(".parquet")]
    assert len(files) == out.select("batch_id", "topic", "partition").distinct().count()     # one task each
    df.withColumn("kind", F.lit("c")).limit(1).write.parquet(f"{tmp_dir}/in/p9")
    with pytest.raises(Exception, match="unknown topic"):
        publish(file_stream(spark, f"{tmp_dir}/in/*", df.schema), f"{tmp_dir}/out", f"{tmp_dir}/ckpt", "device", "kind", ["a", "b"],
                trigger={"availableNow": True}).awaitTermination()


def _files(path):
    return sum(f.endswith(".parquet") for _, _, names in os.walk(path) for f in names)


def test_compaction_is_safe_to_repeat(spark, tmp_dir, monkeypatch):
    t0 = dt.datetime(2024, 1, 1)
    schema = spark.createDataFrame([], "id long, ts timestamp_ntz").schema
    raw, closed = f"{tmp_dir}/raw", f"{tmp_dir}/closed"

    def arrive(name, ids):
        spark.createDataFrame([(i, t0 + dt.timedelta(hours=i)) for i in ids], schema).coalesce(1).write.parquet(f"{tmp_dir}/in/{name}")
        compaction.ingest_days(file_stream(spark, f"{tmp_dir}/in/*", schema, max_files_per_trigger=1), "ts", raw, f"{tmp_dir}/ckpt",
                               trigger={"availableNow": True}).awaitTermination()

    def ids():
        return sorted(r.id for r in compaction.read(spark, raw, closed, schema).collect())

    for k in range(6):
        arrive(f"p{k}", range(k, 90, 6))                       # each file touches all four days
    assert _files(raw) == 24 and ids() == list(range(90))
    gone = []
    with monkeypatch.context() as m:                            # stopped before the raw folders go
        m.setattr(compaction, "_remove", lambda spark, paths: gone.extend(paths))
        assert compaction.compact(spark, raw, closed, schema, dt.date(2024, 1, 4)) == [dt.date(2024, 1, d) for d in (1, 2, 3)]
    assert len(gone) == 4 and ids() == list(range(90))          # rows in both places are shown once
    compaction.compact(spark, raw, closed, schema, dt.date(2024, 1, 4))
    assert ids() == list(range(90)) and _files(closed) == 3 and _files(raw) == 6
    assert compaction.compact(spark, raw, closed, schema, dt.date(2024, 1, 4)) == []
    arrive("late", [200, 1])                                    # a repeated id is a row of its own
    late = spark.read.schema(schema).parquet(f"{tmp_dir}/in/late")
    assert ids() == sorted([*range(90), 1, 200]) and late.count() == 2
    compaction.compact(spark, raw, closed, schema, dt.date(2024, 1, 4))
    assert ids() == sorted([*range(90), 1, 200])
