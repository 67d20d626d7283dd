"""One sync definition both ways, and anomalies resolved in a stream."""

import datetime as dt
import random

from pyspark.sql import functions as F

from fleetlake.sinks.upsert import KeyedTable
from fleetlake.sources.incremental import StateStore, SyncSpec, run_stream_sync, run_sync
from fleetlake.streaming.anomalies import recovery_pairs, resolutions, settled_until
from fleetlake.streaming.ingest import file_stream, read_for
from fleetlake.streaming.metrics import run_appending

SCHEMA = "id long, ts timestamp_ntz, device long, kind string"
T0 = dt.datetime(2024, 1, 1)


def _write(spark, folder, rows, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{name}")


def test_stream_sync_begins_where_batches_ended(spark, tmp_dir):
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = [(i, T0 + dt.timedelta(minutes=i), i % 3, "x") for i in range(1, 31)]
    _write(spark, tmp_dir, rows[:10], "a")
    spec, state = SyncSpec("s", "inc", "id", "int"), StateStore(spark, f"{tmp_dir}_state")
    target = KeyedTable(spark, f"{tmp_dir}_target", ["id"], buckets=2)
    sizes = []

    def write(batch):
        sizes.append(batch.count())
        target.upsert(batch)

    def stream():
        run_stream_sync(read_for(spark, "continuous", f"{tmp_dir}/*", schema), spec, write, f"{tmp_dir}_ckpt", state,
                        trigger={"availableNow": True}).awaitTermination()

    assert run_sync(spark, read_for(spark, "scheduled", f"{tmp_dir}/*", schema), spec, write, state)["batch_rows"] == 10
    _write(spark, tmp_dir, rows[10:20], "b")
    stream()                                   # the first file's rows lie before the stored watermark
    stream()                                   # nothing new: nothing written
    _write(spark, tmp_dir, rows[20:], "c")
    stream()
    assert sizes == [10, 10, 10]
    assert sorted(r.id for r in target.read().collect()) == [r[0] for r in rows]


def test_stream_sync_of_a_full_copy_and_of_days(spark, tmp_dir):
    schema = spark.createDataFrame([], SCHEMA).schema
    _write(spark, tmp_dir, [(k, T0 + dt.timedelta(hours=11 * k), 0, "x") for k in range(6)], "a")
    for spec, want in ((SyncSpec("f", "full", None, None), [0, 1, 2, 3, 4, 5]),
                       (SyncSpec("d", "inc", "ts", "date", "2024-01-01"), [3, 4, 5]),
                       (SyncSpec("t", "inc", "ts", "datetime", "2024-01-01 22:00:00"), [3, 4, 5])):
        got = []
        run_stream_sync(file_stream(spark, f"{tmp_dir}/*", schema), spec, lambda b: got.extend(r.id for r in b.collect()),
                        f"{tmp_dir}_{spec.name}", trigger={"availableNow": True}).awaitTermination()
        assert sorted(got) == want


def _brute(rows, bound, until):
    out = set()
    for i, t, d, kind in rows:
        if kind == "error" and t + bound < until:
            later = [u for j, u, e, k in rows if k != "error" and e == d and d is not None and t <= u <= t + bound and (u, j) > (t, i)]
            out.add((i, d, t, min(later, default=None), bool(later)))
    return out


def test_anomalies_resolve_over_micro_batches_and_restarts(spark, tmp_dir):
    rng = random.Random(4)
    schema = spark.createDataFrame([], SCHEMA).schema
    rows = []
    for k in range(240):
        t = T0 + dt.timedelta(minutes=k * 5 - rng.randint(0, 20))            # out of order, within the delay
        rows.append((k, t, rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["error", "error", "view"])))
    rows += [(900, rows[50][1], rows[50][2], "error"), (901, rows[50][1], rows[50][2], "view")]    # ties
    out, until = f"{tmp_dir}_out", None
    for n, part in enumerate((rows[:80] + rows[240:], rows[80:160], rows[160:240])):
        _write(spark, tmp_dir, part, f"p{n}")
        pairs = recovery_pairs(file_stream(spark, f"{tmp_dir}/*", schema), "device", "ts", "id",
                               F.col("kind") == "error", "1 hour", "30 minutes")
        q = run_appending(pairs, f"{out}/data", f"{out}/ckpt", trigger={"availableNow": True}, state_partitions=2)
        q.awaitTermination()
        until = settled_until(q)
        seen = rows[:80] + rows[240:] + rows[80:80 * (n + 1)]
        found = resolutions(spark.read.schema(pairs.schema).parquet(f"{out}/data"), "1 hour", until)
        got = {tuple(r) for r in found.collect()}
        assert got == _brute(seen, dt.timedelta(hours=1), until) and len(got) > 10
        assert any(not r[4] for r in got)                                     # unresolved ones too
    # On a table the same pairs come out.
    batch = resolutions(recovery_pairs(spark.createDataFrame(rows, SCHEMA), "device", "ts", "id", F.col("kind") == "error",
                                       "1 hour", "30 minutes"), "1 hour", until)
    assert {tuple(r) for r in batch.collect()} == got
