"""Plan checks: pushed filters, pruned scans, partition pruning, broadcast guard."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlake.plans.catalogue import queries
from fleetlake.plans.layers import Layers, retention, time_range_with_partitions
from fleetlake.plans.q_layers import device_rules, event_rules
from fleetlake.plans.standins import order_documents
from fleetlake.session import scratch_path
from conftest import SF01


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_indicator_filter_and_pruning_reach_scan(spark):
    p = plan(queries()["indicator_event"](spark, SF01))
    pushed = p.split("PushedFilters: [")[1].split("\n")[0]
    assert "EqualTo(user_id,8)" in pushed
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00" in pushed and "LessThanOrEqual(ts,2024-01-12T00:00" in pushed
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,props:string>" in p


def test_anomaly_window_carries_narrow_rows(spark):
    """Only key, time, id and flag go through the window's exchange."""
    p = plan(queries()["anomaly_resolution"](spark, SF01))
    window_scan = [l for l in p.split("\n") if "ReadSchema" in l and "props" not in l]
    assert window_scan and all("value" not in l for l in window_scan)
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_unknown_keys_take_one_pass(spark):
    p = plan(queries()["fk_reject"](spark, SF01))
    assert p.count("lineitem.parquet") == 1 and p.count("ExistenceJoin") == 2


def test_incremental_scan_pushes_predicate(spark):
    p = plan(queries()["incremental_id_scan"](spark, SF01))
    assert "GreaterThan(event_id,5000)" in p


def test_role_lookup_broadcasts_registry(spark):
    p = plan(queries()["role_dim_lookup"](spark, SF01))
    assert "BroadcastHashJoin" in p


def test_page_is_top_k_not_full_sort(spark):
    p = plan(queries()["page"](spark, SF01))
    assert "TakeOrderedAndProject" in p


def test_aggregates_are_partial(spark):
    for name in ("hourly_rollup", "metric_upsert", "device_status_count"):
        p = plan(queries()[name](spark, SF01))
        assert "partial_" in p, name


def test_layers_partition_pruning_and_retention(spark):
    lay = Layers(spark, scratch_path(spark, "layers_test"), grain="day")
    docs = order_documents(spark, SF01).filter("dt >= '2001-06-01'")
    lay.ods_documents(docs, "a")
    good, bad = lay.dwd_devices(device_rules())
    lay.ads_rollups()
    dwd = lay.dwd_good()
    q = time_range_with_partitions(dwd, "event_time", dt.datetime(2001, 6, 10), dt.datetime(2001, 6, 12))
    p = plan(q)
    assert "PartitionFilters: [isnotnull(dt" in p and "dt#" in p
    kept = retention(dwd, "dt", "2001-07-30", 10)
    assert kept.agg(F.min("dt")).collect()[0][0] >= dt.date(2001, 7, 20)
    assert good.count() + bad.count() == docs.count() > 0
    removed = lay.apply_retention("2001-10-15")          # DWD keeps 90 days
    assert removed["dwd"] > 0
    assert lay.dwd_good().agg(F.min("dt")).collect()[0][0] >= dt.date(2001, 7, 17)


def test_ods_keeps_every_batch_of_a_day(spark):
    lay = Layers(spark, scratch_path(spark, "ods_test"))
    docs = order_documents(spark, SF01).filter("doc_id < 40").withColumn("dt", F.lit(dt.date(2024, 1, 1)))
    bad_time = docs.filter("doc_id = 5").withColumn("timestamp", F.lit("yesterday")) \
        .withColumn("doc_id", F.lit(1000).cast("long"))
    lay.ods_documents(docs.filter("doc_id < 20"), "a")
    lay.ods_documents(docs.filter("doc_id >= 20").unionByName(bad_time), "b")
    lay.ods_documents(docs.filter("doc_id >= 20").unionByName(bad_time), "b")        # sent again
    assert lay.read("ods", "device_documents").count() == docs.count() + 1
    good, bad = lay.dwd_devices(device_rules(), days=["2024-01-01"])
    assert [r.doc_id for r in bad.filter("dq_failed_rules like '%time_ok%'").collect()] == [1000]
    lay.ads_rollups(tables=("daily",), days=["2024-01-01"])
    assert lay.read("ads", "daily").agg(F.sum("events")).collect()[0][0] == good.count()


def test_event_rules_are_columns():
    assert len(event_rules()) == 3


def test_hot_key_work_is_split_by_bucket(spark):
    """Sessions and next-match shuffle on (device, bucket) first, never on the
    device alone for the per-event work."""
    from fleetlake.operators.sequence import next_match_time
    from fleetlake.operators.sessions import sessions
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    p = plan(sessions(ev.select("user_id", "ts"), "user_id", "ts"))
    first_exchange = [l for l in p.split("\n") if "Exchange hashpartitioning" in l][-1]
    # events are combined per (device, slot) in their own task first
    assert "hashpartitioning(user_id" in first_exchange and "_groupingexpression" in first_exchange
    assert "partial_min(ts" in p.split(first_exchange)[1]
    p2 = plan(next_match_time(ev, "user_id", "ts", "event_id", F.col("event_type") != "error"))
    window_exchanges = [l for l in p2.split("\n") if "Exchange hashpartitioning(user_id" in l]
    assert any("__bucket" in l for l in window_exchanges)


def test_upsert_and_latest_state_use_partial_aggregation(spark):
    from fleetlake.sinks.upsert import latest_per_key
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    p = plan(latest_per_key(ev, ["user_id"], ["ts", "event_id"]))
    assert "partial_max_by" in p and "Window" not in p


def test_sync_rows_shuffle_line_items_twice_without_broadcasts(spark):
    """With every side too big to broadcast, line items are shuffled by order
    key and by supplier key only (the customer nation rides on orders)."""
    from fleetlake.plans.standins import sync_view
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in keys:
            spark.conf.set(k, "-1")
        p = plan(sync_view(spark, SF01))
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    exchanges = [l for l in p.split("\n") if "Exchange hashpartitioning(" in l]
    line_item_keys = [l for l in exchanges if "hashpartitioning(l_" in l]
    assert len(line_item_keys) == 2
    assert any("l_orderkey" in l for l in line_item_keys) and any("l_suppkey" in l for l in line_item_keys)


def test_coarse_slots_lose_nothing(spark):
    """Rows of March and December in layers of weeks, months, quarters and
    years: ranges find them, retention keeps them until their last day."""
    from fleetlake.plans.layers import slot_end, slot_start
    from fleetlake.session import scratch_path
    rows = [(1, "d1", "1997-03-05 10:00:00", "t", "F", "1997-03-05"), (2, "d2", "1997-12-30 11:30:00", "t", "F", "1997-12-30")]
    docs = spark.createDataFrame(rows, "doc_id long, device_id string, timestamp string, device_type string, status string, dt string") \
        .selectExpr("*", "cast(null as string) ip_address", "'5%' battery_level", "cast(null as map<string, double>) metrics",
                    "cast(null as array<struct<alert_id: string>>) alerts",
                    "cast(null as struct<district: string, street: string, latitude: double, longitude: double>) location") \
        .withColumn("dt", F.to_date("dt"))
    for grain in ("day", "week", "month", "quarter", "year"):
        for d in (dt.date(1996, 2, 29), dt.date(1997, 12, 30), dt.date(1998, 1, 1)):
            s = slot_start(d, grain)
            assert s == spark.range(1).select(F.to_date(F.date_trunc(grain, F.lit(d)))).head()[0]
            assert s <= d <= slot_end(s, grain) and slot_start(slot_end(s, grain) + dt.timedelta(days=1), grain) > d
        lay = Layers(spark, scratch_path(spark, f"grain_{grain}"), grain=grain)
        lay.ods_documents(docs, "b")
        good, _ = lay.dwd_devices([], days=["1997-12-30"])
        assert good.count() == (2 if grain == "year" else 1)
        lay.dwd_devices([])
        found = time_range_with_partitions(lay.dwd_good(), "event_time", dt.datetime(1997, 3, 4), dt.datetime(1997, 6, 1), grain=grain)
        assert [r.device_id for r in found.collect()] == ["d1"]
        lay.ads_rollups(value="battery_pct", scale=0, tables=("daily",), days=["1997-03-05", "1997-12-30"])
        assert lay.read("ads", "daily").count() == 2
        lay.apply_retention("1998-02-01")                      # ADS keeps 365 days: both rows stay
        assert lay.read("ads", "daily").count() == 2
        assert {r.device_id for r in lay.dwd_good().collect()} == ({"d1", "d2"} if grain == "year" else {"d2"})
        assert retention(lay.dwd_good(), "dt", "1998-02-01", 90, ts="event_time", grain=grain).count() == 1


def test_merged_days_and_cube_read_the_partials_only(spark):
    from fleetlake.operators.rollups import merge, merge_cube
    from fleetlake.session import scratch_path
    lay = Layers(spark, scratch_path(spark, "only_partials"))
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, d, h, 5), "ab"[(d + h) % 2], u, u / 4 if u % 5 else float("nan"))
         for d in (1, 2, 3) for h in (0, 5, 23) for u in (1, 2, 5, 40_000, 10**9 + d, None) if u is not None]
        + [(dt.datetime(2024, 1, 1), "a", None, 1.0)], "ts timestamp_ntz, kind string, device long, value double")
    lay.ads_partials(rows, "ts", ["kind"], "device", scale=2)
    lay.ads_partials(rows.where("ts >= '2024-01-03'"), "ts", ["kind"], "device", scale=2)     # a day once more
    parts = lay.read("ads", "hourly_partials")
    day = merge(parts, [F.to_date("bucket_start").alias("day"), "kind"])
    cube = merge_cube(parts.withColumn("day", F.to_date("bucket_start")), ["kind", "day"])
    for out in (day, cube):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "hourly_partials" in plan and "events" not in plan.split("ReadSchema")[0].split("Location")[-1]
    rows = rows.withColumn("day", F.to_date("ts"))
    for r in cube.collect():
        own = rows.where((F.col("kind") == r.kind) if r.kind else F.lit(True)).where((F.col("day") == F.lit(r.day)) if r.day else F.lit(True))
        known = own.where(~F.isnan("value"))
        want = own.agg(F.count("*"), F.countDistinct("device")).head() + known.agg(F.sum("value"), F.min("value"), F.max("value")).head()
        assert (r.events, r.devices, r.value_sum, r.value_min, r.value_max) == tuple(want)
    assert {tuple(r) for r in day.collect()} == {
        (r.day, r.kind, r.events, r.value_sum, r.value_avg, r.value_min, r.value_max, r.devices)
        for r in cube.where("grouping_level = 0").collect()}


def test_windows_are_sums_of_panes(spark):
    from fleetlake.operators.rollups import sliding_rollup
    rows = spark.range(500).select((F.lit("2024-01-01").cast("timestamp_ntz") + F.expr("id * interval 7 minutes")).alias("ts"),
                                   (F.col("id") % 3).alias("k"), (F.col("id") / 7).alias("value"))
    out = sliding_rollup(rows, "ts", "1 hour", "15 minutes", ["k"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and plan.index("Generate") < plan.rindex("Aggregate")   # only panes are multiplied
    w = F.window("ts", "1 hour", "15 minutes")
    want = {(r.s, r.e, r.k): (r.n, r.v) for r in rows.groupBy(w.alias("w"), "k").agg(F.count("*").alias("n"), F.sum("value").alias("v"))
            .select("w.start", "w.end", "k", "n", "v").toDF("s", "e", "k", "n", "v").collect()}
    got = {(r.window_start, r.window_end, r.k): (r.events, r.value_sum) for r in out.collect()}
    assert got.keys() == want.keys() and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in ((got[k], want[k]) for k in want))
    with pytest.raises(ValueError):
        sliding_rollup(rows, "ts", "1 hour", "25 minutes", ["k"])


def test_offsets_of_times_are_applied(spark):
    from fleetlake.operators.predicates import closed_range, open_range
    from fleetlake.sources.incremental import SyncSpec, read_increment
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5),)], "ts timestamp_ntz")
    aware = dt.timezone(dt.timedelta(hours=8))
    lo, hi = dt.datetime(2024, 1, 1, 12, tzinfo=aware), dt.datetime(2024, 1, 1, 14, tzinfo=aware)    # 04:00-06:00 UTC
    for pred in (closed_range("ts", lo, hi), open_range("ts", lo, hi), closed_range("ts", lo.isoformat(), hi.isoformat())):
        assert df.where(pred).count() == 1
    spec = SyncSpec("t", "inc", "ts", "datetime", "2024-01-01T12:00:00+08:00")
    assert read_increment(df, spec, upper="2024-01-01T14:00:00+08:00").count() == 1
    assert read_increment(df, spec, upper="2024-01-01T04:30:00Z").count() == 0
