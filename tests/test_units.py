"""Hand-made frames for the decisions S1-S16 (FIXTURES §4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleetlake.functions.scalars import first_forwarded, lower_camel, percent_value
from fleetlake.operators.joins import reject_unknown, role_lookup
from fleetlake.operators.predicates import (UnknownColumn, closed_range, dynamic_filters,
                                            icontains, optional_eq, parse_day, where)
from fleetlake.operators.projection import (apply_transformers, cast_by_suffix, include_exclude,
                                            metric_schema, select_keys_metric)
from fleetlake.operators.quality import ErrorLimitExceeded, enforce, error_summary


def test_range_bounds_s1(spark):
    rows = [(1, dt.datetime(2024, 1, 5)), (2, dt.datetime(2024, 1, 12)),
            (3, dt.datetime(2024, 1, 12, 10)), (4, dt.datetime(2024, 1, 13))]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    ref = {r.id for r in df.filter(closed_range("ts", "2024-01-05", "2024-01-12")).collect()}
    whole = {r.id for r in df.filter(closed_range("ts", "2024-01-05", "2024-01-12",
                                                  end_inclusive_day=True)).collect()}
    assert ref == {1, 2}          # reference: end day at midnight
    assert whole == {1, 2, 3}     # whole end day


def test_contains_is_literal(spark):
    df = spark.createDataFrame([("a%b",), ("a_b",), ("AB",), (None,)], "s string")
    got = lambda v: sorted(r.s for r in df.filter(icontains("s", v)).collect())
    assert got("%") == ["a%b"]
    assert got("_") == ["a_b"]
    assert got("ab") == ["AB"]
    assert icontains("s", None) is None and icontains("s", "") is None


def test_status_zero_is_a_filter_s4(spark):
    df = spark.createDataFrame([(1, 1), (2, 0)], "id int, status int")
    assert [r.id for r in where(df, optional_eq("status", 0)).collect()] == [2]
    assert where(df, optional_eq("status", None)).count() == 2


def test_dynamic_filter_names_checked_s9(spark):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    assert where(df, dynamic_filters(df, {"NAME": "a", "id": None})).count() == 1
    with pytest.raises(UnknownColumn):
        dynamic_filters(df, {"name; drop table x": "a"})


def test_parse_day():
    assert parse_day("2024-01-05") == dt.datetime(2024, 1, 5)
    assert parse_day("2024-01-05T10:00:00Z") == dt.datetime(2024, 1, 5, 10)
    with pytest.raises(ValueError):
        parse_day("2024-13-05")


def test_forwarded_address(spark):
    df = spark.createDataFrame([("1.1.1.1, 2.2.2.2", "9.9.9.9"), ("", "9.9.9.9"), (None, "9.9.9.9")],
                               "fwd string, peer string")
    got = [r[0] for r in df.select(first_forwarded("fwd", "peer")).collect()]
    assert got == ["1.1.1.1", "9.9.9.9", "9.9.9.9"]


def test_percent_text(spark):
    df = spark.createDataFrame([("55%",), ("%",), ("x%",), (None,)], "s string")
    assert [r[0] for r in df.select(percent_value("s")).collect()] == [55, None, None, None]


@pytest.mark.parametrize("bad,total,passed", [(0, 100, True), (2, 100, False), (3, 100, False)])
def test_error_limit_reference_limits(spark, bad, total, passed):
    df = spark.createDataFrame([(i < bad,) for i in range(total)], "bad boolean")
    row = error_summary(df, F.col("bad"), 0, 0.02).collect()[0].asDict()
    assert row["passed"] is passed and row["bad_rows"] == bad
    if not passed:
        with pytest.raises(ErrorLimitExceeded):
            enforce(row)


def test_error_limit_ratio_only(spark):
    df = spark.createDataFrame([(i < 2,) for i in range(100)], "bad boolean")
    # exactly 2 % with a record limit that allows it
    assert error_summary(df, F.col("bad"), 10, 0.02).collect()[0]["passed"] is True
    df3 = spark.createDataFrame([(i < 3,) for i in range(100)], "bad boolean")
    assert error_summary(df3, F.col("bad"), 10, 0.02).collect()[0]["passed"] is False


def test_dangling_id_left_join_s14(spark):
    rows = spark.createDataFrame([(1, 10, 11), (2, 10, 99)], "id int, source_id int, target_id int")
    dim = spark.createDataFrame([(10, "a", "MySQL"), (11, "b", "Kafka")], "id int, name string, type string")
    out = {r.id: r for r in role_lookup(rows, dim, [("source_id", "source"), ("target_id", "target")]).collect()}
    assert out[1].target_name == "b" and out[2].target_name is None and out[2].source_type == "MySQL"
    rej = reject_unknown(rows, ["source_id", "target_id"], dim, "id")
    assert [r.id for r in rej.collect()] == [2]
    twice = rows.unionByName(rows).unionByName(spark.createDataFrame([(3, None, 10)], rows.schema))
    rej = reject_unknown(twice, ["source_id", "target_id"], dim.unionByName(dim), "id")
    assert sorted(r.id for r in rej.collect()) == [2, 2, 3]          # genuine repeats stay, null keys are unknown


def test_include_exclude_and_camel(spark):
    df = spark.createDataFrame([(1, "x", "secret")], "user_id int, user_name string, password string")
    assert include_exclude(df, exclude=["password"]).columns == ["user_id", "user_name"]
    assert include_exclude(df, include=["user_id", "password"], exclude=["password"]).columns == ["user_id"]
    assert lower_camel("user_login_count") == "userLoginCount"
    assert lower_camel("Already") == "already"


def test_suffix_typing():
    schema = metric_schema(["ROBOT_ID", "TASK_COUNT", "AVG_SPEED", "RUN_DURATION", "NAME"])
    types = {f.name: f.dataType.simpleString() for f in schema.fields}
    assert types == {"robot_id": "bigint", "task_count": "bigint", "avg_speed": "double",
                     "run_duration": "double", "name": "string", "created_at": "string"}


def test_cast_by_suffix(spark):
    df = spark.createDataFrame([("7", "3", "1.5", "x")], "ROBOT_ID string, TASK_COUNT string, AVG_SPEED string, NAME string")
    out = cast_by_suffix(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "bigint", "double", "string"]
    assert out.columns == ["robot_id", "task_count", "avg_speed", "name"]


def test_default_metric_d5(spark):
    df = spark.createDataFrame([(1, "a", 2.0, 3.0)], "id int, kind string, m1 double, m2 double")
    assert select_keys_metric(df, ["ID", "kind"]).columns == ["id", "kind", "m1"]
    assert select_keys_metric(df, ["id"], metric="M2").columns == ["id", "m2"]


def test_transformers(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3, 4, 5, 600),)], "t timestamp_ntz")
    out = apply_transformers(df, [{"type": "datetime_to_string", "columns": ["T"]}])
    assert out.collect()[0][0] == "2024-01-02 03:04:05"


def test_csv_export_roundtrip(spark, tmp_dir):
    from fleetlake.plans.catalogue import queries
    from fleetlake.sinks.writers import export_csv, export_name
    from conftest import SF01
    df = queries()["export_labelled"](spark, SF01)
    path = export_csv(df, tmp_dir, export_name("robot_event", "2024-01-01", "2024-01-31"))
    back = spark.read.option("header", True).csv(path)
    assert back.columns == df.columns == ["Device ID", "Event type", "Event time", "Description", "Record time"]
    assert back.count() == df.count() == 10000
    limited = queries()["export_limited"](spark, SF01)
    assert limited.count() == 2500
    with open([p for p in __import__("glob").glob(f"{path}/part-*.csv")][0], "rb") as fh:
        assert not fh.read(3).startswith(b"\xef\xbb\xbf")       # S12: no BOM


def test_overwrite_partitions_replaces_only_touched_days(spark, tmp_dir):
    from fleetlake.sinks.writers import overwrite_partitions
    a = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "id int, dt string")
    overwrite_partitions(a, f"{tmp_dir}/t", ["dt"])
    b = spark.createDataFrame([(3, "2024-01-02")], "id int, dt string")
    overwrite_partitions(b, f"{tmp_dir}/t", ["dt"])
    got = sorted((r.id, str(r.dt)) for r in spark.read.parquet(f"{tmp_dir}/t").collect())
    assert got == [(1, "2024-01-01"), (3, "2024-01-02")]


def test_audit_append_one_row_per_request(spark, tmp_dir):
    from fleetlake.operators.audit import append_audit, with_client_ip
    reqs = spark.createDataFrame(
        [(1, "user_1", "robot_event", "1.1.1.1, 2.2.2.2", "9.9.9.9"),
         (2, "user_2", "robot_task", None, "8.8.8.8")],
        "id long, query_user string, query_indicator string, fwd string, peer string")
    append_audit(with_client_ip(reqs, "fwd", "peer", "ip_address").drop("fwd", "peer"), f"{tmp_dir}/audit")
    append_audit(with_client_ip(reqs.limit(1), "fwd", "peer", "ip_address").drop("fwd", "peer"),
                 f"{tmp_dir}/audit")
    rows = spark.read.parquet(f"{tmp_dir}/audit").collect()
    assert len(rows) == 3 and sorted(r.ip_address for r in rows) == ["1.1.1.1", "1.1.1.1", "8.8.8.8"]


def test_read_mode_by_sync_type(spark, tmp_dir):
    from fleetlake.streaming.ingest import read_for
    spark.range(5).write.parquet(f"{tmp_dir}/src")
    schema = spark.read.parquet(f"{tmp_dir}/src").schema
    assert read_for(spark, "stream", f"{tmp_dir}/src", schema).isStreaming
    assert not read_for(spark, "batch", f"{tmp_dir}/src", schema).isStreaming


def test_dialects_and_urls():
    from fleetlake.sources.connectors import Source, dialect
    assert dialect("Dameng") == dialect("DM") == "dm"             # S11
    assert dialect("PostgreSQL") == "postgresql"
    assert Source("SQL Server", "h", 1433, "db").url() == "jdbc:sqlserver://h:1433;databaseName=db"
    assert Source("MySQL", "h", 3306, "db").url() == "jdbc:mysql://h:3306/db"
    with pytest.raises(ValueError):
        dialect("excel")


def test_point_lookup_raises_when_missing(spark):
    from fleetlake.operators.predicates import NotFound, get_one
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    assert get_one(df, "id", 2).name == "b"
    with pytest.raises(NotFound):
        get_one(df, "id", 3)


def test_labels_from_metadata(spark):
    from fleetlake.operators.projection import with_labels
    from fleetlake.plans.indicators import labelled
    df = with_labels(spark.createDataFrame([(1, "x")], "vin int, kind string"), {"vin": "Device ID"})
    assert labelled(df).columns == ["Device ID", "kind"]
    assert labelled(df, {"kind": "Kind"}).columns == ["Device ID", "Kind"]


def test_read_documents_explicit_schema(spark, tmp_dir):
    from fleetlake.sources.documents import flatten, metrics_long, read_documents
    lines = [
        '{"device_id": "CAM-000001", "timestamp": "2024-01-01 10:00:00", "device_type": "camera",'
        ' "status": "online", "location": {"district": "d", "street": "s", "latitude": 39.9,'
        ' "longitude": 116.3}, "metrics": {"frame_rate": 25.0, "uptime": 99.5},'
        ' "storage_remaining": "55%", "unknown_field": 1}',
        '{"device_id": "ENV-000002", "timestamp": "2024-01-01 11:00:00", "device_type":'
        ' "environmental_sensor", "metrics": {"pm25": 12.5}, "battery_level": "80%",'
        ' "alerts": [{"alert_id": "A1", "severity": "high", "message": "m", "timestamp": "2024-01-01 11:00:00"}]}',
        'not json at all',
    ]
    with open(f"{tmp_dir}/docs.json", "w") as fh:
        fh.write("\n".join(lines) + "\n")
    docs = read_documents(spark, f"{tmp_dir}/docs.json").withColumn("doc_id", F.monotonically_increasing_id())
    rows = docs.collect()
    assert len(rows) == 3 and sum(r["_corrupt_record"] is not None for r in rows) == 1
    good = docs.filter(F.col("_corrupt_record").isNull())
    flat = {r.device_id: r for r in flatten(good).collect()}
    assert flat["CAM-000001"].n_metrics == 2 and flat["CAM-000001"].n_alerts == 0
    assert flat["ENV-000002"].battery_pct == 80 and flat["ENV-000002"].n_alerts == 1
    assert sorted(r.metric for r in metrics_long(good).collect()) == ["frame_rate", "pm25", "uptime"]


def test_metric_store_calls(spark):
    from decimal import Decimal
    from fleetlake.plans.metric_store import get_metrics, query_metrics, store_metrics
    from fleetlake.session import scratch_path
    from fleetlake.sinks.upsert import KeyedTable
    t = KeyedTable(spark, scratch_path(spark, "metric_store"), ["robot_id", "day"], buckets=4)
    rows = spark.createDataFrame(
        [(1, "2024-01-01", 3, Decimal("1.50")), (2, "2024-01-01", 5, Decimal("2.25"))],
        "ROBOT_ID int, DAY string, TASK_COUNT int, AVG_SPEED decimal(10,2)")
    store_metrics(t, rows, "2024-01-02 00:00:00")
    store_metrics(t, rows.filter("ROBOT_ID = 2").withColumn("TASK_COUNT", F.lit(7)), "2024-01-03 00:00:00")
    m = t.read()
    assert {f.name: f.dataType.simpleString() for f in m.schema.fields} == {
        "robot_id": "bigint", "day": "string", "task_count": "bigint", "avg_speed": "double",
        "created_at": "string"}
    got = {r.robot_id: (r.task_count, r.created_at) for r in m.collect()}
    assert got == {1: (3, "2024-01-02 00:00:00"), 2: (7, "2024-01-03 00:00:00")}
    q = query_metrics(m, "2024-01-03", "2024-01-03", {"ROBOT_ID": 2, "day": None},
                      selected_fields=["robot_id", "TASK_COUNT"])
    assert [tuple(r) for r in q.collect()] == [(2, 7)]
    g = get_metrics(m, "2024-01-01T00:00:00Z", "2024-01-31", '{"day": "2024-01-01"}',
                    key_columns=["robot_id"], value_columns=["task_count", "avg_speed"])
    assert g.columns == ["robot_id", "task_count"] and g.count() == 2
    with pytest.raises(Exception):
        get_metrics(m, "2024-01-01", "2024-01-31", '{"nope": 1}', key_columns=["robot_id"])
    with pytest.raises(ValueError):
        get_metrics(m, "2024-13-01", "2024-01-31", None, key_columns=["robot_id"])


def test_sums_are_exact_or_refused(spark):
    from fleetlake.functions.scalars import exact_sum
    from fleetlake.operators.rollups import time_rollup
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(t, "a", 1.0), (t, "a", float("nan")), (t, "a", 2.0), (t, "a", None)],
                               "ts timestamp_ntz, k string, value double")
    r = time_rollup(df, "ts", "hour", ["k"]).collect()[0]
    assert (r.events, r.value_sum, r.value_avg, r.value_min, r.value_max) == (4, 3.0, 1.5, 1.0, 2.0)
    small = spark.createDataFrame([(0.004,)] * 3 + [(1e17,)], "v double")
    assert small.limit(3).agg(exact_sum("v", 3)).collect()[0][0] == 0.012
    assert small.agg(exact_sum("v", 3)).collect()[0][0] == 1e17 + 0.012
    for bad in (small.limit(3), spark.createDataFrame([(float("inf"),)], "v double")):
        with pytest.raises(Exception, match="does not fit"):
            bad.agg(exact_sum("v", 2)).collect()


def test_json_keeps_null_fields_and_keys_choose_partitions(spark):
    from fleetlake.sources.messages import keyed_json
    df = spark.createDataFrame([(1, None), (1, "x"), (None, "y")], "id int, s string")
    rows = keyed_json(df, "id", partitions=4).collect()
    assert [r.value for r in rows] == ['{"id":1,"s":null}', '{"id":1,"s":"x"}', '{"id":null,"s":"y"}']
    assert rows[0].partition == rows[1].partition and rows[0].partition in range(4) and rows[2].partition is None


def test_empty_lists_are_no_filter(spark):
    from fleetlake.operators.joins import filter_through
    rows = spark.createDataFrame([(1, 10)], "id int, fk int")
    dim = spark.createDataFrame([(10, "a")], "id int, type string")
    assert filter_through(rows, "fk", dim, "id", "type", []).count() == 1
    assert filter_through(rows, "fk", dim, "id", "type", ["b"]).count() == 0


def test_metric_must_be_a_value_column(spark):
    from fleetlake.plans.metric_store import get_metrics, parse_dimensions
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1, 2.0, "p")], "ts timestamp_ntz, k int, v double, p string")
    ask = dict(key_columns=["k"], value_columns=["v"], timestamp_column="ts")
    assert get_metrics(df, "2024-01-01", "2024-01-02", '[{"k": 1}, {"p": null}]', "V", **ask).columns == ["k", "v"]
    with pytest.raises(ValueError):
        get_metrics(df, "2024-01-01", "2024-01-02", None, "p", **ask)
    with pytest.raises(ValueError):
        parse_dimensions("[1]")


def test_transformer_kind_datetime(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 3),)], "t timestamp_ntz")
    assert apply_transformers(df, [{"type": "datetime", "columns": ["t"]}]).collect()[0][0] == "2024-01-02 03:00:00"


def test_offsets_in_times_are_applied():
    assert parse_day("2024-01-05T08:00:00+08:00") == dt.datetime(2024, 1, 5)


def test_camel_rule_edges():
    assert [lower_camel(n) for n in ("a_1b", "user__x", "_lead", "x_", "A_b_C")] == ["a_1b", "user_X", "lead", "x_", "aBC"]


def test_source_query_text_and_hooks(spark, tmp_dir):
    from fleetlake.sinks.writers import with_hooks
    from fleetlake.sources.connectors import Source, mongo_uri, read_query
    spark.range(5).write.parquet(f"{tmp_dir}/t.parquet")
    src = Source("files", path=tmp_dir)
    assert read_query(spark, src, "SELECT id * 2 AS x FROM {t} WHERE id > 2").filter("x < 8").collect()[0].x == 6
    assert mongo_uri(Source("mongo", "h", 1, username="u@x", password="p")) == "mongodb://u%40x:p@h:1"
    order = []
    with_hooks(spark.range(2), lambda d: order.append(d.count()), [lambda: order.append("before")], [lambda: order.append("after")])
    assert order == ["before", 2, "after"]


def test_anomalies_without_a_device(spark):
    from fleetlake.operators.alerts import anomalies
    t = dt.datetime(2024, 1, 1)
    rows = [(1, None, t, "error"), (2, None, t + dt.timedelta(minutes=1), "error"), (3, None, t + dt.timedelta(hours=2), "ok"),
            (4, 7, t, "error")]
    df = spark.createDataFrame(rows, "id long, dev long, ts timestamp_ntz, kind string")
    got = anomalies(df, "dev", "ts", "id", F.col("kind") == "error", [(F.lit(True), "x")], F.lit("k"), F.col("kind"))
    assert sorted((r.vin or "", r.isResolved, r.alertCount) for r in got.collect()) == [("", True, 2), ("", True, 2), ("7", False, 1)]


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Shanghai"])
def test_results_do_not_depend_on_the_zone_of_the_system(zone):
    """The queries with time literals, in a driver whose system has another zone."""
    import os
    import subprocess
    import sys
    here = os.path.dirname(os.path.abspath(__file__))
    names = ("indicator_event indicator_task seek_page indicator_usage incremental_datetime_scan incremental_date_scan "
             "next_watermark metric_upsert metric_range_query audit_search audit_summary retention_filter hourly_rollup "
             "export_limited stream_late_rows").split()
    done = subprocess.run([sys.executable, f"{here}/oracle_compare.py", "/root/testdata/sf0.001", *names],
                          env=os.environ | {"TZ": zone}, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout[-2000:]


def test_records_give_identifiers_as_text(spark):
    import uuid
    from fleetlake.operators.projection import as_records
    u = uuid.uuid4()
    df = spark.createDataFrame([(bytearray(u.bytes), bytearray(b"\x01\xff"), None)], "user_id binary, raw binary, none_id binary")
    assert tuple(as_records(df).collect()[0]) == (str(u), "01ff", None)
