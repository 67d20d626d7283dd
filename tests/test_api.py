"""The list / indicator / audit / task entry points over the stand-in views."""

from pyspark.sql import functions as F

from fleetlake.plans import api
from fleetlake.plans.indicators import TASK_SOURCES
from fleetlake.plans.standins import audit_view, event_view, registry_view, sync_view, task_view
from fleetlake.session import scratch_path
from fleetlake.sources.incremental import StateStore, SyncSpec
from conftest import SF01


def test_indicator_page_and_total(spark):
    rows, total = api.query_indicator_data(event_view(spark, SF01), "2024-01-05", "2024-01-12",
                                           "robot_event", vin="8", page=2, page_size=10)
    assert total.collect()[0]["total"] == 14 and rows.count() == 4
    t_rows, t_total = api.query_indicator_data(task_view(spark, SF01), "1997-01-01", "1997-12-31",
                                               "robot_task", page=1, page_size=5, sources=TASK_SOURCES)
    assert t_rows.count() == 5 and t_total.collect()[0]["total"] == 2279


def test_export_writes_labelled_csv(spark, tmp_dir):
    path, summary = api.export_indicator_data(event_view(spark, SF01), "2024-01-01", "2024-01-31",
                                              "robot_event", tmp_dir, limit=500)
    assert tuple(summary.head()) == (10000, 500, True)
    assert tuple(api.export_indicator_data(event_view(spark, SF01), "2024-01-01", "2024-01-31", "robot_event",
                                           f"{tmp_dir}/all")[1].head()) == (10000, 10000, False)
    assert path.endswith("robot_event_2024-01-01_2024-01-31")
    back = spark.read.option("header", True).csv(path)
    assert back.count() == 500 and "Event time" in back.columns


def test_security_audits(spark):
    rows, summary = api.get_security_audits(audit_view(spark, SF01), "2024-01-30", page=1,
                                            page_size=20, query_user="1", query_indicator="CLICK",
                                            start_date="2024-01-10", end_date="2024-01-20")
    s = summary.collect()[0]
    assert s["access_total"] == 288 and s["abnormal_access_total"] == 980
    assert rows.count() == 20


def test_collect_and_database_lists(spark):
    reg = registry_view(spark, SF01).withColumn("password", F.lit("x"))
    sync = sync_view(spark, SF01).withColumn("id", F.monotonically_increasing_id())
    rows, total = api.get_collect_list(sync, reg, type="R", source_type=["ASIA", "EUROPE"],
                                       target_type=["AMERICA"], status="F", page=1, page_size=7)
    assert total.collect()[0]["total"] == 1027 and rows.count() == 7
    assert {"source_name", "target_type"} <= set(rows.columns)
    db, db_total = api.get_database_list(reg, "ASIA", page=1, page_size=100)
    assert "password" not in db.columns
    assert db_total.collect()[0]["total"] == 5                 # type equals ASIA
    _, by_name = api.get_database_list(reg, "nation_1", page=1, page_size=10)
    assert by_name.collect()[0]["total"] == 11                 # NATION_1, NATION_10..19
    import pytest
    with pytest.raises(ValueError):
        api.get_database_list(reg, None, page_size=101)


def test_process_task_sends_and_commits(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    sent = []
    state = StateStore(spark, scratch_path(spark, "task_state"))
    spec = SyncSpec("events_to_topic", "inc", "event_id", "int", "9990")
    stats = api.process_task(spark, ev, spec, state, "user_id", lambda m: sent.append(m.count()),
                             transformers=[{"type": "datetime_to_string", "columns": ["ts"]}])
    assert stats["batch_rows"] == 9 and sent == [9] and state.get("events_to_topic") == "9999"
