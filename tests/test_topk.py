"""Exact top-k by histogram narrowing against a plain orderBy/limit."""

import datetime as dt

import pytest

from fleetlake.operators.paging import narrowed_top_k
from conftest import SF01


def _ids(df):
    return [r.event_id for r in df.collect()]


@pytest.mark.parametrize("k", [1, 7, 500, 9999, 10000, 12000])
def test_forced_histogram_path_matches(spark, k):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "ts", "value")
    want = _ids(ev.orderBy("ts", "event_id").limit(k))
    got = narrowed_top_k(ev, "ts", "event_id", k)
    assert sorted(_ids(got)) == sorted(want)


def test_hot_bucket_and_nulls(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(microseconds=i % 3)) for i in range(3000)]       # all in one ms
    rows += [(10_000 + i, None) for i in range(5)]
    rows += [(20_000 + i, t0 + dt.timedelta(days=i)) for i in range(1, 30)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").repartition(4)
    for k in (3, 5, 6, 100, 2000, 3010, 3100):
        want = _ids(df.orderBy("ts", "event_id").limit(k))
        got = _ids(narrowed_top_k(df, "ts", "event_id", k))
        assert sorted(got) == sorted(want), k


def test_deep_page_inside_the_narrowed_rows(spark):
    from fleetlake.operators.paging import page
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "ts")
    for p_no in (1, 37, 250):
        want = _ids(page(ev, ["ts", "event_id"], p_no, 20))
        inside = narrowed_top_k(ev, "ts", "event_id", p_no * 20)
        assert _ids(page(inside, ["ts", "event_id"], p_no, 20)) == want, p_no
