"""The split next-match operator against brute force; paging properties."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from fleetlake.operators.paging import page, seek_page
from fleetlake.operators.sequence import next_match_time
from conftest import SF01


def brute_next(rows):
    out = {}
    for r in rows:
        later = [s for s in rows if s[1] == r[1] and s[3] and (s[2], s[0]) > (r[2], r[0])]
        out[r[0]] = min((s[2] for s in later), default=None)
    return out


@pytest.mark.parametrize("bucket", ["minute", "hour", "day", "month"])
def test_next_match_equals_brute_force(spark, bucket):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 6)          # key 0 is hot
        ts = base + dt.timedelta(minutes=rnd.randint(0, 60 * 24 * 5))
        rows.append((i, key, ts, rnd.random() < 0.3))
    df = spark.createDataFrame(rows, "id long, k int, ts timestamp_ntz, ok boolean")
    got = {r.id: r.nxt for r in next_match_time(df, "k", "ts", "id", F.col("ok"), bucket=bucket,
                                                 out="nxt").collect()}
    assert got == brute_next(rows)


def test_pages_concatenate_to_sorted_input(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").filter(F.col("user_id") < 20) \
        .select("event_id", "ts")
    full = [tuple(r) for r in ev.orderBy("ts", "event_id").collect()]
    size, got, p = 37, [], 1
    while True:
        chunk = [tuple(r) for r in page(ev, ["ts", "event_id"], p, size).collect()]
        if not chunk:
            break
        got.extend(chunk)
        p += 1
    assert got == full


def test_seek_page_matches_offset_page(spark):
    ev = spark.read.parquet(f"{SF01}/events.parquet").select("event_id", "ts")
    p3 = [tuple(r) for r in page(ev, ["ts", "event_id"], 3, 20).collect()]
    p2 = [tuple(r) for r in page(ev, ["ts", "event_id"], 2, 20).collect()]
    last = p2[-1]
    seek = [tuple(r) for r in seek_page(ev, ["ts", "event_id"], (last[1], last[0]), 20).collect()]
    assert seek == p3


def brute_sessions(rows, gap):
    out = []
    for k in sorted({r[0] for r in rows}):
        ts = sorted(r[1] for r in rows if r[0] == k)
        start = last = ts[0]
        n = 1
        for t in ts[1:]:
            if t - last <= gap:
                last, n = t, n + 1
            else:
                out.append((k, start, last, n))
                start = last = t
                n = 1
        out.append((k, start, last, n))
    return sorted(out)


@pytest.mark.parametrize("bucket", ["hour", "day", "month"])
def test_split_sessions_equal_brute_force(spark, bucket):
    from fleetlake.operators.sessions import sessions
    rnd = random.Random(11)
    base = dt.datetime(2024, 1, 1, 22)
    rows, t = [], {k: base for k in range(4)}
    for i in range(600):
        k = 0 if rnd.random() < 0.5 else rnd.randint(1, 3)              # device 0 is hot
        t[k] = t[k] + dt.timedelta(minutes=rnd.choice([1, 5, 20, 29, 30, 31, 90]))
        rows.append((k, t[k]))
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz")
    got = sorted(tuple(r) for r in sessions(df, "k", "ts", 1800, bucket=bucket)
                 .select("k", "session_start", "session_last", "events").collect())
    assert got == brute_sessions(rows, dt.timedelta(minutes=30))
