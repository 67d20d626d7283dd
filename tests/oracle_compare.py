"""Run each registered query and its DuckDB SQL side by side and compare.

Mirrors the round check: columns sorted by name, row count, column names and
an order-insensitive comparison of the values.  Usable as a script:

    python tests/oracle_compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if hasattr(v, "isoformat") and not isinstance(v, str):
        if isinstance(v, dt.datetime):
            return v.replace(tzinfo=None).isoformat(sep=" ")
        return v.isoformat()
    if hasattr(v, "tolist"):
        return repr(v.tolist())
    if isinstance(v, (list, tuple)):
        return repr([_norm(x) for x in v])
    return repr(v)


def rows_of(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(columns), sorted(rows, key=lambda t: tuple((v is None, v or "") for v in t))


def spark_rows(df):
    cols = df.columns
    return rows_of(cols, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return rows_of(cols, cur.fetchall())


def compare(spark, sf_dir, names=None, verbose=True):
    from fleetlake.plans.catalogue import oracle_sql, queries
    qs, sqls = queries(), oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or list(qs):
        t0 = time.time()
        try:
            s_cols, s_rows = spark_rows(qs[name](spark, sf_dir))
        except Exception as e:  # report and continue
            results[name] = f"SPARK ERROR {type(e).__name__}: {str(e)[:400]}"
            print(f"{name:28s} {results[name]}", flush=True)
            continue
        t1 = time.time()
        if name not in sqls:
            results[name] = f"no-sql rows={len(s_rows)}"
            print(f"{name:28s} {results[name]}", flush=True)
            continue
        try:
            d_cols, d_rows = duck_rows(con, sqls[name])
        except Exception as e:
            results[name] = f"DUCK ERROR {type(e).__name__}: {str(e)[:400]}"
            print(f"{name:28s} {results[name]}", flush=True)
            continue
        if s_cols != d_cols:
            results[name] = f"COLUMNS spark={s_cols} duck={d_cols}"
        elif len(s_rows) != len(d_rows):
            results[name] = f"ROWS spark={len(s_rows)} duck={len(d_rows)}"
        elif s_rows != d_rows:
            diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:2]
            results[name] = f"VALUES rows={len(s_rows)} first diffs={diff}"
        else:
            results[name] = f"ok rows={len(s_rows)} spark={t1 - t0:.1f}s"
        if verbose:
            print(f"{name:28s} {results[name]}", flush=True)
    return results


if __name__ == "__main__":
    from fleetlake.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = local_session()
    res = compare(spark, sf, names)
    bad = {k: v for k, v in res.items() if not (v.startswith("ok") or v.startswith("no-sql"))}
    print(f"{len(res) - len(bad)}/{len(res)} pass")
    sys.exit(1 if bad else 0)
