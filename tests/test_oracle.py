"""Every registered query against its DuckDB SQL at sf0.01 (the correctness gate)."""

import pytest

from __spark_entry__ import entry
from fleetlake.plans.catalogue import oracle_sql, queries
from conftest import SF01
from oracle_compare import compare

NAMES = sorted(queries())


def test_every_query_has_sql_or_is_listed():
    missing = set(queries()) - set(oracle_sql())
    assert missing == set(), f"queries without oracle SQL: {missing}"


def test_entry_smoke(spark):
    df = entry(spark)
    rows = df.collect()
    assert len(rows) == 15
    assert df.columns == ["vin", "eventType", "eventTime", "description", "recordTime"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_duckdb(spark, name):
    res = compare(spark, SF01, [name], verbose=False)[name]
    assert res.startswith("ok"), res
