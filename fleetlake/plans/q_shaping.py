"""Projection and renaming queries."""

from __future__ import annotations

from ..operators.projection import apply_transformers, as_records, include_exclude
from ..sources.tables import table
from .catalogue import query


@query("project_exclude", "D1", """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer
""")
def project_exclude(spark, sf_dir):
    """All columns but the sensitive one (include empty = all, exclude wins)."""
    return include_exclude(table(spark, sf_dir, "customer"), include=None, exclude=["c_acctbal"])


@query("camel_rename", "D2 K1 D1", """
SELECT event_id AS eventId, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id AS userId,
       event_type AS eventType, value
FROM events
""")
def camel_rename(spark, sf_dir):
    """Row-to-record shaping: drop ``props``, datetimes as text, camelCase names."""
    return as_records(table(spark, sf_dir, "events"), exclude=["props"])


@query("datetime_to_string", "D7 K1 U1", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders
""")
def datetime_to_string(spark, sf_dir):
    """Configured transformer list: ``datetime_to_string`` on ``o_orderdate``."""
    config = [{"type": "datetime_to_string", "columns": ["o_orderdate"]}]
    return apply_transformers(table(spark, sf_dir, "orders"), config)
