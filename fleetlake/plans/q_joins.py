"""Join queries: role-playing dimension, filter through a key, reject/unique checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import filter_through, new_unique, reject_unknown, role_lookup
from ..operators.predicates import eq_or_contains, optional_eq, where
from ..sources.tables import table
from . import params as P
from .catalogue import query
from .standins import registry_view, sync_view

ROLES = [("source_id", "source"), ("target_id", "target")]

_SYNC_SQL = """
WITH reg AS (
  SELECT n_nationkey AS id, n_name AS name, r_name AS type
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
sync AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_returnflag AS type, l.l_linestatus AS status,
         c.c_nationkey AS source_id, s.s_nationkey AS target_id
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey)
"""

_LOOKUP_COLS = """
SELECT sync.*, rs.name AS source_name, rs.type AS source_type,
       rt.name AS target_name, rt.type AS target_type
FROM sync LEFT JOIN reg rs ON sync.source_id = rs.id
          LEFT JOIN reg rt ON sync.target_id = rt.id
"""


@query("role_dim_lookup", "F1 F3 S14", _SYNC_SQL + _LOOKUP_COLS)
def role_dim_lookup(spark, sf_dir):
    """Every sync row with its source and target registry name and type."""
    return role_lookup(sync_view(spark, sf_dir), registry_view(spark, sf_dir), ROLES)


@query("role_dim_filter", "F2 E5 E10 S4", _SYNC_SQL + """
SELECT * FROM (""" + _LOOKUP_COLS + """) x
WHERE source_type IN ('ASIA', 'EUROPE') AND target_type IN ('AMERICA')
  AND type = 'R' AND status = 'F'
""")
def role_dim_filter(spark, sf_dir):
    """Sync rows filtered by the source and target registry types (a list each)
    and by their own type and status."""
    reg = registry_view(spark, sf_dir)
    rows = sync_view(spark, sf_dir)
    rows = filter_through(rows, "source_id", reg, "id", "type", ["ASIA", "EUROPE"])
    rows = filter_through(rows, "target_id", reg, "id", "type", ["AMERICA"])
    rows = where(rows, optional_eq("type", "R"), optional_eq("status", "F"))
    return role_lookup(rows, reg, ROLES)


@query("fk_reject", "F4", _SYNC_SQL + f"""
, open_reg AS (SELECT id FROM reg WHERE type <> '{P.FK_CLOSED_REGION}')
SELECT * FROM sync
WHERE source_id IS NULL OR target_id IS NULL
   OR source_id NOT IN (SELECT id FROM open_reg) OR target_id NOT IN (SELECT id FROM open_reg)
""")
def fk_reject(spark, sf_dir):
    """Sync rows whose source or target is not an open registry entry."""
    reg = registry_view(spark, sf_dir)
    return reject_unknown(sync_view(spark, sf_dir), ["source_id", "target_id"],
                          reg.filter(F.col("type") != P.FK_CLOSED_REGION), "id")


@query("unique_new_rows", "F5 I4", """
SELECT DISTINCT ON (o_custkey, o_orderpriority) * FROM orders n
WHERE o_orderstatus = 'O'
  AND NOT EXISTS (SELECT 1 FROM orders e WHERE e.o_orderstatus <> 'O' AND e.o_custkey = n.o_custkey
                    AND e.o_orderpriority = n.o_orderpriority)
ORDER BY o_custkey, o_orderpriority, o_orderkey
""")
def unique_new_rows(spark, sf_dir):
    """Open orders whose (customer, priority) no other order has taken yet; the
    first order per pair."""
    orders = table(spark, sf_dir, "orders")
    existing = orders.filter(F.col("o_orderstatus") != "O")
    candidates = orders.filter(F.col("o_orderstatus") == "O")
    return new_unique(candidates, existing, ["o_custkey", "o_orderpriority"], order_by="o_orderkey")


@query("or_search", "E6 E4", """
SELECT * FROM customer
WHERE (c_mktsegment = 'BUILDING' OR contains(lower(c_name), 'building'))
   OR (c_mktsegment = 'customer#0000001' OR contains(lower(c_name), 'customer#0000001'))
""")
def or_search(spark, sf_dir):
    """``type = v OR name contains v`` (case-insensitive), twice over one table."""
    cust = table(spark, sf_dir, "customer")
    a = eq_or_contains("c_mktsegment", "c_name", "BUILDING")
    b = eq_or_contains("c_mktsegment", "c_name", "customer#0000001")
    return cust.filter(a | b)
