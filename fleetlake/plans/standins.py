"""The reference's tables, derived from the given tables (FIXTURES.md §3).

Every view is a lazy DataFrame over the Parquet scans, so filters and column
pruning applied later still reach the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import datetime_text, json_int, seconds_between
from ..sources.tables import table


def props_k(c: str = "props"):
    """The integer ``k`` carried in ``events.props``."""
    return json_int(c, "$.k")


def event_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event: vin = user_id, event_type, event_time = ts, description = props."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("vin"),       # text in the contract; kept as stored so filters reach the scan
        "event_type",
        F.col("ts").alias("event_time"),
        F.col("props").alias("description"),
        F.col("ts").alias("record_time"),
    )


def task_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task: one row per order; end = latest ship date of its lines.

    The line side is aggregated per order before the join (partial aggregation
    map-side), so only one row per order is shuffled; the join then reuses
    that hash partitioning on the order key.
    """
    orders = table(spark, sf_dir, "orders")
    ends = (table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey")
            .agg(F.max("l_shipdate").alias("task_end_time")))
    t = orders.join(ends, orders.o_orderkey == ends.l_orderkey, "left")
    return t.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("vin"),
        F.col("o_orderpriority").alias("task_type"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("task_start_time"),
        "task_end_time",
        seconds_between("o_orderdate", "task_end_time").alias("task_usage_time"),
    )


def registry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source registry: id = nation key, name = nation name, type = region name."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
            .select(F.col("n_nationkey").alias("id"),
                    F.col("n_name").alias("name"),
                    F.col("r_name").alias("type"),
                    F.lit(1).alias("status")))


def sync_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sync rows: one per line item; source = customer nation, target = supplier nation.

    The customer nation is attached to orders first (an orders-sized join),
    so line items are shuffled twice (by order key, then by supplier key)
    rather than three times.  Sides are broadcast only where Catalyst's size
    statistics, or AQE's measured shuffle sizes, are under the threshold.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    order_nation = (orders.join(cust, orders.o_custkey == cust.c_custkey, "left")
                    .select("o_orderkey", "c_nationkey"))
    rows = (li.join(order_nation, li.l_orderkey == order_nation.o_orderkey, "left")
            .join(supp, li.l_suppkey == supp.s_suppkey, "left"))
    return rows.select(
        "l_orderkey", "l_linenumber",
        F.col("l_returnflag").alias("type"),
        F.col("l_linestatus").alias("status"),
        F.col("c_nationkey").alias("source_id"),
        F.col("s_nationkey").alias("target_id"),
    )


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device document: one per order, nested from its rows.

    device = customer, type = priority, status = order status, location = the
    customer's nation and market segment, metrics = a map of the order's
    numbers, alerts = its returned lines (null when there are none), battery
    text = the largest discount in percent.
    """
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.max("l_quantity").alias("max_quantity"),
        F.min("l_extendedprice").alias("min_price"), F.max("l_discount").alias("max_discount"),
        F.collect_list(F.when(F.col("l_returnflag") == "R", F.struct(
            F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber").alias("alert_id"),
            F.col("l_linestatus").alias("severity"),
            F.concat(F.lit("returned "), F.col("l_quantity").cast("long").cast("string")).alias("message"),
            datetime_text("l_shipdate").alias("timestamp")))).alias("returned"))   # nulls are left out
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = (orders.join(lines, orders.o_orderkey == lines.l_orderkey, "left")
            .join(customer, orders.o_custkey == customer.c_custkey, "left")
            .join(nation, customer.c_nationkey == nation.n_nationkey, "left"))
    metrics = F.when(F.col("lines").isNull(), F.create_map(F.lit("total_price"), F.col("o_totalprice"))).otherwise(
        F.create_map(F.lit("total_price"), F.col("o_totalprice"), F.lit("lines"), F.col("lines"),
                     F.lit("max_quantity"), F.col("max_quantity"), F.lit("min_price"), F.col("min_price")))
    return rows.select(
        F.col("o_orderkey").alias("doc_id"), F.col("c_name").alias("device_id"),
        datetime_text("o_orderdate").alias("timestamp"), F.col("o_orderpriority").alias("device_type"),
        F.lit(None).cast("string").alias("ip_address"), F.col("o_orderstatus").alias("status"),
        F.struct(F.col("n_name").alias("district"), F.col("c_mktsegment").alias("street"),
                 F.lit(None).cast("double").alias("latitude"),
                 F.lit(None).cast("double").alias("longitude")).alias("location"),
        metrics.alias("metrics"), F.when(F.size("returned") > 0, F.col("returned")).alias("alerts"),
        F.concat(F.round(F.col("max_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("battery_level"),
        F.to_date("o_orderdate").alias("dt"))


def audit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access audit: one request per event; no address when ``k % 10 = 0``."""
    ev = table(spark, sf_dir, "events").withColumn("__k", props_k())   # parsed once
    k = F.col("__k")
    ip = F.when(k % 10 == 0, F.lit(None).cast("string")).otherwise(
        F.concat_ws(".", F.lit("10"), (F.col("user_id") % 256).cast("string"),
                    k.cast("string"), F.lit("1")))
    return ev.select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("query_indicator"),
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("query_user"),
        F.concat(F.lit("reason "), k.cast("string")).alias("query_reason"),
        ip.alias("ip_address"),
        F.col("ts").alias("create_time"),
    )
