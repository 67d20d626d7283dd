"""Access-audit search and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import first_forwarded
from .predicates import icontains, is_null, open_range, optional_eq, since_day, where


def audit_filter(audit: DataFrame, query_user: str | None = None,
                 query_indicator: str | None = None, start_date=None, end_date=None,
                 ip_address: str | None = None) -> DataFrame:
    """Search: user and indicator contain (case-insensitive), open date range,
    exact address; every filter optional."""
    return where(audit,
                 icontains("query_user", query_user),
                 icontains("query_indicator", query_indicator),
                 open_range("create_time", start_date, end_date),
                 optional_eq("ip_address", ip_address))


def audit_summary(audit: DataFrame, run_day, query_user: str | None = None,
                  query_indicator: str | None = None, start_date=None, end_date=None,
                  ip_address: str | None = None) -> DataFrame:
    """G3 in one pass: filtered total, today's total, no-address total and
    today's no-address total (the last three ignore the search filters, as
    in the reference).  Each count is a ``count_if`` over a flag column."""
    search = [p for p in (icontains("query_user", query_user),
                          icontains("query_indicator", query_indicator),
                          open_range("create_time", start_date, end_date),
                          optional_eq("ip_address", ip_address)) if p is not None]
    flag = F.lit(True)
    for p in search:
        flag = flag & p
    today = since_day("create_time", run_day)
    no_ip = is_null("ip_address")
    return audit.agg(
        F.count_if(F.coalesce(flag, F.lit(False))).alias("access_total"),
        F.count_if(today).alias("today_access_total"),
        F.count_if(no_ip).alias("abnormal_access_total"),
        F.count_if(today & no_ip).alias("today_abnormal_access_total"))


def with_client_ip(df: DataFrame, forwarded: str, peer: str, out: str = "client_ip") -> DataFrame:
    """K5 as a column of the request log."""
    return df.withColumn(out, first_forwarded(forwarded, peer))


def append_audit(df: DataFrame, path: str) -> None:
    """One row per request, appended."""
    df.write.mode("append").parquet(path)
