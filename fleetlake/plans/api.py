"""Call shapes of the reference's list, indicator, audit and task entry points.

Each call composes the operators and returns DataFrames: the page of
records (ordered by time and id, S2) and the total of the unpaged filter as
a one-row frame (S3).  Nothing is collected; the caller decides what to fetch.
"""

from __future__ import annotations

from typing import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import audit_filter, audit_summary
from ..operators.joins import filter_through, role_lookup
from ..operators.paging import page as page_rows
from ..operators.predicates import eq_or_contains, icontains, optional_eq, where
from ..operators.projection import apply_transformers, include_exclude
from ..sinks.writers import export_csv, export_name
from ..sources.incremental import StateStore, SyncSpec, run_sync
from ..sources.messages import keyed_json
from .indicators import INDICATORS, IndicatorQuery, export_rows, export_summary, indicator, total

MAX_PAGE_SIZE = 100


def _total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def query_indicator_data(view: DataFrame, start_date: str, end_date: str, indicator_type: str,
                         vin: str | None = None, page: int = 1, page_size: int = 10,
                         sources: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Indicator page + total for one kind (the view holds that kind's rows)."""
    q = IndicatorQuery(indicator_type, start_date, end_date, vin=vin)
    return indicator(view, q, page=page, page_size=page_size, sources=dict(sources or {})), total(view, q)


def export_indicator_data(view: DataFrame, start_date: str, end_date: str, indicator_type: str,
                          folder: str, vin: str | None = None, limit: int | None = None,
                          sources: Mapping[str, str] | None = None) -> tuple[str, DataFrame]:
    """Labelled CSV export of every matching row, or of the first ``limit``;
    returns the output path and the summary (matching, exported, truncated)."""
    q = IndicatorQuery(indicator_type, start_date, end_date, vin=vin)
    rows = export_rows(view, q, limit=limit, sources=dict(sources or {}))
    return export_csv(rows, folder, export_name(indicator_type, start_date, end_date)), export_summary(view, q, limit)


def get_security_audits(audit: DataFrame, run_day, page: int = 1, page_size: int = 10,
                        query_user: str | None = None, query_indicator: str | None = None,
                        start_date=None, end_date=None,
                        ip_address: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Audit page + the four summary counts (filtered total, today, no address,
    today without address)."""
    rows = audit_filter(audit, query_user, query_indicator, start_date, end_date, ip_address)
    summary = audit_summary(audit, run_day, query_user, query_indicator, start_date, end_date,
                            ip_address)
    return page_rows(rows, ["create_time", "id"], page, page_size), summary


def get_collect_list(sync_rows: DataFrame, registry: DataFrame, type: str | None = None,
                     source_type: Iterable[str] | None = None,
                     target_type: Iterable[str] | None = None, status=None, name: str | None = None,
                     order_by: Sequence[str] = ("id",), page: int = 1,
                     page_size: int = 10) -> tuple[DataFrame, DataFrame]:
    """Sync definitions filtered by type, source/target type lists (through the
    registry), status (0 is a value, S4) and name contains; with both roles'
    registry name and type attached (left joins, S14)."""
    rows = filter_through(sync_rows, "source_id", registry, "id", "type", source_type)
    rows = filter_through(rows, "target_id", registry, "id", "type", target_type)
    rows = where(rows, optional_eq("type", type), optional_eq("status", status),
                 icontains("name", name) if "name" in rows.columns else None)
    rows = role_lookup(rows, registry, [("source_id", "source"), ("target_id", "target")])
    return page_rows(rows, list(order_by), page, page_size), _total(rows)


def get_database_list(registry: DataFrame, type_or_name: str | None = None, page: int = 1,
                      page_size: int = 10, exclude: Sequence[str] = ("password",),
                      order_by: Sequence[str] = ("id",)) -> tuple[DataFrame, DataFrame]:
    """Registry entries where type equals or name contains the text; the
    password column never leaves (D1)."""
    if page_size > MAX_PAGE_SIZE:
        raise ValueError(f"page_size is at most {MAX_PAGE_SIZE}")
    rows = include_exclude(where(registry, eq_or_contains("type", "name", type_or_name)),
                           exclude=exclude)
    return page_rows(rows, list(order_by), page, page_size), _total(rows)


def process_task(spark: SparkSession, source: DataFrame, spec: SyncSpec, state: StateStore,
                 key_column: str, sink, transformers: Sequence[Mapping] = (),
                 upper: str | None = None, run_day: str | None = None) -> dict:
    """One sync/metric task run: increment -> transformers -> keyed JSON ->
    ``sink(messages)`` -> state commit (S7 order, empty batches skipped)."""
    def write(batch: DataFrame) -> None:
        sink(keyed_json(apply_transformers(batch, list(transformers)), key_column))
    return run_sync(spark, source, spec, write, state, upper=upper, run_day=run_day)


__all__ = ["query_indicator_data", "export_indicator_data", "get_security_audits",
           "get_collect_list", "get_database_list", "process_task", "INDICATORS"]
