"""The metric-store entry points.

Three calls with the reference's shapes, on DataFrames and a keyed table:

* ``store_metrics(table, rows, run_ts)``: lower-case names, type by suffix,
  narrow decimals, stamp ``created_at``, upsert by the table's key;
* ``query_metrics(metrics, start, end, filters, timestamp_column,
  selected_fields)``: closed time range, AND of (name, value) filters with
  null values skipped, named columns or all;
* ``get_metrics(metrics, start, end, dimensions, metric, key_columns,
  value_columns, timestamp_column)``: the endpoint form - ISO dates (a
  trailing ``Z`` accepted), dimensions as JSON text, keys plus one metric
  (by default the first value column that is not a key).

Names always go through the schema check (S9); failures raise (S16).
"""

from __future__ import annotations

import json
from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.predicates import closed_range, dynamic_filters, parse_day, resolve_name, where
from ..operators.projection import cast_by_suffix, select_keys_metric
from ..sinks.upsert import KeyedTable, latest_per_key, stamp


def store_metrics(table: KeyedTable, rows: DataFrame, run_ts: str) -> list:
    """Upsert metric rows into ``table``: whole rows replaced, last write wins,
    and of several rows of a key in ``rows`` the last."""
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    typed = cast_by_suffix(rows.select(*[
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
        else F.col(f.name) for f in rows.schema.fields if f.name != "__row"], F.col("__row").alias("__row_id")))
    picked = latest_per_key(typed, table.keys, ["__row_id"]).drop("__row_id")
    return table.upsert(stamp(picked, run_ts))


def query_metrics(metrics: DataFrame, start_date, end_date,
                  filters: Mapping | Sequence[Mapping] | None = None,
                  timestamp_column: str = "created_at",
                  selected_fields: Sequence[str] | None = None) -> DataFrame:
    """Rows in ``[start, end]`` on the timestamp column matching every filter."""
    ts = resolve_name(metrics, timestamp_column)
    col = F.col(ts)
    if isinstance(metrics.schema[ts].dataType, T.StringType):
        col = F.to_timestamp_ntz(col)          # stored as text: compare as time
    rows = where(metrics, closed_range(col, start_date, end_date), dynamic_filters(metrics, filters))
    if selected_fields:
        rows = rows.select(*[resolve_name(metrics, c) for c in selected_fields])
    return rows


def parse_dimensions(dimensions: str | Mapping | Sequence[Mapping] | None) -> list[dict]:
    """K8: the dimension filter given as JSON text: a list of objects of
    name: value (a single object counts as a list of one)."""
    value = json.loads(dimensions) if isinstance(dimensions, str) and dimensions else dimensions or []
    value = [value] if isinstance(value, Mapping) else list(value)
    if not all(isinstance(v, Mapping) for v in value):
        raise ValueError("dimensions must be a JSON list of objects")
    return [dict(v) for v in value]


def get_metrics(metrics: DataFrame, start_date: str, end_date: str,
                dimensions: str | Mapping | Sequence[Mapping] | None = None, metric: str | None = None,
                key_columns: Sequence[str] = (), value_columns: Sequence[str] | None = None,
                timestamp_column: str = "created_at") -> DataFrame:
    """Keys plus one metric over a closed range, filtered by JSON dimensions."""
    start, end = parse_day(start_date), parse_day(end_date)   # K4: raises on bad text
    rows = query_metrics(metrics, start, end, parse_dimensions(dimensions), timestamp_column)
    if metric is not None:
        resolve_name(metrics, metric)                          # unknown metric -> error
        if value_columns is not None and metric.lower() not in {c.lower() for c in value_columns}:
            raise ValueError(f"{metric!r} is not one of the value columns {list(value_columns)}")
    return select_keys_metric(rows, list(key_columns), metric, value_columns)
