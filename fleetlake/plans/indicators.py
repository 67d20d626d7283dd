"""Indicator queries (D8), paging (I1/I2), totals (G1) and export.

Each indicator kind has a declared column contract: output name, type,
text format and description.  The contract travels with the DataFrame as
``StructField`` metadata, and the export renames columns to descriptions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import datetime_text
from ..operators.paging import page as page_rows
from ..operators.predicates import closed_range, optional_eq, where

DATETIME_FMT = "%Y-%m-%d %H:%M:%S"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    kind: str            # string | float | int | boolean | datetime
    description: str
    fmt: str | None = None


@dataclass(frozen=True)
class IndicatorSpec:
    kind: str
    columns: tuple[ColumnSpec, ...]
    time_column: str = "create_time"      # column of the source view the range applies to
    order: tuple[str, ...] = ("create_time", "id")
    live: bool = False                    # True where the reference returns real rows


def _c(name, kind, description, fmt=None):
    return ColumnSpec(name, kind, description, DATETIME_FMT if kind == "datetime" and fmt is None else fmt)


# The seven indicator kinds and their declared column contracts
# (names, types); descriptions are ours.
INDICATORS: dict[str, IndicatorSpec] = {
    "history_track": IndicatorSpec("history_track", (
        _c("createTime", "datetime", "Record time"), _c("vin", "string", "Device ID"),
        _c("longitude", "float", "Longitude"), _c("latitude", "float", "Latitude"),
        _c("speed", "float", "Speed"), _c("direction", "float", "Direction"),
        _c("status", "string", "Status"), _c("timestamp", "datetime", "Timestamp"))),
    "robot_charging": IndicatorSpec("robot_charging", (
        _c("createTime", "datetime", "Record time"), _c("vin", "string", "Device ID"),
        _c("batteryLevel", "float", "Battery level"), _c("chargingPower", "float", "Charging power"),
        _c("temperature", "float", "Temperature"), _c("chargingTime", "int", "Charging time"),
        _c("chargingVoltage", "float", "Charging voltage"),
        _c("chargingCurrent", "float", "Charging current"),
        _c("voltage", "float", "Voltage"), _c("current", "float", "Current"))),
    "robot_usage": IndicatorSpec("robot_usage", (
        _c("createTime", "datetime", "Record time"), _c("vin", "string", "Device ID"),
        _c("totalHours", "float", "Total hours"), _c("activeHours", "float", "Active hours"),
        _c("idleHours", "float", "Idle hours"), _c("powerCycles", "int", "Power cycles"),
        _c("lastActivated", "datetime", "Last activated"))),
    "robot_task": IndicatorSpec("robot_task", (
        _c("vin", "string", "Device ID"), _c("taskType", "string", "Task type"),
        _c("taskStatus", "string", "Task status"), _c("startTime", "datetime", "Start time"),
        _c("endTime", "datetime", "End time"), _c("duration", "int", "Duration (s)")),
        time_column="task_start_time", order=("task_start_time", "id"), live=True),
    "abnormal_data": IndicatorSpec("abnormal_data", (
        _c("createTime", "datetime", "Record time"), _c("vin", "string", "Device ID"),
        _c("anomalyType", "string", "Anomaly type"), _c("severity", "string", "Severity"),
        _c("description", "string", "Description"), _c("detectedTime", "datetime", "Detected at"),
        _c("resolvedTime", "datetime", "Resolved at"), _c("isResolved", "boolean", "Resolved"),
        _c("alertCount", "int", "Alert count"))),
    "robot_event": IndicatorSpec("robot_event", (
        _c("vin", "string", "Device ID"), _c("eventType", "string", "Event type"),
        _c("eventTime", "string", "Event time"), _c("description", "string", "Description"),
        _c("recordTime", "datetime", "Record time")),
        time_column="event_time", order=("event_time", "id"), live=True),
    "environment": IndicatorSpec("environment", (
        _c("createTime", "datetime", "Record time"), _c("vin", "string", "Device ID"),
        _c("temperature", "float", "Temperature"), _c("humidity", "float", "Humidity"),
        _c("airQuality", "float", "Air quality"), _c("noise", "float", "Noise"),
        _c("light", "float", "Light"))),
}

_SPARK_TYPE = {"string": "string", "float": "double", "int": "bigint",
               "boolean": "boolean", "datetime": "string"}


def _source_name(spec_col: str) -> str:
    """Contract name -> source view column (snake_case) for the live kinds."""
    out = []
    for ch in spec_col:
        out.append("_" + ch.lower() if ch.isupper() else ch)
    return "".join(out)


# Source view column for each contract column where the names differ.
TASK_SOURCES = {"taskType": "task_type", "taskStatus": "status", "startTime": "task_start_time",
                "endTime": "task_end_time", "duration": "task_usage_time"}


def project(spec: IndicatorSpec, view: DataFrame, sources: dict[str, str] | None = None) -> DataFrame:
    """Declared columns with types, datetime text and metadata attached."""
    sources = sources or {}
    cols: list[Column] = []
    for cs in spec.columns:
        src = F.col(sources.get(cs.name, _source_name(cs.name)))
        stored = view.schema[sources.get(cs.name, _source_name(cs.name))].dataType
        if cs.kind == "datetime" or isinstance(stored, (T.TimestampType, T.TimestampNTZType)):
            src = datetime_text(src)
        else:
            src = src.cast(_SPARK_TYPE[cs.kind])
        meta = {"type": cs.kind, "description": cs.description}
        if cs.fmt:
            meta["format"] = cs.fmt
        cols.append(src.alias(cs.name, metadata=meta))
    return view.select(*cols)


@dataclass
class IndicatorQuery:
    kind: str
    start_date: str
    end_date: str
    vin: str | None = None
    end_inclusive_day: bool = False
    extra: dict = field(default_factory=dict)


def device_is(view: DataFrame, column: str, device: str | None) -> Column | None:
    """Equality on the device id as it is stored, so it reaches the scan: text
    that is no number matches no numeric id."""
    if device is None or not isinstance(view.schema[column].dataType, T.IntegralType):
        return optional_eq(column, device)
    text = str(device).strip()
    return optional_eq(column, int(text)) if text.isascii() and text.lstrip("-").isdigit() else F.lit(False)


def filtered(spec: IndicatorSpec, view: DataFrame, q: IndicatorQuery) -> DataFrame:
    """E1 + E2 on the source view (before projection, so the scan gets them)."""
    return where(view,
                 device_is(view, "vin", q.vin),
                 closed_range(spec.time_column, q.start_date, q.end_date, q.end_inclusive_day))


def indicator(view: DataFrame, q: IndicatorQuery, page: int | None = None,
              page_size: int = 10, sources: dict[str, str] | None = None,
              ordered: bool = False) -> DataFrame:
    """Rows of one indicator kind: filter, optional page in total order (S2), contract.

    ``page=None`` returns every matching row; ``ordered=True`` sorts them
    (a range-partitioned global sort, only worth it when the caller needs order).
    """
    spec = INDICATORS[q.kind]
    rows = filtered(spec, view, q)
    if page is not None:
        rows = page_rows(rows, list(spec.order), page, page_size)
    elif ordered:
        rows = rows.orderBy(*spec.order)
    return project(spec, rows, sources)


def total(view: DataFrame, q: IndicatorQuery) -> DataFrame:
    """G1/S3: the count of the unpaged filter, as one row."""
    spec = INDICATORS[q.kind]
    return filtered(spec, view, q).agg(F.count(F.lit(1)).alias("total"))


def labelled(df: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Rename columns to their descriptions (metadata or a given map);
    columns without a label keep their name."""
    mapping = {}
    for f in df.schema.fields:
        label = (labels or {}).get(f.name) or (f.metadata or {}).get("description")
        if label:
            mapping[f.name] = label
    return df.withColumnsRenamed(mapping) if mapping else df


def export_rows(view: DataFrame, q: IndicatorQuery, limit: int | None = None,
                sources: dict[str, str] | None = None) -> DataFrame:
    """I3 + D4: every matching row, labelled; with ``limit`` the first ``limit``
    rows in (time, id) order (``export_summary`` says whether that cut any)."""
    spec = INDICATORS[q.kind]
    rows = filtered(spec, view, q)
    if limit is not None:
        rows = rows.orderBy(*spec.order).limit(limit)
    return labelled(project(spec, rows, sources))


def export_summary(view: DataFrame, q: IndicatorQuery, limit: int | None = None) -> DataFrame:
    """One row about an export: matching rows, exported rows, truncated."""
    n = F.col("total")
    kept = n if limit is None else F.least(n, F.lit(limit).cast("long"))
    return total(view, q).select(n.alias("matching"), kept.alias("exported"), (kept < n).alias("truncated"))
