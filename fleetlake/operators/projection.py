"""Column shaping (D1-D7): include/exclude, renames, suffix typing, transformers.

All of these only touch the plan's projection; Catalyst prunes the scan to
the columns that survive.
"""

from __future__ import annotations

from typing import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import datetime_text, lower_camel, uuid_text
from .predicates import resolve_name


def include_exclude(df: DataFrame, include: Iterable[str] | None = None,
                    exclude: Iterable[str] | None = None) -> DataFrame:
    """Keep ``include`` (empty = all), then drop ``exclude`` (exclude wins)."""
    inc, exc = set(include or ()), set(exclude or ())
    cols = [c for c in df.columns if (not inc or c in inc) and c not in exc]
    return df.select(*cols)


def camel_case_columns(df: DataFrame) -> DataFrame:
    """snake_case -> lowerCamelCase."""
    return df.toDF(*[lower_camel(c) for c in df.columns])


def lower_case_columns(df: DataFrame) -> DataFrame:
    """D3."""
    return df.toDF(*[c.lower() for c in df.columns])


def datetimes_as_text(df: DataFrame) -> DataFrame:
    """K1 on every timestamp column (the record-to-dict formatting)."""
    ts_types = (T.TimestampType, T.TimestampNTZType)
    return df.select(*[datetime_text(f.name).alias(f.name) if isinstance(f.dataType, ts_types)
                       else F.col(f.name) for f in df.schema.fields])


def identifiers_as_text(df: DataFrame) -> DataFrame:
    """K7 on every binary column; enum values are text already."""
    return df.select(*[uuid_text(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else F.col(f.name)
                       for f in df.schema.fields])


def as_records(df: DataFrame, include=None, exclude=None) -> DataFrame:
    """Row-to-dict shaping: D1 + K1 + K7 + D2 in one projection."""
    return camel_case_columns(identifiers_as_text(datetimes_as_text(include_exclude(df, include, exclude))))


def select_keys_metric(df: DataFrame, keys: Sequence[str], metric: str | None = None,
                       value_columns: Sequence[str] | None = None) -> DataFrame:
    """Key columns plus one metric, names checked case-insensitively.

    The metric defaults to the first value column that is not a key.
    """
    key_cols = [resolve_name(df, k) for k in keys]
    if metric is None:
        candidates = [c for c in (value_columns or df.columns) if c.lower() not in {k.lower() for k in key_cols}]
        if not candidates:
            raise ValueError("no metric column left after the keys")
        metric = candidates[0]
    return df.select(*key_cols, resolve_name(df, metric))


# Column-name suffix/prefix -> stored type.
def suffix_type(name: str) -> T.DataType:
    upper = name.upper()
    if upper.endswith("_COUNT") or upper.endswith("_ID"):
        return T.LongType()
    if upper.endswith("_DURATION") or upper.startswith("AVG_"):
        return T.DoubleType()
    return T.StringType()


def metric_schema(columns: Sequence[str], stamp_column: str = "created_at") -> T.StructType:
    """The metric table schema for configured columns (names lower-cased)."""
    fields = [T.StructField(c.lower(), suffix_type(c), True) for c in columns]
    if stamp_column and stamp_column not in {f.name for f in fields}:
        fields.append(T.StructField(stamp_column, T.StringType(), True))
    return T.StructType(fields)


def cast_by_suffix(df: DataFrame) -> DataFrame:
    """D6 + D3: lower-case names and cast each column to its suffix type."""
    return df.select(*[F.col(c).cast(suffix_type(c)).alias(c.lower()) for c in df.columns])


# The transformer registry - name -> function(Column) -> Column.
TRANSFORMERS: dict[str, Callable[[Column], Column]] = {
    "datetime": datetime_text,
    "datetime_to_string": datetime_text,
}


def register_transformer(name: str, fn: Callable[[Column], Column]) -> None:
    TRANSFORMERS[name] = fn


def apply_transformers(df: DataFrame, config: Sequence[Mapping]) -> DataFrame:
    """``[{"type": name, "columns": [...]}, ...]`` applied in order."""
    for step in config or ():
        fn = TRANSFORMERS[step["type"]]
        cols = [resolve_name(df, c) for c in step.get("columns", ())]
        df = df.withColumns({c: fn(F.col(c)) for c in cols})
    return df


def with_labels(df: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """Attach descriptions as column metadata (read back by D4 exports)."""
    return df.select(*[F.col(c).alias(c, metadata={"description": labels[c]}) if c in labels
                       else F.col(c) for c in df.columns])
