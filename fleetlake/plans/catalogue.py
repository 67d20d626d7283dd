"""The registered queries: one per operator family of the inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over the given tables, with
the equivalent DuckDB SQL next to it (``None`` where SQL cannot express it).
Literals (dates, ids, run time) are fixed here, never taken from the clock.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import apply_defaults


@dataclass(frozen=True)
class Registered:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


REGISTRY: dict[str, Registered] = {}


def _day_columns_as_timestamps(df: DataFrame) -> DataFrame:
    """Output convention of the registered queries: calendar days are given as
    midnight ``timestamp_ntz`` (the same value a DuckDB TIMESTAMP holds), so
    day columns compare alike whatever client turns them into Python values."""
    days = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DateType)]
    if not days:
        return df
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in days})


def query(name: str, ops: str, sql: str | None):
    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_defaults(spark)
            return _day_columns_as_timestamps(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = Registered(name, run, sql.strip() if sql else None, ops)
        return run
    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: v.fn for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: v.sql for k, v in REGISTRY.items() if v.sql}


def _load():
    # Importing the modules registers their queries.
    from . import q_indicators, q_sources, q_upsert, q_shaping, q_joins, q_audit, q_layers, q_monitor  # noqa: F401
    from . import q_streaming, q_sync  # noqa: F401
