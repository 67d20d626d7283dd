"""Joins (F1-F6).

No side is broadcast by hint: Spark broadcasts a side under the session's
threshold, AQE decides again from measured shuffle sizes, and anything larger
is joined by shuffle with skewed partitions split.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import one_of


def role_lookup(rows: DataFrame, dim: DataFrame, roles: Sequence[tuple[str, str]],
                dim_key: str = "id", dim_cols: Sequence[str] = ("name", "type")) -> DataFrame:
    """join the same dimension once per role (left join, S14).

    ``roles`` holds (foreign key column, output prefix) pairs, for example
    ``[("source_id", "source"), ("target_id", "target")]``.
    """
    out = rows
    for fk, prefix in roles:
        side = dim.select(F.col(dim_key).alias(f"__{prefix}_key"),
                            *[F.col(c).alias(f"{prefix}_{c}") for c in dim_cols])
        out = out.join(side, out[fk] == side[f"__{prefix}_key"], "left").drop(f"__{prefix}_key")
    return out


def filter_through(rows: DataFrame, fk: str, dim: DataFrame, dim_key: str,
                   dim_col: str, values: Iterable | None) -> DataFrame:
    """F2/E5: keep rows whose referenced dimension row has ``dim_col`` in
    ``values``; an absent or empty list is no filter.

    A left-semi join against the filtered dimension: no columns are added and
    each row is kept at most once.
    """
    wanted = one_of(dim_col, values)
    if wanted is None:
        return rows
    keys = dim.filter(wanted).select(F.col(dim_key).alias("__fk"))
    return rows.join(keys, rows[fk] == keys["__fk"], "left_semi")


def unknown_key(fk: str, dim: DataFrame, dim_key: str) -> Column:
    """whether ``fk`` has no dimension row (a null key has none)."""
    keys = dim.select(F.col(dim_key).alias("__k"))
    return ~keys.where(F.col("__k") == F.col(fk).outer()).exists()


def reject_unknown(rows: DataFrame, fks: Sequence[str], dim: DataFrame, dim_key: str) -> DataFrame:
    """rows whose foreign key (any of ``fks``) has no dimension row.

    One pass: each key is an existence join that only adds a flag, so equal
    rows stay as often as they come and a repeated dimension key does no harm.
    """
    bad = unknown_key(fks[0], dim, dim_key)
    for fk in fks[1:]:
        bad = bad | unknown_key(fk, dim, dim_key)
    return rows.where(bad)


def new_unique(candidates: DataFrame, existing: DataFrame, key: Sequence[str] | str,
               order_by: Sequence[str] | str | None = None) -> DataFrame:
    """candidate rows whose key is not taken yet.

    Within the batch the first row per key wins (by ``order_by``); the choice is
    a ``min_by`` aggregate, so a hot key is combined map-side instead of being
    sent to one task whole.
    """
    keys = [key] if isinstance(key, str) else list(key)
    fresh = candidates.join(existing.select(*keys), keys, "left_anti")
    if order_by is None:
        return fresh.dropDuplicates(keys)
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    others = [c for c in fresh.columns if c not in keys]
    picked = (fresh.groupBy(*keys)
              .agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row")))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others]) \
        .select(*candidates.columns)
