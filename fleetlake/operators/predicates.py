"""Predicates (E1-E11) as Column builders.

Everything here produces plain ``Column`` expressions (comparisons, ranges,
``contains``, ``isin``) that Catalyst pushes into the Parquet scan where the
column is stored. Column names coming from callers are checked against the
schema first (S9); values are always bound as literals.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from typing import Any, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class UnknownColumn(ValueError):
    pass


def resolve_name(df: DataFrame, name: str) -> str:
    """Validate a caller-supplied column name, case-insensitively."""
    lookup = {c.lower(): c for c in df.columns}
    try:
        return lookup[name.lower()]
    except KeyError:
        raise UnknownColumn(f"unknown column {name!r}; have {df.columns}") from None


def parse_day(text: str | dt.date | dt.datetime | None) -> dt.datetime | None:
    """K3/K4: ``YYYY-MM-DD`` (or ISO with a trailing ``Z``) -> midnight datetime.

    Raises on malformed text, as the reference does.
    """
    if text is None or isinstance(text, dt.datetime):
        return text and wall_time(text)
    if isinstance(text, dt.date):
        return dt.datetime(text.year, text.month, text.day)
    s = text.strip()
    if len(s) == 10:
        return dt.datetime.strptime(s, "%Y-%m-%d")
    # An offset is applied, not dropped: the wall time kept is UTC.
    return wall_time(dt.datetime.fromisoformat(s[:-1] if s.endswith("Z") else s))


def wall_time(moment: dt.datetime) -> dt.datetime:
    """A time with an offset as the wall time in UTC (S13); others as they are."""
    return moment.astimezone(dt.timezone.utc).replace(tzinfo=None) if moment.tzinfo else moment


def literal(value: Any) -> Column:
    """A bound value.  Times are bound as text cast to ``timestamp_ntz`` (a
    constant after folding, so it is still pushed to the scan): a Python
    datetime literal would shift with the time zone of the driver's system.
    An offset is applied, not dropped."""
    if isinstance(value, dt.datetime):
        return F.lit(wall_time(value).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def time_literal(value) -> Column:
    """Day or time text (or a date, datetime) as a ``timestamp_ntz`` constant."""
    return literal(parse_day(value))


def all_of(preds: Iterable[Column | None]) -> Column:
    """AND of the given predicates; absent ones (None) are skipped."""
    kept = [p for p in preds if p is not None]
    return reduce(lambda a, b: a & b, kept, F.lit(True)) if kept else F.lit(True)


def optional_eq(c: str | Column, value: Any) -> Column | None:
    """Equality, skipped only when the value is absent (S4: 0 is a value)."""
    if value is None:
        return None
    col = F.col(c) if isinstance(c, str) else c
    return col == literal(value)


def closed_range(c: str | Column, start, end, end_inclusive_day: bool = False) -> Column:
    """``start <= c <= end``.

    With dates as input the reference compares against midnight of the end
    day, dropping the rest of that day (S1).  ``end_inclusive_day=True`` keeps
    the whole end day (``c < end + 1 day``).
    """
    col = F.col(c) if isinstance(c, str) else c
    lo, hi = parse_day(start), parse_day(end)
    pred = col >= literal(lo)
    if end_inclusive_day:
        return pred & (col < literal(hi + dt.timedelta(days=1)))
    return pred & (col <= literal(hi))


def open_range(c: str | Column, start=None, end=None) -> Column | None:
    """``c >= start`` and/or ``c <= end``, each optional."""
    col = F.col(c) if isinstance(c, str) else c
    parts = []
    if start is not None:
        parts.append(col >= time_literal(start))
    if end is not None:
        parts.append(col <= time_literal(end))
    return all_of(parts) if parts else None


def icontains(c: str | Column, text: str | None) -> Column | None:
    """Case-insensitive substring test; ``%`` and ``_`` are literal here."""
    if text is None or text == "":
        return None
    col = F.col(c) if isinstance(c, str) else c
    return F.contains(F.lower(col), F.lit(text.lower()))


def one_of(c: str | Column, values: Iterable | None) -> Column | None:
    """E5: membership in a list (skipped when no list is given)."""
    if values is None:
        return None
    vals = list(values)
    if not vals:
        return None
    col = F.col(c) if isinstance(c, str) else c
    return col.isin(vals)


def eq_or_contains(eq_col: str, contains_col: str, value: str | None) -> Column | None:
    """``eq_col = v OR contains_col contains v`` (case-insensitive)."""
    if not value:
        return None
    return (F.col(eq_col) == F.lit(value)) | icontains(contains_col, value)


def is_null(c: str | Column) -> Column:
    """E7."""
    return (F.col(c) if isinstance(c, str) else c).isNull()


def since_day(c: str | Column, day) -> Column:
    """The 'today' test, ``c >= day`` with the day passed in (never the clock)."""
    return (F.col(c) if isinstance(c, str) else c) >= time_literal(day)


def dynamic_filters(df: DataFrame, filters: Mapping[str, Any] | Iterable[Mapping[str, Any]] | None) -> Column | None:
    """AND of ``name = value`` pairs, given as one mapping or a list of
    mappings; null values are skipped; names checked."""
    if not filters:
        return None
    pairs = [kv for m in ([filters] if isinstance(filters, Mapping) else filters) for kv in m.items()]
    preds = [F.col(resolve_name(df, k)) == literal(v) for k, v in pairs if v is not None]
    return all_of(preds) if preds else None


def where(df: DataFrame, *preds: Column | None) -> DataFrame:
    """Apply the present predicates as one filter."""
    kept = [p for p in preds if p is not None]
    return df.filter(all_of(kept)) if kept else df


def point_lookup(df: DataFrame, id_col: str, value) -> DataFrame:
    """The row with the id, as a frame (empty when missing)."""
    return df.filter(F.col(id_col) == literal(value)).limit(1)


class NotFound(KeyError):
    pass


def get_one(df: DataFrame, id_col: str, value):
    """The row with the id as a ``Row``; raises ``NotFound`` when missing
    (reads at most one row)."""
    rows = point_lookup(df, id_col, value).take(1)
    if not rows:
        raise NotFound(f"{id_col}={value!r} does not exist")
    return rows[0]
