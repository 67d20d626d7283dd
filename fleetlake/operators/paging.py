"""Paging, ordering and caps.

``orderBy(...).offset(k).limit(n)`` plans as a top-(k+n) per partition
followed by a merge, so a shallow page never sorts the whole table.  Deep
pages grow with k; ``seek_page`` is the key-set alternative whose cost does
not depend on the depth.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import literal


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def page(df: DataFrame, order_by: Sequence[str | Column], page_no: int = 1,
         page_size: int = 10) -> DataFrame:
    """``limit page_size offset (page_no - 1) * page_size`` over a total order.

    ``order_by`` must end in a unique column (an id) so pages never overlap.
    The merge keeps ``offset + size`` rows: for deep pages use ``seek_page``,
    or page inside ``narrowed_top_k``.
    """
    if page_no < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    offset = (page_no - 1) * page_size
    ordered = df.orderBy(*_order(order_by))
    return (ordered.offset(offset) if offset else ordered).limit(page_size)


def seek_page(df: DataFrame, order_by: Sequence[str], after: Sequence | None,
              page_size: int = 10) -> DataFrame:
    """Key-set page: rows strictly after the tuple ``after`` in ``order_by`` order.

    The lexicographic predicate is pushed to the scan and the top-k is per
    partition, so page 10,000 costs the same as page 1.
    """
    if after is not None:
        pred = None
        for i in range(len(order_by) - 1, -1, -1):
            here = F.col(order_by[i]) > literal(after[i])
            if pred is not None:
                here = here | ((F.col(order_by[i]) == literal(after[i])) & pred)
            pred = here
        df = df.filter(pred)
    return df.orderBy(*order_by).limit(page_size)


def exists(df: DataFrame) -> bool:
    """I4: any row at all (reads at most one row)."""
    return len(df.take(1)) > 0


# Time grains used to narrow the cut point, coarse to fine.
_GRAINS = ("day", "hour", "minute", "second", "millisecond", "microsecond")


def narrowed_top_k(df: DataFrame, ts: str, tiebreak: str, k: int) -> DataFrame:
    """The first ``k`` rows by ``(ts, tiebreak)``, exactly, without one task
    merging ``k`` rows from every partition; for callers with a large ``k``.

    ``orderBy().limit(k)`` keeps ``k`` rows per partition and merges them in a
    single task.  Here the cut point is found first: per-bucket counts of
    ``ts`` (day, then hour, ... inside the bucket that holds the k-th row)
    give a bound ``ts < E`` whose rows include the answer and number fewer
    than ``2 k``, as far as the finest grain allows.  Each step is a small
    ``groupBy`` whose result has at most a few thousand rows (the buckets of
    one coarser bucket), so only counts reach the driver.  Null times sort
    first, as in ``orderBy``.
    """
    col = F.col(ts)
    sure = 0                      # rows certainly before the window [lo, hi)
    lo = hi = None
    for level, grain in enumerate(_GRAINS):
        window = df if lo is None else df.filter((col >= literal(lo)) & (col < literal(hi)))
        counts = (window.groupBy(F.date_trunc(grain, col).cast("timestamp_ntz").alias("b"))
                  .agg(F.count(F.lit(1)).alias("n")).collect())
        if level == 0:
            nulls = sum(r["n"] for r in counts if r["b"] is None)
            if nulls >= k:        # the answer is null-time rows only
                return df.filter(col.isNull()).orderBy(tiebreak).limit(k).select(*df.columns)
            sure = nulls
        cut = None
        for row in sorted((r for r in counts if r["b"] is not None), key=lambda r: r["b"]):
            if sure + row["n"] >= k:
                cut = row
                break
            sure += row["n"]
        if cut is None:           # fewer than k rows in this range: all of them qualify
            if lo is None:
                return df.orderBy(ts, tiebreak).limit(k)
            break
        lo, hi = cut["b"], _bucket_end(cut["b"], grain)
        if cut["n"] <= k:
            break
    return df.filter(col.isNull() | (col < literal(hi))).orderBy(ts, tiebreak).limit(k)


def _bucket_end(start, grain: str):
    import datetime as dt
    steps = {"day": dt.timedelta(days=1), "hour": dt.timedelta(hours=1),
             "minute": dt.timedelta(minutes=1), "second": dt.timedelta(seconds=1),
             "millisecond": dt.timedelta(milliseconds=1), "microsecond": dt.timedelta(microseconds=1)}
    return start + steps[grain]
