"""Per-key "next matching row" without sending a whole key to one task.

For every row, ``next_match_time`` finds the time of the first later row of
the same key that satisfies a predicate (for example the first non-error
event after an error).  A plain window partitioned by the key would put every
row of a hot device into one task.  Here the key is split into time buckets:

1. inside each (key, bucket) a reverse running ``min`` finds the next match
   in the same bucket;
2. one aggregate row per (key, bucket) holds the bucket's first match
   (partial aggregation, so hot buckets combine map-side);
3. over those bucket rows - one per key and bucket, far fewer than the
   events - a reverse running ``min`` gives the first match in any later
   bucket;
4. rows without an in-bucket match take that value (join on key + bucket).

The result is exact for any bucket width; the width only bounds how many
rows one window partition holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_match_time(df: DataFrame, key: str, ts: str, tiebreak: str, is_match: Column,
                    bucket: str = "hour", out: str = "next_match_time") -> DataFrame:
    """Add ``out``: the ``ts`` of the first row after this one (by ``(ts, tiebreak)``)
    with the same ``key`` where ``is_match`` holds; null when there is none."""
    b = "__bucket"
    rows = df.withColumn(b, F.date_trunc(bucket, F.col(ts))).withColumn("__m", is_match)
    match_ts = F.when(F.col("__m"), F.col(ts))

    after_in_bucket = (Window.partitionBy(key, b)
                       .orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
                       .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("__in", F.min(match_ts).over(after_in_bucket))

    buckets = rows.groupBy(key, b).agg(F.min(match_ts).alias("__first"))
    later = Window.partitionBy(key).orderBy(F.col(b).desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(F.col(key).alias("__k"), F.col(b).alias("__b"),
                             F.min("__first").over(later).alias("__later"))

    # Rows without a key are one key of their own.
    joined = rows.join(buckets, rows[key].eqNullSafe(buckets["__k"]) & rows[b].eqNullSafe(buckets["__b"]), "left")
    return (joined.withColumn(out, F.coalesce("__in", "__later"))
            .drop(b, "__m", "__in", "__later", "__k", "__b"))
