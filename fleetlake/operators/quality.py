"""Data quality (Q1) and the record-error limit of a copy job.

Rules are named boolean columns (true = row is fine; null counts as a
failure).  The split adds one flag per rule, a pass flag and the list of
failed rule names; the limit check is one aggregate row.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    ok: Column


class ErrorLimitExceeded(RuntimeError):
    pass


def flag_rules(df: DataFrame, rules: Sequence[Rule], keep: Sequence[str] | None = None) -> DataFrame:
    """Q1: one boolean column per rule, ``dq_pass`` and ``dq_failed_rules``."""
    flags = {r.name: F.coalesce(r.ok, F.lit(False)) for r in rules}
    base = df.select(*(keep or df.columns), *[c.alias(n) for n, c in flags.items()])
    passed = F.lit(True)
    for n in flags:
        passed = passed & F.col(n)
    failed = F.concat_ws(",", *[F.when(~F.col(n), F.lit(n)) for n in flags])
    return base.withColumn("dq_pass", passed).withColumn("dq_failed_rules", failed)


def error_summary(df: DataFrame, bad: Column, record_limit: int = 0,
                  ratio_limit: float = 0.02) -> DataFrame:
    """Total, bad count and ratio in one aggregate; ``passed`` when neither
    the record limit nor the ratio limit is exceeded."""
    total = F.count(F.lit(1))
    n_bad = F.count_if(F.coalesce(bad, F.lit(True)))
    out = df.agg(total.alias("total_rows"), n_bad.alias("bad_rows"))
    ratio = F.when(F.col("total_rows") > 0, F.col("bad_rows") / F.col("total_rows")).otherwise(F.lit(0.0))
    return out.select(
        "total_rows", "bad_rows", ratio.alias("bad_ratio"),
        F.lit(record_limit).cast("bigint").alias("record_limit"),
        F.lit(ratio_limit).alias("ratio_limit"),
        ((F.col("bad_rows") <= record_limit) & (ratio <= ratio_limit)).alias("passed"))


def enforce(summary_row: dict) -> None:
    """Raise before the write when the limit is exceeded (commit order S7)."""
    if not summary_row["passed"]:
        raise ErrorLimitExceeded(
            f"{summary_row['bad_rows']} bad of {summary_row['total_rows']} rows "
            f"(limits: {summary_row['record_limit']} records, {summary_row['ratio_limit']:.2%})")


def limited_write(df: DataFrame, bad: Column, staged: str, publish: Callable[[DataFrame], None],
                  record_limit: int = 0, ratio_limit: float = 0.02) -> dict:
    """B7 in one pass over the source: rows and bad rows are counted while the
    rows are written to the ``staged`` folder; ``publish`` gets that table only
    if the limit holds.  Otherwise ``ErrorLimitExceeded`` carries the counts,
    nothing is published, and the staged rows stay for inspection."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("total_rows"), F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_rows")) \
        .write.mode("overwrite").parquet(staged)
    counts = seen.get
    ratio = counts["bad_rows"] / counts["total_rows"] if counts["total_rows"] else 0.0
    summary = {**counts, "bad_ratio": ratio, "record_limit": record_limit, "ratio_limit": ratio_limit,
               "passed": counts["bad_rows"] <= record_limit and ratio <= ratio_limit}
    try:
        enforce(summary)
    except ErrorLimitExceeded as refused:
        refused.summary = summary
        raise
    publish(df.sparkSession.read.schema(df.schema).parquet(staged))
    return summary
