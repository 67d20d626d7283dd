"""Line dedup against levelled sorted runs of line hashes.

Documents are taken in batches of ascending id.  A batch's distinct line keys
(128-bit hashes) are merge-joined with every run kept so far; those that no
run has are new and become a run of their own at level 0, bucketed and sorted
by the hash, with the smallest id that holds each key.  When a level holds
``fanout`` runs they are compacted into one run of the next level.  A line
goes when its key's owner, named by a run or new, is a smaller document.

A key is the line without blanks (``\\x20\\x09-\\x0D``) at both ends and with
A-Z lower-cased; keys of fewer than ``min_chars`` code points never go.

DataFrame functions only.  Only distinct keys meet the runs: a key that a
third of all lines share is combined in each task before the shuffle.  Lines
are joined only with the keys that some of them lose, in a sort-merge join
whose line side AQE may split.

Defined cases: null text is one empty line; rows with a null id count as one
document after all others; rows that share an id are one document; equal rows
are treated alike, each kept; an empty table gives an empty result.  Columns
named like an added one are replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, written

MIN_CHARS = 10
BATCHES = 4
FANOUT = 3
_BLANKS = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    line = F.btrim(line, F.lit(_BLANKS))
    # lower() equals the A-Z rule on ASCII and is much faster than translate().
    return F.when(F.length(line) == F.octet_length(line), F.lower(line)) \
        .otherwise(F.translate(line, _UPPER, _LOWER))


class LineRuns:
    """The levels of runs; a run is a table bucketed and sorted by (h1, h2)."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        # As many buckets as shuffle partitions: a batch meets a run bucket by
        # bucket, and the run is never shuffled again.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _store(self, keys: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        (keys.repartition(self.buckets, "h1", "h2").sortWithinPartitions("h1", "h2")
             .write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet")
             .option("path", shared_path(self.spark, name)).saveAsTable(name))
        return name

    def owners(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, first, last; distinct) with ``owner``, the document
        that the run with the key names, else null."""
        owner = F.lit(None).cast("long")
        for k, run in enumerate(self.runs()):
            held = run.withColumnRenamed("owner", f"owner{k}").hint("merge")
            keys = keys.join(held, ["h1", "h2"], "left")
            owner = F.coalesce(F.col(f"owner{k}"), owner)   # no key is in two runs
        return keys.select("h1", "h2", "first", "last", owner.alias("owner"))

    def add(self, keys: DataFrame) -> None:
        """Store keys (h1, h2, owner) that no run has as a run of level 0."""
        self._place(self._store(keys), 0)

    def _place(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self.spark.table(full[0])
            for other in full[1:]:  # no key is in two runs, so no key is combined
                merged = merged.unionByName(self.spark.table(other))
            self._place(self._store(merged), level + 1)
            for old in full:
                self.spark.sql(f"DROP TABLE IF EXISTS {old}")

    def forget(self) -> None:
        """Take the runs out of the catalogue; their files stay."""
        for level in self.levels:
            for name in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _identified(docs: DataFrame, doc_id: str, text: str) -> tuple[Column, Column, Column]:
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST)), F.xxhash64(body), body


def _lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    o, th, body = _identified(docs, doc_id, text)
    exploded = docs.select(o.alias("o"), th.alias("th"), F.posexplode(F.split(body, "\n")).alias("pos", "line"))
    key = line_key(F.col("line"))
    return (exploded.where(F.length("line") >= min_chars)
            .select("o", "th", "pos", key.alias("key"))
            .where(F.length("key") >= min_chars)
            .select("o", "th", "pos", F.xxhash64("key").alias("h1"),
                    F.xxhash64(F.lit(7), F.col("key")).alias("h2")))


def dropped_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(o, th, drops): for each document with any, the positions of lines to
    drop; ``o`` is its id and ``th`` the hash of its text."""
    spark = docs.sparkSession
    o, _, _ = _identified(docs, doc_id, text)
    cuts = docs.select(F.percentile_approx(o, [i / batches for i in range(1, batches)], 1000)).head()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    runs = LineRuns(spark, fanout)
    parts = []
    for lo, hi in zip(bounds, bounds[1:]):
        batch = docs
        if lo is not None:
            batch = batch.where(o > lo)
        if hi is not None:
            batch = batch.where(o <= hi)
        lines = written(_lines(batch, doc_id, text, min_chars), "batch-lines")  # read once for each run
        keys = lines.groupBy("h1", "h2").agg(F.min("o").alias("first"), F.max("o").alias("last"))
        keys = written(runs.owners(keys), "batch-keys")
        owner = F.coalesce("owner", "first")
        runs.add(keys.where("owner IS NULL").select("h1", "h2", owner.alias("owner")))
        repeated = keys.select("h1", "h2", owner.alias("owner"), "last").where("owner < last").drop("last")
        drops = lines.join(repeated, ["h1", "h2"]).where("owner < o") \
            .groupBy("o", "th").agg(F.collect_set("pos").alias("drops"))
        parts.append(written(drops, "line-drops"))
    runs.forget()
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
          batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text``, plus ``n_lines``
    (before) and ``n_dropped``."""
    drops = dropped_lines(docs, doc_id, text, min_chars, batches, fanout)
    o, th, body = _identified(docs, doc_id, text)
    keep = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    # Lines are split before the join, so that each position below is one
    # lookup in a stored array.
    rest = F.struct(*[F.col(f"`{c}`") for c in keep if c != text])
    left = docs.select(rest.alias("row"), o.alias("o"), th.alias("th"), F.col(f"`{text}`").isNull().alias("void"),
                       F.split(body, "\n").alias("lines"))
    n = F.size("lines")
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.col("drops"))
    new = F.when(F.col("void"), None).when(F.col("drops").isNull(), F.array_join("lines", "\n")) \
        .otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    return left.join(drops, ["o", "th"], "left").select(
        *[(new if c == text else F.col("row").getField(c)).alias(c) for c in keep],
        n.cast("long").alias("n_lines"),
        F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long").alias("n_dropped"))


def digest(deduped: DataFrame) -> DataFrame:
    """The query's columns from ``dedup``."""
    return deduped.select("doc_id", "n_lines", "n_dropped",
                          F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owned AS (
  SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM owned GROUP BY doc_id
"""
