"""Benchmark decontamination by a broadcast hash set of test windows.

Benchmark items are normalised (A-Z lower-cased, words of letters, digits and
non-ASCII) and cut into windows of ``size`` words; an item of fewer words is
one window.  The window hashes are broadcast; every training text is scanned
once, its windows are looked up by hash, and each hit is confirmed by
comparing the words themselves.

The broadcast is bounded: the benchmark is read in slices of at most
``SLICE_CHARS`` characters, and a larger benchmark is applied slice by slice,
each one a further pass over the same rows.  The rows are written to the
shared folder between two slices, so one slice is held at a time, by the
driver and by every executor.

Defined cases: null or empty texts have no words and no hits; null items or
item ids, and items without words, match nothing; repeated items count once
per item id; repeated rows are judged alike; an empty benchmark hits nothing.
Columns named like an added one are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as X
from .shared import written

SIZE = 10
#: Characters of benchmark text in one broadcast set.
SLICE_CHARS = 2_000_000

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()),
                                   T.StructField("end", T.LongType())]))


class WindowSet:
    """Window hashes of some items by window length, with their words."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        found: dict[int, dict[int, tuple[bytes, set[str]]]] = defaultdict(dict)
        for item, text in items:
            s = X.scan([text.encode("utf-8", "replace")], X.NOT_ALNUM, lower=True)
            n = len(s.start)
            if not n:
                continue
            k = min(size, n)
            words = [s.word(j) for j in range(n)]
            at, h = X.windows(s, k)
            for i, x in zip(at.tolist(), h.tolist()):
                joined = b" ".join(words[i:i + k])
                found[k].setdefault(x, (joined, set()))[1].add(item)
        self.by_size = {k: (np.array(sorted(v), np.uint64), v) for k, v in found.items()}

    def hits(self, s: X.Scan) -> list[tuple[int, int, frozenset]]:
        """(first word, number of words, items) of every confirmed window."""
        out = []
        for k, (hashes, held) in self.by_size.items():
            at, h = X.windows(s, k)
            if not len(at):
                continue
            near = np.searchsorted(hashes, h).clip(max=len(hashes) - 1)
            for p in np.flatnonzero(hashes[near] == h).tolist():
                i = int(at[p])
                joined, items = held[int(h[p])]
                if b" ".join(s.word(j) for j in range(i, i + k)) == joined:
                    out.append((i, k, items))
        return out


def _scan_texts(texts: list[bytes], windows: WindowSet) -> list[tuple[int, list, set]]:
    """Per text: number of words, hit word runs [start, end), items."""
    s = X.scan(texts, X.NOT_ALNUM, lower=True)
    covered = np.zeros(len(s.start) + 1, np.int32)
    items: dict[int, set] = defaultdict(set)
    for i, k, names in windows.hits(s):
        covered[i] += 1
        covered[i + k] -= 1
        items[int(s.doc[i])] |= names
    hit = np.cumsum(covered)[:-1] > 0
    out = []
    for d, (a, b) in enumerate(zip(s.words_at[:-1].tolist(), s.words_at[1:].tolist())):
        runs: list = []
        if d in items:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].view(np.int8), [0]))))
            runs = list(zip(edge[0::2].tolist(), edge[1::2].tolist()))
        out.append((b - a, runs, items.get(d, set())))
    return out


def _cut(text: bytes, windows: WindowSet) -> bytes:
    """The text without its hit word runs; what a cut brings together is
    scanned again until nothing is hit."""
    while True:
        s = X.scan([text], X.NOT_ALNUM, lower=True)
        runs = _scan_texts([text], windows)[0][1]
        if not runs:
            return text
        parts, at = [], 0
        for a, b in runs:
            parts.append(text[at:int(s.start[a])])
            at = int(s.end[b - 1])
        text = b" ".join(parts + [text[at:]])


def _slices(benchmark: DataFrame, item_id: str, text: str, chars: int) -> Iterator[list]:
    """The benchmark in lists of at most ``chars`` characters (or one item)."""
    rows = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("i"),
                            F.col(f"`{text}`").cast("string").alias("t")).na.drop()
    held, total = [], 0
    for r in rows.toLocalIterator():
        if held and total + len(r.t) > chars:
            yield held
            held, total = [], 0
        held.append((r.i, r.t))
        total += len(r.t)
    if held:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
         size: int = SIZE, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word runs inside windows),
    ``n_hit``, ``items`` (sorted ids) and ``contaminated``."""
    spark = docs.sparkSession
    X.small_batches(spark)
    names = ("n_words", "hit_spans", "n_hit", "items", "contaminated")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    work = docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("t"),
                       F.lit(None).cast("long").alias("n_words"), F.lit(None).cast(_SPANS).alias("hit_spans"),
                       F.lit(None).cast("array<string>").alias("items"))
    schema = work.schema
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    parts = _slices(benchmark, item_id, "text", slice_chars)
    for k, part in enumerate(chain([next(parts, [])], parts)):
        if k:
            work = written(work, "decontaminate")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(WindowSet(part, size))

        def run(batches, shared=shared):
            for batch in batches:
                for lo, hi in X.slices(batch.column(1)):
                    rows = batch.slice(lo, hi - lo)
                    got = _scan_texts(X.text_bytes(rows.column(1)), shared.value)
                    spans = [_joined(x[1], y) for x, y in zip(got, rows.column(3).to_pylist())]
                    items = [sorted(x[2] | set(y or ())) for x, y in zip(got, rows.column(4).to_pylist())]
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), rows.column(1), pa.array([x[0] for x in got], pa.int64()),
                         pa.array(spans, spans_kind), pa.array(items, pa.list_(pa.string()))], names=schema.names)

        work = work.mapInArrow(run, schema)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return work.select("row.*", "n_words", "hit_spans", n_hit.alias("n_hit"), "items",
                       (F.size("items") > 0).alias("contaminated"))


def _joined(new: list[tuple[int, int]], before: list[dict] | None) -> list[dict]:
    """Word runs of this pass and earlier ones as disjoint runs."""
    runs: list[dict] = []
    for a, b in sorted(new + [(x["start"], x["end"]) for x in before or ()]):
        if runs and a <= runs[-1]["end"]:
            runs[-1]["end"] = max(runs[-1]["end"], b)
        else:
            runs.append({"start": a, "end": b})
    return runs


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
           size: int = SIZE, min_left: float = 0.5, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``docs`` with hit spans cut out of the texts; a document that keeps
    less than ``min_left`` of its words is dropped.  Same columns; texts
    without a hit, null ones included, stay as they are."""
    spark = docs.sparkSession
    X.small_batches(spark)
    out = docs
    for k, part in enumerate(_slices(benchmark, item_id, "text", slice_chars)):
        if k:
            out = written(out, "decontaminate")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(WindowSet(part, size))

        def run(batches, shared=shared):
            for batch in batches:
                at = batch.schema.get_field_index(text)
                for lo, hi in X.slices(batch.column(text)):
                    rows = batch.slice(lo, hi - lo)
                    texts = X.text_bytes(rows.column(text))
                    keep, new = np.ones(len(texts), bool), rows.column(text).to_pylist()
                    for d, (n, runs, _) in enumerate(_scan_texts(texts, shared.value)):
                        if runs:
                            cut = _cut(texts[d], shared.value)
                            left = len(X.scan([cut], X.NOT_ALNUM, hashed=False).start)
                            keep[d], new[d] = left > 0 and left >= min_left * n, cut.decode("utf-8", "replace")
                    yield rows.set_column(at, rows.schema.field(at), pa.array(new, rows.schema.field(at).type)) \
                        .filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from ``find``."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.sort_array("items")), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, least(10, len(w)) AS k FROM iw) WHERE k > 0)),
windows AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM dw, (SELECT DISTINCT k FROM item_windows))),
hits AS (SELECT doc_id, i, k, item FROM windows JOIN item_windows USING (k, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
