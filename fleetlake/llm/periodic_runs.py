"""Maximal periodic runs of words, found in tiles per octave of periods.

A run of period q is a stretch of consecutive words in which words q apart
are the same, q is its smallest period, no neighbour extends it, and it has at
least ``max(MIN_WORDS, MIN_REPEATS * q)`` words.

Periods are treated by octaves ``[2g, 4g)``; those under ``DIRECT`` are one
octave.  A document is cut, once per octave, into overlapping tiles whose size
follows the octave.  Inside a tile every g-th position is a boundary.  The
words after a boundary are compared, as window hashes, with those q further on
for all q of the octave at once; where three boundaries in a row agree, the
boundary's Z-values (how far both places agree forwards and backwards) give
the positions i with ``word[i] == word[i + q]`` around it: an interval.
Documents of up to ``TILE`` words are a tile in themselves and are solved, many
at once, where they are read; the tiles of longer ones are rows that Spark
deals out.

An interval is passed on if its period is the smallest (no divisor of it fits
its first q words), which any part of a stretch decides for the whole.  All
intervals then meet by (document, period), where those that overlap are
stitched.  Tiles overlap by more than the shortest interval that counts, so no
edge can hide one.

Words are compared as 64-bit hashes.  Defined cases: null and empty texts have
no words and no runs; repeated rows and null doc_ids are documents of their
own; an empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as X
from .shared import written

MIN_WORDS = 24
MIN_REPEATS = 3
#: Periods below this are compared word by word.
DIRECT = 8
#: Words in the core of a tile, at least.
TILE = 1 << 13

_U = np.uint64
Found = tuple[np.ndarray, np.ndarray, np.ndarray]  # period, first position, position after the last


def least(q):
    """Positions of an interval of period ``q`` that counts."""
    return np.maximum(MIN_WORDS, MIN_REPEATS * q) - q


def octaves(n: int) -> list[int]:
    """g of the octaves with periods for ``n`` words; 1 for those below
    ``DIRECT``."""
    out = [1] if n >= MIN_WORDS else []
    g = DIRECT // 2
    while 2 * g * MIN_REPEATS <= n:
        out.append(g)
        g *= 2
    return out


def tiles(n: int, g: int) -> Iterator[tuple[int, int]]:
    """(first word, word after the last) of the octave's tiles.  They reach
    more than the shortest interval beyond their cores."""
    core = max(TILE, 32 * g)
    left, right = (MIN_WORDS + DIRECT, MIN_WORDS + 2 * DIRECT) if g == 1 else (8 * g, 16 * g)
    for start in range(0, n, core):
        yield max(0, start - left), min(n, start + core + right)


class Hashes:
    """Hashes of any stretch of a sequence, from prefix sums."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.sums = np.zeros(self.n + 1, _U)
        np.cumsum(X.mix(words.astype(_U) + _U(1)) * X._power("up", self.n)[:self.n], out=self.sums[1:])
        self.down = X._power("down", self.n + 1)

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each position on."""
        return (self.sums[size:] - self.sums[:-size]) * self.down[:self.n - size + 1]

    def at(self, first: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[first + size] - self.sums[first]) * self.down[first]

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Z-values: words that agree from ``i`` and ``j`` (> i) on."""
        z = np.zeros(len(i), np.int64)
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            room = np.flatnonzero(j + z + step <= self.n)
            same = self.at(i[room] + z[room], step) == self.at(j[room] + z[room], step)
            z[room[same]] += step
            step >>= 1
        return z

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that agree before ``i`` and before ``j`` (> i)."""
        z = np.zeros(len(i), np.int64)
        step = 1 << max(0, self.n.bit_length() - 1)
        while step:
            room = np.flatnonzero(i - z - step >= 0)
            same = self.at(i[room] - z[room] - step, step) == self.at(j[room] - z[room] - step, step)
            z[room[same]] += step
            step >>= 1
        return z


def direct(words: np.ndarray, q: int) -> Found:
    """Intervals of period ``q`` by comparing all words."""
    same = np.zeros(max(0, len(words) - q) + 2, bool)
    same[1:-1] = words[q:] == words[:len(words) - q] if len(words) > q else False
    edge = np.flatnonzero(same[1:] != same[:-1])
    lo, hi = edge[0::2], edge[1::2]
    keep = hi - lo >= least(q)
    return np.full(int(keep.sum()), q), lo[keep], hi[keep]


def smallest(words: np.ndarray, found: Found) -> Found:
    """Without the intervals whose stretch has a smaller period, which then
    divides theirs."""
    keep = [not any(np.array_equal(words[a:a + q - q // r], words[a + q // r:a + q]) for r in primes(q))
            for q, a in zip(found[0].tolist(), found[1].tolist())]
    return tuple(x[np.array(keep, bool)] for x in found)


def primes(q: int) -> list[int]:
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return out + ([q] if q > 1 else [])


def solve(words: np.ndarray, g: int, hashes: Hashes | None = None) -> Found:
    """The octave's intervals in one tile."""
    if g == 1:
        return smallest(words, _joined([direct(words, q) for q in range(1, DIRECT)]))
    hashes = hashes or Hashes(words)
    none = (np.empty(0, np.int64),) * 3
    if hashes.n < 2 * g * MIN_REPEATS:
        return none
    window = hashes.windows(g)
    rows = len(window) // g  # boundaries with a whole window
    padded = np.zeros((rows + 4) * g, _U)
    padded[:len(window)] = window[:len(padded)]
    grid = padded.reshape(-1, g)
    here = grid[:rows, :1]
    match = np.concatenate((grid[2:rows + 2] == here, grid[3:rows + 3] == here), axis=1)
    three = match[:-2] & match[1:-1] & match[2:] if rows > 2 else match[:0]
    first = three.copy()
    first[1:] &= ~three[:-1]  # one candidate of a chain of boundaries
    t, column = np.nonzero(first)
    if not len(t):
        return none
    m, q = t * g, 2 * g + column
    keep = q + m + 3 * g <= hashes.n
    m, q = m[keep], q[keep]
    keep = _primitive(hashes, m, q, g)
    m, q = m[keep], q[keep]
    lo = m - hashes.backward(m, m + q)
    hi = m + hashes.forward(m, m + q)
    keep = hi - lo >= least(q)
    found = np.unique(np.stack((q[keep], lo[keep], hi[keep])), axis=1)
    q, lo, hi = found
    sure = np.array([np.array_equal(words[a:b], words[a + p:b + p]) for p, a, b in zip(q.tolist(), lo.tolist(), hi.tolist())], bool)
    # Where the hashes of different words were the same, the words decide.
    return smallest(words, _joined([(q[sure], lo[sure], hi[sure])] + [direct(words, p) for p in set(q[~sure].tolist())]))


def _joined(parts: list[Found]) -> Found:
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(3))


def _primitive(hashes: Hashes, m: np.ndarray, q: np.ndarray, g: int) -> np.ndarray:
    """False for candidates (boundary, period) whose stretch has a smaller
    period for certain.  Several periods d apart at one boundary mean that its
    words have period d; where that reaches over the whole stretch, d divides
    the period, so what has the period has d too."""
    keep = np.ones(len(m), bool)
    new = np.concatenate(([True], m[1:] != m[:-1]))
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(m)))
    many = count > 2
    if not many.any():
        return keep
    gap = np.diff(q, append=0)
    gap[np.append(begin[1:], len(m)) - 1] = np.iinfo(np.int64).max
    d = np.minimum.reduceat(gap, begin)[many]
    at = m[begin[many]]
    reach = np.zeros(len(begin), np.int64)
    reach[many] = hashes.forward(at, at + d) + d
    keep &= q + 3 * g > np.repeat(reach, count)
    return keep


def planted_order(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each of ``n`` places, for the documents whose end
    is to be made periodic; None for the others."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % p
    return order


#: doc: a row of the table; a tile: ``g``, ``start`` and ``words`` are set.
_PART = ("key long, doc_id long, n long, text binary, digest string, g int, start long, words binary, "
         "found array<struct<q: long, lo: long, hi: long>>")
_FOUND = pa.list_(pa.struct([("q", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]))
_ARROW = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("text", pa.binary()),
                    ("digest", pa.string()), ("g", pa.int32()), ("start", pa.int64()), ("words", pa.binary()),
                    ("found", _FOUND)])


def _parts(docs: DataFrame, doc_id: str, text: str, order: Callable[[int | None, int], np.ndarray | None] | None,
           close: bool) -> DataFrame:
    """Documents, each with the intervals of its own tile, and the tiles of
    long ones.  ``close``: documents without intervals keep a digest only."""
    X.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi in X.slices(batch.column("t")):
                part = batch.slice(lo, hi - lo)
                ids, texts = part.column("d").to_pylist(), X.text_bytes(part.column("t"))
                yield from _slice_parts(ids, texts, key, order, close)
                key += len(ids)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t")) \
        .mapInArrow(run, _PART)


def _slice_parts(ids: list, texts: list[bytes], key: int, order, close: bool) -> Iterator[pa.RecordBatch]:
    s = X.scan(texts, X.BLANKS)
    hashed, spelled, short = [], [], []
    tile_rows = []
    for k, i in enumerate(ids):
        words = s.hash[s.words_at[k]:s.words_at[k + 1]]
        own = texts[k].split()
        place = order(i, len(own)) if order else None
        if place is not None:
            words, own = words[place], [own[p] for p in place.tolist()]
        spelled.append(b" ".join(own))
        if len(words) > TILE:
            # Small numbers instead of hashes: a tile's rows are written.
            small = np.unique(words, return_inverse=True)[1].astype(np.int32)
            for g in octaves(len(words)):
                for a, b in tiles(len(words), g):
                    tile_rows.append({"key": key + k, "g": g, "start": a, "words": small[a:b].tobytes()})
            hashed.append(np.empty(0, _U))
        else:
            hashed.append(words)
        short.append(len(words) <= TILE)
    n = np.diff(s.words_at)
    # One sequence for all, with a word of its own after each document.
    size = np.array([len(h) for h in hashed], np.int64)
    first = np.concatenate(([0], np.cumsum(size + 1)))
    ends = X.mix(np.arange(1, len(ids) + 1).astype(_U) * _U(0xD1342543DE82EF95))
    whole = np.concatenate([x for h, e in zip(hashed, ends) for x in (h, e[None])]) if ids else np.empty(0, _U)
    hashes = Hashes(whole)
    q, lo, hi = _joined([solve(whole, g, hashes) for g in octaves(int(size.max()) if len(size) else 0)])
    doc = np.searchsorted(first, lo, "right") - 1
    by = np.argsort(doc, kind="stable")
    q, lo, hi, doc = q[by], lo[by] - first[doc[by]], hi[by] - first[doc[by]], doc[by]
    at = np.searchsorted(doc, np.arange(len(ids) + 1))
    done = [bool(close and short[k] and at[k] == at[k + 1]) for k in range(len(ids))]
    found = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array(x.astype(np.int64)) for x in (q, lo, hi)], names=["q", "lo", "hi"]))
    rows = len(ids)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.arange(key, key + rows)), pa.array(ids, pa.int64()), pa.array(n.astype(np.int64)),
        pa.array([None if d else t for d, t in zip(done, spelled)], pa.binary()),
        pa.array([hashlib.sha256(t).hexdigest() if d else None for d, t in zip(done, spelled)], pa.string()),
        pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.binary()), found.cast(_FOUND)], schema=_ARROW)
    for k in range(0, len(tile_rows), 64):
        yield pa.RecordBatch.from_pylist(tile_rows[k:k + 64], schema=_ARROW)


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            q, lo, hi = solve(np.frombuffer(row["words"], np.int32), row["g"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), row["key"], np.int64)), pa.array(q.astype(np.int64)),
                 pa.array(lo + row["start"], pa.int64()), pa.array(hi + row["start"], pa.int64())],
                names=["key", "q", "lo", "hi"])


def _stitched(parts: DataFrame) -> DataFrame:
    """(key, start, length, period) of all runs: overlapping intervals of one
    document and period are one."""
    tiles_ = parts.where("g is not null").select("key", "g", "start", "words").repartition("key", "g", "start")
    pieces = tiles_.mapInArrow(_solve_tiles, "key long, q long, lo long, hi long") \
        .unionByName(parts.where("g is null").select("key", F.inline("found")))
    by = Window.partitionBy("key", "q").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("lo") <= before, 0).otherwise(1)
    pieces = pieces.withColumn("new", new).withColumn("stretch", F.sum("new").over(by))
    return pieces.groupBy("key", F.col("q").alias("period"), "stretch") \
        .agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.max("q")).alias("length"))


_RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
           "runs_sha256 string, collapsed_sha256 string")


def _summary(doc_id, text: bytes, runs: list[tuple[int, int, int]], with_text: bool) -> dict:
    """``runs``: (start, length, period), in order."""
    words = text.split(b" ") if text else []
    best = None
    dropped = np.zeros(len(words) + 1, np.int64)
    for run in runs:
        # Longer in periods; runs come by start, then period.
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
        dropped[run[0] + run[2]] += 1
        dropped[run[0] + run[1]] -= 1
    kept = b" ".join([w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d])
    start, length, period = best or (None, None, None)
    out = {"doc_id": doc_id, "n_runs": len(runs), "start": start, "length": length, "period": period,
           "exponent_milli": 1000 * length // period if best else None,
           "runs_sha256": hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
           "collapsed_sha256": hashlib.sha256(kept).hexdigest()}
    return out | ({"runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": kept.decode()}
                  if with_text else {})


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True,
         order: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """One row per document: its number of runs, the run with the most
    repetitions, digests of all runs and of the text without repetitions and
    (``with_text``) both themselves.  ``order`` may first rearrange a
    document's words: from doc_id and number of words it gives the word that is
    to stand at each place."""
    schema = _RESULT + (", runs array<struct<start: long, length: long, period: long>>, collapsed string" if with_text else "")
    parts = written(_parts(docs, doc_id, text, order, close=not with_text), "run_parts")
    # A document's runs are bounded by its text.
    found = _stitched(parts).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    rows = parts.where("g is null")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for batch in batches:
            for k in range(batch.num_rows):
                doc, body, several = (batch.column(c)[k].as_py() for c in ("doc_id", "text", "runs"))
                row = _summary(doc, body or b"", [(r["start"], r["length"], r["period"]) for r in several or []], with_text)
                kinds = kinds or _arrow(row, with_text)
                yield pa.RecordBatch.from_pylist([row], schema=kinds)

    open_rows = rows.where("digest is null").select("key", "doc_id", "text").join(found, "key", "left") \
        .mapInArrow(finish, schema)
    if with_text:
        return open_rows
    closed = rows.where("digest is not null").select(
        "doc_id", F.lit(0).cast("long").alias("n_runs"),
        *[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")],
        F.lit(hashlib.sha256(b"").hexdigest()).alias("runs_sha256"), F.col("digest").alias("collapsed_sha256"))
    return open_rows.unionByName(closed)


def _arrow(row: dict, with_text: bool) -> pa.Schema:
    text = ("runs_sha256", "collapsed_sha256", "collapsed")
    run = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
    return pa.schema([(c, pa.string() if c in text else run if c == "runs" else pa.int64()) for c in row])
