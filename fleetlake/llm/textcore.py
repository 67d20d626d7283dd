"""Scanning whole texts as UTF-8 bytes with numpy, inside a task.

Texts arrive as Arrow string columns.  A slice of rows becomes one byte
buffer (each text followed by ``\\n``); words or lines are found with a byte
class table, and 64-bit hashes of all of them come from one prefix sum.
Memory follows ``CHUNK`` (plus the longest single text), not the batch.
"""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text handled at once; a longer single text is a chunk of its own.
CHUNK = 1 << 20
#: Rows of an Arrow batch between Spark and Python.
BATCH_ROWS = 1000


def byte_class(*members: int | range) -> np.ndarray:
    table = np.zeros(256, bool)
    for m in members:
        table[list(m) if isinstance(m, range) else m] = True
    return table


#: Separators of words written ``[^\x20\x09-\x0D]+``.
BLANKS = byte_class(0x20, range(0x09, 0x0E))
#: Separators of words written ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
NOT_ALNUM = byte_class(range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80))
NEWLINE = byte_class(0x0A)

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE = _U(0x9E3779B97F4A7C15 | 5)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_ORDER = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), _BASE if kind == "up" else _BASE_INVERSE, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * CHUNK:  # tables for one very long text are not kept
            _powers[kind] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts can be long: hand them to Python at most ``rows`` at a time.
    Python workers on machines that have this source tree find it; elsewhere
    it comes with ``--py-files``."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)


def slices(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one longer text."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0), dtype=np.int64)
    lo, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n + 1
    if lo < len(sizes):
        yield lo, len(sizes)


def add_columns(docs: DataFrame, text: str, added: list[tuple[str, T.DataType]],
                make: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """``docs`` with columns computed from its texts; columns of the same
    names are replaced, all others carried.  ``make`` is called once in a
    task; what it returns is called with slices of the texts."""
    small_batches(docs.sparkSession)
    names = [name for name, _ in added]
    keep = [f for f in docs.schema.fields if f.name not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                row, texts = (c.slice(lo, hi - lo) for c in batch.columns)
                yield pa.RecordBatch.from_arrays(row.flatten() + judge(texts), names=[f.name for f in keep] + names)

    # The row travels as one column, so that no name of it can clash.
    row = F.struct(*[F.col(f"`{f.name}`") for f in keep])
    return docs.select(row.alias("row"), F.col(f"`{text}`").cast("string").alias("text")) \
        .mapInArrow(run, T.StructType(keep + [T.StructField(name, kind) for name, kind in added]))


def text_bytes(column: pa.Array) -> list[bytes]:
    """The texts as bytes, null as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


@dataclass
class Scan:
    """Words (or lines) of several texts, in order.

    ``buf`` holds the texts, each followed by ``\\n``; text ``i`` is
    ``buf[first[i]:first[i + 1] - 1]``.  Word ``j`` is ``buf[start[j]:end[j]]``
    in text ``doc[j]``; ``words_at[i]`` is the number of words before text
    ``i``.
    """

    buf: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    words_at: np.ndarray
    hash: np.ndarray | None = None

    @property
    def n(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.words_at)

    def word(self, j: int) -> bytes:
        return self.buf[self.start[j]:self.end[j]].tobytes()


def scan(texts: list[bytes], separators: np.ndarray, lower: bool = False,
         hashed: bool = True) -> Scan:
    raw = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(raw, np.uint8)
    if lower:
        buf = LOWER[buf]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=first[1:])
    inside = np.concatenate(([False], ~separators[buf]))
    # Two neighbouring texts never share a word: a newline lies between them.
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[0::2], edges[1::2]
    words_at = np.searchsorted(start, first).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(words_at))
    out = Scan(buf, first, start, end, doc, words_at)
    if hashed:
        out.hash = span_hashes(buf, start, end)
    return out


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``buf[start:end]`` for disjoint ascending spans, in
    passes of at most ``CHUNK`` bytes (or one longer span)."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK, "right")))
        lo, hi = int(start[i]), int(end[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_VALUE[buf[lo:hi]] * _power("up", hi - lo)[:hi - lo], out=sums[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        h = (sums[e] - sums[s]) * _power("down", hi - lo)[s]
        out[i:j] = mix(h + (e - s).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def windows(s: Scan, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position of the first word, hash) of every run of ``size`` words
    inside one text."""
    n = len(s.hash) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.flatnonzero(s.doc[:n] == s.doc[size - 1:])
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h += s.hash[k:k + n] * _ORDER[k]
    return at, mix(h[at] + _U(size))


def combine(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of several aligned arrays of integers."""
    h = np.zeros(len(parts[0]), np.uint64)
    for k, p in enumerate(parts):
        h = mix(h * _ORDER[63 - k] + p.astype(np.uint64) + _U(k + 1))
    return h


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between consecutive ``bounds``."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


class KeyIndex:
    """Positions of known 64-bit keys: one probe of a table for most, a
    binary search for the few whose slot went to a later key.  ``spare``: the
    table has at least 2^spare slots for each key."""

    def __init__(self, keys: np.ndarray, weight: np.ndarray | None = None, spare: int = 2):
        self.keys = keys  # ascending
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys))))) + spare)
        self.shift = _U(64 - bits)
        self.table = np.zeros(1 << bits, np.int32)
        order = np.arange(len(keys)) if weight is None else np.argsort(weight, kind="stable")
        self.table[self._slot(keys[order])] = order

    def _slot(self, x: np.ndarray) -> np.ndarray:
        return (x * _U(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, which of ``x`` are no known keys)."""
        if not len(self.keys):
            return np.zeros(len(x), np.int32), np.arange(len(x))
        at = self.table[self._slot(x)]
        lost = np.flatnonzero(self.keys[at] != x)
        if len(lost):
            near = np.searchsorted(self.keys, x[lost]).clip(max=len(self.keys) - 1)
            at[lost] = near
            lost = lost[self.keys[near] != x[lost]]
        return at, lost
