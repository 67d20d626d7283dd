"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision node (255 of them) has a
context tree over the ``DEPTH`` bytes before it.  Every tree node keeps how
often the decision was 0 and 1 in training; its Krichevsky-Trofimov estimate
is weighted half and half with the product of its children, from the deepest
contexts to the empty one.  The trained tree then gives each byte, in its
context, a fixed probability that mixes all depths.

The model is as large as the corpus makes it, so it is never in one place:

1. texts are put together, as they are read, in blocks of about ``BLOCK``
   bytes; a block is written, text by text, with its distinct byte strings of
   ``DEPTH + 1`` bytes (and words, for the base score) and their counts in
   training texts, dealt into buckets by the ``SPLIT`` bytes before the last;
2. each bucket sums its strings over the blocks, one block after the other,
   and builds the levels below ``SPLIT``, which lie in it whole; the few nodes
   at ``SPLIT`` and above are joined and aggregated by Spark, up and down;
3. each bucket walks down its levels and answers the blocks with the values
   of just the strings they hold; each block scores its texts.

A string is one number in a sorted, packed list from beginning to end (its
eight decisions are unfolded only while its bucket is worked on), and a task
holds the distinct strings of one bucket, or of one block, at a time.  The
number of buckets follows the amount of text.

A text is preceded by zero bytes and followed by one end mark, which is
scored too.  Defined cases: null is the empty text; rows with a null id are
training rows; repeated rows count each time and score alike; an empty table
gives an empty result; with no training row every decision has probability
1/2.  Answers are rounded to 2^-36 of a decimal digit per byte.
"""

from __future__ import annotations

import ctypes
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as X
from .shared import written

DEPTH = 6
#: Bytes of text in a block; more only where one text is longer.
BLOCK = 32 << 20
#: Levels from the root that Spark joins; those below are built per bucket.
SPLIT = 3
#: Characters of text for each bucket, and buckets at least.
BUCKET = 4 << 20
LEAST_BUCKETS = 64
#: Strings waiting to be merged with those a task already holds, and ranges
#: in which they are kept.
PENDING = 1 << 20
RANGES = 16
#: Bytes of rows that go between Spark and Python at once, and one row more.
BATCH_BYTES = 4 << 20
#: Steps of one decimal digit in an answer.
DIGIT = float(1 << 36)
_END_BYTE = b"\xff"  # never part of UTF-8
_U = np.uint64
#: Keys of words have the highest bit set, those of byte strings do not.
_WORD = _U(1 << 63)
_END_TOKEN = _U(1 << 63 | 1)


def _small_batches(spark: SparkSession) -> None:
    """A row holds up to a bucket's strings of a block, or many texts, so
    batches are bounded by their bytes too: Spark holds them outside its heap,
    the worker beside what it works on."""
    X.small_batches(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(key, None):  # a size that the session chose stays
        spark.conf.set(key, str(BATCH_BYTES))


def _give_back() -> None:
    """Freed memory back to the system: a worker outlives its tasks, and what
    it keeps is missing to the steps after."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(key of every byte with its context, first key of each text and the
    end); the end mark of a text included."""
    pad = b"\0" * depth
    raw = b"".join([pad + t + _END_BYTE for t in texts])
    n = len(raw) - depth
    # Eight bytes from each position, the first in the highest place.
    key = np.ndarray((n,), ">u8", raw + b"\0" * 8, strides=(1,)).astype(np.uint64) >> _U(8 * (7 - depth))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    # A text's keys begin where its padding does; those that reach from one
    # text into the padding of the next are left out.
    between = ((at[1:-1] + depth * np.arange(len(texts) - 1))[:, None] + np.arange(depth)).ravel()
    return np.delete(key, between) if len(between) else key, at


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key of every word, first word of each text and the end)."""
    s = X.scan(texts, X.BLANKS, lower=True)
    return s.hash | _WORD, s.words_at


class Tally:
    """Distinct keys with their counts, from any number of sorted parts.  They
    are kept in ranges of keys, merged one at a time, so that little is held
    twice."""

    def __init__(self):
        self.bounds: np.ndarray | None = None
        self.ranges = [(np.empty(0, _U), np.empty(0, np.int64))]
        self.waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[]]
        self.size = 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        at = [0, *(np.searchsorted(keys, self.bounds).tolist() if self.bounds is not None else []), len(keys)]
        for held, lo, hi in zip(self.waiting, at[:-1], at[1:]):
            if hi > lo:
                held.append((keys[lo:hi], n[lo:hi]))
        self.size += len(keys)
        if self.size > PENDING:
            self._merge()

    def _merge(self) -> None:
        for r, held in enumerate(self.waiting):
            if held:
                keys = np.concatenate([self.ranges[r][0], *[k for k, _ in held]])
                n = np.concatenate([self.ranges[r][1], *[m for _, m in held]])
                held.clear()
                order = np.argsort(keys, kind="stable")  # quick on sorted parts
                keys, n = keys[order], n[order]
                begin = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                self.ranges[r] = keys[begin], np.add.reduceat(n, begin)
        self.size = 0
        keys, n = self.ranges[0]
        if self.bounds is None and len(keys) > PENDING // 4:
            cut = np.linspace(0, len(keys), RANGES + 1).astype(np.int64)
            self.bounds = keys[cut[1:-1]]
            self.ranges = [(keys[lo:hi].copy(), n[lo:hi].copy()) for lo, hi in zip(cut[:-1], cut[1:])]
            self.waiting = [[] for _ in self.ranges]

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        return tuple(np.concatenate([r[k] for r in self.ranges]) for k in (0, 1))


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys."""
    return pack(np.diff(keys.view(np.int64), prepend=np.int64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data)).view(_U)


def bucket_of(keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    """Byte strings by the bytes that their nodes at ``SPLIT`` share, words by
    their own hash, after them."""
    near = (keys >> _U(8)) & _U((1 << 8 * min(SPLIT, depth)) - 1)
    word = keys >= _WORD
    own = (X.mix(np.where(word, keys, near)) % _U(buckets)).astype(np.int32)
    return own + np.where(word, buckets, 0).astype(np.int32)


#: ``place``: in which order a bucket, or a block, needs its rows.
_PART = "block long, bucket int, place int, keys binary, n binary, rows long, texts binary"
_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("place", pa.int32()), ("keys", pa.binary()),
                    ("n", pa.binary()), ("rows", pa.int64()), ("texts", pa.binary())])


def _dealt(block: int, keys: np.ndarray, n: np.ndarray, buckets: int, depth: int) -> Iterator[dict]:
    """A block's keys as one row per bucket."""
    step = 1 << 18
    bucket = np.concatenate([bucket_of(keys[k:k + step], buckets, depth) for k in range(0, len(keys), step)] or [[]])
    order = np.argsort(bucket, kind="stable").astype(np.int32)
    ends = np.cumsum(np.bincount(bucket.astype(np.int32), minlength=2 * buckets)).tolist()
    for b, (lo, hi) in enumerate(zip([0, *ends], ends)):
        if hi > lo:
            own = order[lo:hi]
            yield {"block": block, "bucket": b, "place": 2, "keys": pack_keys(keys[own]), "n": pack(n[own])}


def _text_row(block: int, ids: list, train: np.ndarray, texts: list[bytes]) -> dict:
    known = np.array([-1 if i is None else i for i in ids], np.int64)
    missing = np.array([i is None for i in ids], np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    lists = [pack(x) for x in (known, missing, train.astype(np.int64), sizes)]
    return {"block": block, "place": 1, "rows": len(texts), "keys": lists[0], "n": lists[1],
            "texts": b"".join(len(x).to_bytes(8, "little") + x for x in (*lists[2:], zstandard.compress(b"".join(texts), 3)))}


def _count(tally: Tally, train: np.ndarray, texts: list[bytes], depth: int) -> None:
    """Add the texts' byte strings, words and ends."""
    for keys, at in (_grams(texts, depth), _tokens(texts)):
        learned = np.repeat(train, np.diff(at))
        tally.add(*np.unique(keys[learned], return_counts=True))
        if not train.all():
            others = np.unique(keys[~learned])
            tally.add(others, np.zeros(len(others), np.int64))
    tally.add(np.array([_END_TOKEN]), np.array([train.sum()], np.int64))


def _unpack_texts(row: dict) -> tuple[list, np.ndarray, list[bytes]]:
    pieces, at = [], 0
    while at < len(row["texts"]):
        size = int.from_bytes(row["texts"][at:at + 8], "little")
        pieces.append(row["texts"][at + 8:at + 8 + size])
        at += 8 + size
    ids = [None if gone else i for i, gone in zip(unpack(row["keys"]).tolist(), unpack(row["n"]).tolist())]
    ends = np.cumsum(unpack(pieces[1])).tolist()
    whole = zstandard.decompress(pieces[2])
    return ids, unpack(pieces[0]).astype(bool), [whole[lo:hi] for lo, hi in zip([0, *ends], ends)]


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number of bytes; at the end freed memory
    is given back."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 64 + sum(len(v) for v in row.values() if isinstance(v, bytes))
        if total > size:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)
    held.clear()
    _give_back()


def _blocks(rows: DataFrame, buckets: int, depth: int, block_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[dict]:
            number, total, tally = TaskContext.get().partitionId() << 32, 0, Tally()
            for batch in batches:
                for lo, hi in X.slices(batch.column("t")):
                    part = batch.slice(lo, hi - lo)
                    texts = X.text_bytes(part.column("t"))
                    train = ~np.asarray(part.column("held_out").to_pylist(), bool)
                    yield _text_row(number, part.column("doc_id").to_pylist(), train, texts)
                    _count(tally, train, texts, depth)
                    total += sum(map(len, texts))
                    if total >= block_bytes:
                        yield from _dealt(number, *tally.merge(), buckets, depth)
                        number, total, tally = number + 1, 0, Tally()
                        _give_back()
            yield from _dealt(number, *tally.merge(), buckets, depth)
        yield from _batches(made(), _ARROW)

    return rows.mapInArrow(run, _PART)


def _by_bucket(batches: Iterator[pa.RecordBatch], column: str, done: Callable[[int, list[dict]], Iterator[dict]],
               each: Callable[[int, dict], Iterator[dict]]) -> Iterator[dict]:
    """Rows sorted by ``column``: ``each`` per row, ``done`` after the last of
    a value."""
    now = None
    for batch in batches:
        for row in batch.to_pylist():
            if now is not None and row[column] != now:
                yield from done(now)
            now = row[column]
            yield from each(now, row)
    if now is not None:
        yield from done(now)


# ------------------------------------------------------------ the tree


def _log_gamma_of(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) for x >= 1/2: Stirling's series at x + 6."""
    y = x + 6
    low = np.log(x * (x + 1) * (x + 2)) + np.log((x + 3) * (x + 4) * (x + 5))
    r = 1 / y
    q = r * r
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 - low \
        + r * (1 / 12 + q * (-1 / 360 + q * (1 / 1260 + q * (-1 / 1680 + q / 1188))))


def _estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma_of(a + 0.5) + _log_gamma_of(b + 0.5) - _log_gamma_of(a + b + 1.0) - 1.1447298858494002  # ln pi


class Levels:
    """The levels from ``SPLIT`` down to ``depth`` over some strings.  A node
    is known by its context and decision, ``context << 8 | decision``."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, depth: int):
        self.depth, self.split = depth, min(SPLIT, depth)
        ctx, byte = keys >> _U(8), keys & _U(255)
        self.bits = [(byte >> _U(7 - k)) & _U(1) for k in range(8)]
        steps = [ctx << _U(8) | _U(1 << k) + (byte >> _U(8 - k)) for k in range(8)]
        nodes, at = np.unique(np.concatenate(steps), return_inverse=True)
        self.leaf = at.reshape(8, -1)
        bit = np.concatenate(self.bits)
        times = np.tile(n, 8).astype(np.float64)
        a = np.bincount(at, np.where(bit == 0, times, 0), len(nodes))
        b = np.bincount(at, np.where(bit == 1, times, 0), len(nodes))
        weighted = _estimate(a, b)
        #: From the deepest: nodes, counts, log odds of the own estimate, node of the level above.
        self.levels = [(nodes, a, b, None)]
        self.up: list[np.ndarray] = []
        for d in range(depth - 1, self.split - 1, -1):
            parent = (nodes >> _U(8) & _U((1 << 8 * d) - 1)) << _U(8) | nodes & _U(255)
            nodes, at = np.unique(parent, return_inverse=True)
            a, b, below = (np.bincount(at, x, len(nodes)) for x in (a, b, weighted))
            own = _estimate(a, b)
            weighted = np.logaddexp(own, below) - np.log(2)
            self.levels.append((nodes, a, b, own - below))
            self.up.append(at)
        self.weighted = weighted

    def top(self) -> dict[str, np.ndarray]:
        """The nodes at ``SPLIT``."""
        nodes, a, b, odds = self.levels[-1]
        return {"ctx": (nodes >> _U(8)).astype(np.int64), "node": (nodes & _U(255)).astype(np.int32), "a": a, "b": b,
                "lw": self.weighted, "lb": np.zeros(len(nodes)) if odds is None else odds}

    def values(self, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 of each string's probability, from the probability of a 1 and
        the weight left for longer contexts at each node of ``top``."""
        for k in range(len(self.levels) - 2, -1, -1):
            nodes, a, b, odds = self.levels[k]
            one = (b + 0.5) / (a + b + 1)
            at = self.up[k]
            if odds is None:
                p = p[at] + rest[at] * one
            else:
                small = np.exp(-np.abs(odds))
                here = np.where(odds >= 0, 1, small) / (1 + small)
                p, rest = p[at] + rest[at] * here * one, rest[at] * np.where(odds >= 0, small, 1) / (1 + small)
        return sum(np.log10(np.where(bit == 1, p[at], 1 - p[at])) for bit, at in zip(self.bits, self.leaf))


_MERGED = "bucket int, place int, keys binary, n binary, words long, known long, ctx binary, node binary, a binary, b binary, lw binary, lb binary"


def _merged(parts: DataFrame, buckets: int, depth: int) -> DataFrame:
    """One row per bucket: its strings with their counts in all blocks, and
    its nodes at ``SPLIT``; for words, their number."""
    schema = pa.schema([("bucket", pa.int32()), ("place", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()),
                        ("words", pa.int64()), ("known", pa.int64())] + [(c, pa.binary()) for c in ("ctx", "node", "a", "b", "lw", "lb")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def each(bucket: int, row: dict) -> Iterator[dict]:
            tally.add(unpack_keys(row["keys"]), unpack(row["n"]))
            return iter(())

        def done(bucket: int) -> Iterator[dict]:
            nonlocal tally
            keys, n = tally.merge()
            tally = Tally()
            out = {"bucket": bucket, "place": 0, "keys": pack_keys(keys), "n": pack(n)}
            if bucket >= buckets:
                yield out | {"words": int(n.sum()), "known": int((n > 0).sum())}
            else:
                yield out | {k: np.ascontiguousarray(v).tobytes() for k, v in Levels(keys, n, depth).top().items()}

        yield from _batches(_by_bucket(batches, "bucket", done, each), schema)

    rows = parts.where("bucket is not null").select("bucket", "keys", "n").repartition("bucket").sortWithinPartitions("bucket")
    return written(rows.mapInArrow(run, _MERGED), "merged")


def _nodes(merged: DataFrame) -> DataFrame:
    """The nodes at ``SPLIT`` as rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"ctx": np.int64, "node": np.int32, "a": np.float64, "b": np.float64, "lw": np.float64, "lb": np.float64}
        for batch in batches:
            for row in batch.to_pylist():
                columns = {c: np.frombuffer(row[c], kind) for c, kind in kinds.items()}
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.full(len(columns["a"]), row["bucket"], np.int32)),
                                                  **{c: pa.array(x) for c, x in columns.items()}})

    return merged.where("ctx is not null").select("bucket", "ctx", "node", "a", "b", "lw", "lb") \
        .mapInArrow(run, "bucket int, ctx long, node int, a double, b double, lw double, lb double")


def _log_gamma(x: Column) -> Column:
    """``_log_gamma_of`` in Spark."""
    y = x + 6
    low = F.log(x * (x + 1) * (x + 2)) + F.log((x + 3) * (x + 4) * (x + 5))
    r = 1 / y
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + r / 12 - r * r * r / 360 + r * r * r * r * r / 1260 \
        - r * r * r * r * r * r * r / 1680 + r * r * r * r * r * r * r * r * r / 1188 - low


def _log_estimate(a: Column, b: Column) -> Column:
    """``_estimate`` in Spark."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - 1.1447298858494002  # ln pi


def _odds(lb: Column) -> tuple[Column, Column]:
    """exp(lb) / (1 + exp(lb)) and 1 / (1 + exp(lb)) without overflow."""
    e = F.exp(-F.abs(lb))
    big, small = 1 / (1 + e), e / (1 + e)
    return F.when(lb >= 0, big).otherwise(small), F.when(lb >= 0, small).otherwise(big)


def _weights(nodes: DataFrame, depth: int) -> DataFrame:
    """(bucket, ctx, node, p, rest) of the nodes at ``SPLIT``: the probability
    of a 1 from the levels down to them, and the weight left below.  At most
    ``SPLIT`` bytes of context, so few rows beside the strings."""
    split = min(SPLIT, depth)
    levels = {split: written(nodes, "tree")}
    for d in range(split - 1, -1, -1):
        up = levels[d + 1].groupBy(F.col("ctx").bitwiseAND(F.lit((1 << 8 * d) - 1)).alias("ctx"), "node").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("lw").alias("below")) \
            .withColumn("own", _log_estimate(F.col("a"), F.col("b")))
        both = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below"))))
        levels[d] = written(up.select("ctx", "node", "a", "b", (both - 0.6931471805599453).alias("lw"),
                                      (F.col("own") - F.col("below")).alias("lb")), "tree")

    one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1)
    here, below = _odds(F.col("lb"))
    down = levels[0].select("ctx", "node", (here * one).alias("p"), below.alias("rest"))
    for d in range(1, split + 1):
        parent = down.select(F.col("ctx").alias("pc"), F.col("node").alias("pn"), F.col("p").alias("pp"),
                             F.col("rest").alias("pr"))
        here, below = _odds(F.col("lb")) if d < depth else (F.lit(1.0), F.lit(0.0))
        down = levels[d].join(parent, (F.col("ctx").bitwiseAND(F.lit((1 << 8 * (d - 1)) - 1)) == F.col("pc"))
                              & (F.col("node") == F.col("pn"))) \
            .select(*(["bucket"] if d == split else []), "ctx", "node",
                    (F.col("pp") + F.col("pr") * here * one).alias("p"), (F.col("pr") * below).alias("rest"))
    return down


def _answers(parts: DataFrame, merged: DataFrame, depth: int) -> DataFrame:
    """For each block and bucket the block's strings with their values
    (log10 of the probability; of words, the count), as whole steps."""
    # A bucket's nodes at the split level, in one row beside its strings.
    weights = _weights(_nodes(merged), depth).groupBy("bucket").agg(
        F.sort_array(F.collect_list(F.struct("ctx", "node", "p", "rest"))).alias("top"))
    none = {"block": "long", "keys": "binary", "n": "binary", "top": "array<struct<ctx: long, node: int, p: double, rest: double>>"}

    def row(df: DataFrame, place: int) -> DataFrame:
        return df.select("bucket", F.lit(place).alias("place"),
                         *[F.col(c) if c in df.columns else F.lit(None).cast(kind).alias(c) for c, kind in none.items()])

    rows = row(merged.select("bucket", "keys", "n"), 0).unionByName(row(weights, 1)) \
        .unionByName(row(parts.where("bucket is not null").select("block", "bucket", "keys"), 2)) \
        .repartition("bucket").sortWithinPartitions("bucket", "place")
    schema = pa.schema([("block", pa.int64()), ("place", pa.int32()), ("keys", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = n = steps = None

        def each(bucket: int, row: dict) -> Iterator[dict]:
            nonlocal keys, n, steps
            if row["place"] == 0:
                keys, n = unpack_keys(row["keys"]), unpack(row["n"])
                steps = n  # of words
            elif row["place"] == 1:
                p, rest = (np.array([x[c] for x in row["top"]]) for c in ("p", "rest"))
                steps = np.rint(Levels(keys, n, depth).values(p, rest) * DIGIT).astype(np.int64)
            else:
                at = np.searchsorted(keys, unpack_keys(row["keys"]))
                yield {"block": row["block"], "place": 0, "keys": row["keys"], "n": pack(steps[at])}

        yield from _batches(_by_bucket(batches, "bucket", lambda b: iter(()), each), schema)

    return rows.mapInArrow(run, "block long, place int, keys binary, n binary")


def tree_values(grams: DataFrame, depth: int) -> DataFrame:
    """(key, value): log10 of the probability of each key's last byte after
    its context, from the training counts ``n`` of the keys."""
    _small_batches(grams.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            key, at = np.unique(np.asarray(batch.column("key")).astype(_U), return_inverse=True)
            tally.add(key, np.bincount(at, np.asarray(batch.column("n")), len(key)).astype(np.int64))
        block = TaskContext.get().partitionId()
        yield from _batches(_dealt(block, *tally.merge(), LEAST_BUCKETS, depth), _ARROW)

    parts = written(grams.select("key", "n").repartition("key").mapInArrow(run, _PART), "grams")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pydict({"key": pa.array(unpack_keys(row["keys"]).view(np.int64)),
                                                  "value": pa.array(unpack(row["n"]) / DIGIT)})

    return _answers(parts, _merged(parts, LEAST_BUCKETS, depth), depth).mapInArrow(spread, "key long, value double")


# ------------------------------------------------------------ scores


class Answers:
    """What a block's strings are worth.  ``parts`` (packed keys and steps) is
    emptied, so that few copies are held at once."""

    def __init__(self, parts: list[tuple[bytes, bytes]], depth: int, train_tokens: int, train_words: int):
        keys = np.concatenate([unpack_keys(k) for k, _ in parts])
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        steps = np.concatenate([unpack(n) for _, n in parts])
        parts.clear()
        steps = steps[order]
        del order
        split = int(np.searchsorted(keys, _WORD))
        self.depth, self.gram_value, self.count = depth, steps[:split] / DIGIT, steps[split:].copy()
        del steps
        # The likeliest byte strings are the commonest: they get the first probe.
        self.grams = X.KeyIndex(keys[:split], self.gram_value, spare=0)
        self.words = X.KeyIndex(keys[split:], self.count, spare=0)
        self.word_value = np.log10(self.count + 0.5) - np.log10(train_tokens + 0.5 * (train_words + 1))
        self.end = int(self.words.find(np.array([_END_TOKEN]))[0][0])

    def scores(self, row: dict) -> pa.RecordBatch:
        ids, train, texts = _unpack_texts(row)

        def sums(x, at):
            total = np.concatenate(([0], np.cumsum(x)))
            return total[at[1:]] - total[at[:-1]]

        found, first = _tokens(texts)
        at = self.words.find(found)[0]
        string, begin = _grams(texts, self.depth)
        got = (np.diff(first) + 1, sums(self.count[at] > 0, first) + (self.count[self.end] > 0), np.diff(begin) - 1,
               sums(self.word_value[at], first) + self.word_value[self.end],
               sums(self.gram_value[self.grams.find(string)[0]], begin))
        return pa.RecordBatch.from_pydict(
            {"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(~train)}
            | {name: pa.array(x.astype(kind)) for name, kind, x in zip(
                ("n_tokens", "n_known", "n_bytes", "base_score", "score"), "qqqdd", got)})


def held_out_fold(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", held_out: Column | None = None,
          depth: int = DEPTH, block_chars: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, n_bytes,
    train_tokens, base_score (unigram words), score (log10 probability of the
    text) and code_length (bits per byte, end mark included)."""
    _small_batches(docs.sparkSession)
    own = F.col(f"`{doc_id}`")
    rows = docs.select(own.cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t"),
                       (held_out if held_out is not None else held_out_fold(own)).alias("held_out"))
    chars = rows.agg(F.sum(F.coalesce(F.length("t"), F.lit(0)) + 1)).head()[0] or 0
    buckets = max(LEAST_BUCKETS, chars // BUCKET)
    parts = written(_blocks(rows, buckets, depth, block_bytes=block_chars), "blocks")
    merged = _merged(parts, buckets, depth)
    size = merged.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).head()
    blocks = _answers(parts, merged, depth).withColumns({"rows": F.lit(None).cast("long"), "texts": F.lit(None).cast("binary")}) \
        .unionByName(parts.where("place = 1").select("block", "place", "keys", "n", "rows", "texts")) \
        .repartition("block").sortWithinPartitions("block", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, answers = None, [], None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                if row["block"] != block:
                    block, parts, answers = row["block"], [], None
                    _give_back()
                if row["place"] == 0:
                    parts.append((row["keys"], row["n"]))
                    continue
                if answers is None:  # a block's texts come after its answers
                    answers = Answers(parts, depth, size.n, size.v)
                    _give_back()
                yield answers.scores(row)
        block, parts, answers = None, [], None
        _give_back()

    out = blocks.mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(size.n).cast("long")) \
        .withColumn("code_length", -F.col("score") * 3.3219280948873626 / (F.col("n_bytes") + 1))
