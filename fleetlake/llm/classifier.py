"""Quality classifier on supervised subword embeddings.

A document is the average of learned vectors of its words and of the
character n-grams inside them (word ends marked by a blank), all hashed into
``BUCKETS`` rows, and of one vector for each word that repeats the one before
it; a softmax layer on top gives its class.  Training is
stochastic gradient descent in numpy, in one task, on a sample of labelled
documents bounded by ``SAMPLE`` per class (lowest hash of the id first), with
the classes weighted by their counts over all labels.

Because the layer is linear, a document's score needs one number per bucket
(the class difference of its vector), so scoring reads ``BUCKETS`` floats:
that table, of fixed size, is what is broadcast.

Defined cases: null and empty texts have no features and score by the bias
alone; labels other than 0 and 1, null ids and ids with contradicting labels
are ignored; without labelled rows every score is 0.5; repeated rows score
alike; an empty table gives an empty result.  Columns named like an added one
are replaced.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as X

BUCKETS = 1 << 17
DIM = 16
NGRAMS = (3, 4)
#: The row of a word that repeats the one before it.
REPEATED = 0
#: Most training documents of a class.
SAMPLE = 2000
EPOCHS = 6
RATE = 0.3
MINI_BATCH = 16

_U = np.uint64
_BLANK = np.where(X.BLANKS, 0x20, np.arange(256)).astype(np.uint8)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every feature, first feature of each text and the end)."""
    s = X.scan(texts, X.BLANKS)
    buf = _BLANK[s.buf]
    blank = X.BLANKS[s.buf]
    buckets = [(s.hash % _U(BUCKETS)).astype(np.int32)]
    counts = [s.counts]
    again = np.zeros(len(s.hash), bool)
    again[1:] = (s.hash[1:] == s.hash[:-1]) & (s.doc[1:] == s.doc[:-1])
    buckets.append(np.full(int(again.sum()), REPEATED, np.int32))
    counts.append(X.per_text(again, s.words_at))
    for size in NGRAMS:
        m = len(buf) - size + 1
        if m <= 0:
            continue
        gram = np.zeros(m, np.uint32)
        inner = np.zeros(m, bool)
        for k in range(size):
            gram = (gram << np.uint32(8)) | buf[k:k + m]
            if 0 < k < size - 1:
                inner |= blank[k:k + m]
        good = ~inner
        ends = s.first[1:] - 1  # what follows a text's last byte is the next text
        good[ends[ends < m]] = False
        b = ((gram[good] * np.uint32(0x9E3779B1)) ^ np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)) >> np.uint32(15)
        total = np.zeros(m + 1, np.int64)
        np.cumsum(good, out=total[1:])
        at = total[np.minimum(s.first, m)]
        buckets.append(b.astype(np.int32))
        counts.append(np.diff(at))
    ends = np.cumsum(np.sum(counts, axis=0))
    starts = [np.concatenate(([0], np.cumsum(c)))[:-1] for c in counts]
    flat = np.empty(int(ends[-1]), np.int32)
    at = np.concatenate(([0], ends))[:-1]
    for b, c, first in zip(buckets, counts, starts):
        flat[np.repeat(at - first, c) + np.arange(len(b))] = b
        at = at + c
    return flat, np.concatenate(([0], ends))


def _train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weight: np.ndarray,
           seed: int = 5) -> tuple[np.ndarray, float]:
    """Class difference of every bucket, and of the bias.  ``docs`` holds
    (distinct buckets, share of the document's features) pairs."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, done = EPOCHS * max(1, -(-len(docs) // MINI_BATCH)), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), MINI_BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            pick = order[lo:lo + MINI_BATCH]
            hidden = np.stack([docs[d][1] @ table[docs[d][0]] for d in pick])
            z = hidden @ out + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            error[np.arange(len(pick)), labels[pick]] -= 1
            error *= weight[labels[pick]][:, None]
            back = error @ out.T
            out -= rate * hidden.T @ error
            bias -= rate * error.sum(axis=0) / len(pick)
            for row, d in enumerate(pick):  # averaging makes these steps small; the root evens them out
                table[docs[d][0]] -= rate * docs[d][1][:, None] * back[row] * len(docs[d][0]) ** 0.5
    return (table @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, target: str,
                    learn_from: Column | None, sample: int) -> DataFrame:
    """(t, label, share): at most ``sample`` texts of each class, and that
    class's share of all usable labels."""
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{target}`").cast("int").alias("label"))
    known = known.where(F.col("i").isNotNull() & F.col("label").isin(0, 1))
    if learn_from is not None:
        known = known.where(learn_from)
    known = known.groupBy("i").agg(F.min("label").alias("label"), F.max("label").alias("other")) \
        .where("label = other").select("i", "label")
    ids = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"))
    known = known.join(ids, "i", "left_semi")
    shares = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    picked = None
    for label in (0, 1):
        some = known.where(F.col("label") == label).orderBy(F.xxhash64("i"), "i").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    # At most 2 * sample ids: a broadcast of known size.
    picked = picked.withColumn("n", F.when(F.col("label") == 1, shares.get(1, 0)).otherwise(shares.get(0, 0)).cast("long"))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("i"), F.col(f"`{text}`").cast("string").alias("t"))
    return texts.join(F.broadcast(picked), "i").select("i", "t", "label", "n")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: str = "quality",
        learn_from: Column | None = None, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """The learned (number per bucket, bias).  ``learn_from`` is a condition
    on the id column ``i``."""
    X.small_batches(docs.sparkSession)
    rows = training_sample(docs, labels, doc_id, text, target, learn_from, sample)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in X.slices(batch.column("t")):
                part = batch.slice(lo, hi - lo)
                flat, at = _features(X.text_bytes(part.column("t")))
                found = [np.unique(flat[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:])]
                ends = np.cumsum([0] + [len(f[0]) for f in found]).astype(np.int32)
                share = [(f[1] / max(1, f[1].sum())).astype(np.float32) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("i"), part.column("label"), part.column("n"),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([f[0] for f in found]))),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(share)))],
                    names=["i", "label", "n", "b", "s"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            b, s = batch.column("b"), batch.column("s")
            for k in range(batch.num_rows):
                got.append((batch.column("i")[k].as_py(), batch.column("label")[k].as_py(), batch.column("n")[k].as_py(),
                            b[k].values.to_numpy(), s[k].values.to_numpy()))
        got.sort(key=lambda g: g[0])  # the same model whatever order the rows come in
        if not got:
            return
        y = np.array([g[1] for g in got])
        have = np.bincount(y, minlength=2)
        total = {g[1]: g[2] for g in got}
        weight = np.array([total.get(c, 0) / max(1, have[c]) for c in (0, 1)], np.float32)
        weight *= len(y) / float((weight * have).sum())
        model, bias = _train([(g[3], g[4]) for g in got], y, weight)
        yield pa.RecordBatch.from_pydict({"model": pa.array([model.tobytes()], pa.binary()), "bias": pa.array([bias])})

    found = rows.mapInArrow(featurize, "i long, label int, n long, b array<int>, s array<float>") \
        .repartition(1).mapInArrow(train, "model binary, bias double").collect()
    if not found:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(found[0].model, np.float32), found[0].bias


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> list[pa.Array]:
        table, bias = shared.value
        flat, at = _features(X.text_bytes(texts))
        total = np.concatenate(([0.0], np.cumsum(table[flat], dtype=np.float64)))
        z = (total[at[1:]] - total[at[:-1]]) / np.maximum(1, np.diff(at)) + bias
        return [pa.array(1 / (1 + np.exp(-z)))]

    return X.add_columns(docs, text, [("score", T.DoubleType())], lambda: judge)
