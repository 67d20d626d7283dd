"""Packing documents into sequences, in order, by dynamic programming.

Each input partition's documents, in their order, are one stream of token
ids.  Cuts may lie at document ends (free), at sentence ends
(``SENTENCE_COST``) and, where neither is near and at the very end of the
stream, inside sentences (``WORD_COST``); costs are in padding tokens.  A
window of length L pads to ``size`` unless L is a power of two.  The cheapest
set of windows follows from

    best(j) = cost(j) + min( size - p(j) + min(best(i) + p(i)),  best(i) where p(j) - p(i) = 2^k )

over the cuts i less than ``size`` before j; the first minimum is kept in a
monotone queue.  Streams are cut in blocks of ``BLOCK`` tokens; the last few
windows of a block are decided again with the next one, so memory is bounded
by a block and the longest document.

A document's ids are those of its text and an end id; every id lies in
exactly one piece.  Nothing is shuffled: sequences do not cross partitions,
and their ids are unique but not gapless.

Defined cases: null and empty texts are the end id alone; rows are packed as
they come, repeated or not, null doc_ids included; an empty table gives an
empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections import deque
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as X
from .wordpieces import pieces, word_ids

SIZE = 4096
END_ID = 2
SENTENCE_COST = 8
WORD_COST = 32
BLOCK = 1 << 20
#: Bytes of text tokenized at once.
TEXT_BYTES = 4 << 20
#: Steps of cuts inside a run of tokens without sentence ends.
LONG_STEP = 256
#: Windows at a block's end that the next block decides again.
AGAIN = 4

_TERMINAL = X.byte_class(*b".!?")
TOKENIZER = "word_bpe_49k.json"


def cuts(position: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """Indices of the chosen cuts among ``position`` (ascending, from 0, no
    gap above ``size``), the first and the last included."""
    n = len(position)
    at, source = [], []  # cuts, and the cuts a power of two before them
    k = 1
    while k <= size:
        i = np.searchsorted(position, position - k)
        fit = np.flatnonzero((position >= k) & (position[i] == position - k))
        at.append(fit)
        source.append(i[fit])
        k *= 2
    at, source = np.concatenate(at), np.concatenate(source)
    order = np.argsort(at, kind="stable")
    exact = source[order].tolist()
    upto = np.searchsorted(at[order], np.arange(n), "right").tolist()
    p, c = position.tolist(), cost.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[tuple] = deque([(0.0, 0, 0)])  # (best(i) + p(i), p(i), i), ascending
    e = upto[0]
    for j in range(1, n):
        pj = p[j]
        while pj - queue[0][1] > size:
            queue.popleft()
        value, _, i = queue[0]
        least = value + size - pj
        while e < upto[j]:
            if best[exact[e]] < least:
                i = exact[e]
                least = best[i]
            e += 1
        best[j] = least = least + c[j]
        back[j] = i
        value = least + pj
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, pj, j))
    chosen, j = [n - 1], n - 1
    while j:
        j = back[j]
        chosen.append(j)
    return chosen[::-1]


class _Stream:
    """The undecided end of one partition's tokens."""

    def __init__(self, size: int, sequence: int):
        self.size, self.sequence = size, sequence
        self.tokens = np.empty(0, np.int32)
        self.sentence = np.empty(0, np.int64)  # ends of sentences
        self.first = np.empty(0, np.int64)     # of each document (or its rest)
        self.taken = np.empty(0, np.int64)     # ids of the document before that
        self.total = np.empty(0, np.int64)
        self.doc_id: list = []
        self.waiting: list[tuple] = []
        self.length = 0

    def add(self, tokens, sentence, first, total, doc_id) -> None:
        self.waiting.append((tokens, sentence, first, total, doc_id))
        self.length += len(tokens)

    def _gather(self) -> None:
        at, tokens, sentence, first, total = len(self.tokens), [self.tokens], [self.sentence], [self.first], [self.total]
        for t, s, f, n, ids in self.waiting:
            tokens.append(t)
            sentence.append(s + at)
            first.append(f + at)
            total.append(n)
            self.doc_id = self.doc_id + ids
            at += len(t)
        self.taken = np.concatenate([self.taken, np.zeros(sum(len(w[2]) for w in self.waiting), np.int64)])
        self.tokens, self.sentence = np.concatenate(tokens), np.concatenate(sentence)
        self.first, self.total = np.concatenate(first), np.concatenate(total)
        self.waiting = []

    def _candidates(self, last: bool) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.tokens)
        kinds = [(self.first, 0), (np.array([n]), 0), (self.sentence, SENTENCE_COST)]
        plain = np.unique(np.concatenate([[0]] + [k for k, _ in kinds]))
        gap = np.diff(plain)
        for a, b in zip(plain[:-1][gap > self.size].tolist(), plain[1:][gap > self.size].tolist()):
            kinds.append((np.arange(a + LONG_STEP, b, LONG_STEP), WORD_COST))
        if last:  # cuts anywhere near the end, so that powers of two can fill it
            kinds.append((np.arange(max(1, n - self.size), n), WORD_COST))
        where = np.concatenate([k for k, _ in kinds])
        price = np.concatenate([np.full(len(k), c, np.float64) for k, c in kinds])
        order = np.lexsort((price, where))
        where, price = where[order], price[order]
        new = np.concatenate(([True], where[1:] != where[:-1]))
        return where[new], price[new]

    def decide(self, last: bool, with_ids: bool) -> pa.RecordBatch | None:
        self._gather()
        if not len(self.tokens):
            return None
        position, cost = self._candidates(last)
        ends = position[cuts(position, cost, self.size)]
        if not last:
            ends = ends[:max(1, len(ends) - AGAIN)]
        done = int(ends[-1])
        out = self._pieces(ends, done, with_ids) if done else None
        keep = np.searchsorted(self.first, done, "right") - 1 if done < len(self.tokens) else len(self.first)
        first = np.maximum(self.first[keep:], done)
        self.taken = self.taken[keep:] + first - self.first[keep:]
        self.first, self.total, self.doc_id = first - done, self.total[keep:], self.doc_id[keep:]
        self.sentence = self.sentence[self.sentence > done] - done
        self.tokens = self.tokens[done:].copy()
        self.length = len(self.tokens)
        return out

    def _pieces(self, ends: np.ndarray, done: int, with_ids: bool) -> pa.RecordBatch:
        edge = np.unique(np.concatenate((ends, self.first[self.first < done])))
        lo, hi = edge[:-1], edge[1:]
        doc = np.searchsorted(self.first, lo, "right") - 1
        window = np.searchsorted(ends, lo, "right") - 1
        crc = [zlib.crc32(self.tokens[a:b].astype("<u4").tobytes()) for a, b in zip(lo.tolist(), hi.tolist())]
        columns = {
            "doc_id": pa.array([self.doc_id[d] for d in doc.tolist()], pa.int64()),
            "start": pa.array(self.taken[doc] + lo - self.first[doc]),
            "length": pa.array(hi - lo), "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": pa.array(self.total[doc]),
            "sequence_id": pa.array(window + self.sequence), "offset": pa.array(lo - ends[window])}
        if with_ids:
            columns["ids"] = pa.ListArray.from_arrays(
                pa.array(np.concatenate((lo, [done])).astype(np.int32)), pa.array(self.tokens[:done]))
        self.sequence += len(ends) - 1
        return pa.RecordBatch.from_pydict(columns)


def tokenize(texts: list[bytes], tokenizer_path: str, end_id: int) -> tuple[np.ndarray, ...]:
    """(ids of all texts, ends of sentences, first id of each text, ids of
    each text)."""
    words = word_ids(tokenizer_path)
    s = pieces(texts, words.special)
    begin, size = words.of(s)
    before = np.cumsum(size) - size
    place = before + s.doc  # one end id for each earlier text
    within = np.arange(int(size.sum()))
    tokens = np.full(len(within) + s.n, end_id, np.int32)
    tokens[np.repeat(place - before, size) + within] = words.ids[np.repeat(begin - before, size) + within]
    totals = np.concatenate(([0], np.cumsum(size)))
    bounds = totals[s.words_at] + np.arange(s.n + 1)
    stops = _TERMINAL[s.buf[s.end - 1]] & X.BLANKS[s.buf[s.end]]
    return tokens, (place + size)[stops], bounds[:-1], np.diff(bounds)


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", size: int = SIZE,
         end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset and (``with_ids``) ids."""
    X.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = _Stream(size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for lo, hi in X.slices(batch.column("t"), TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                stream.add(*tokenize(X.text_bytes(part.column("t")), tokenizer_path, end_id),
                           part.column("d").to_pylist())
                if stream.length >= BLOCK and (out := stream.decide(False, with_ids)):
                    yield out
        if out := stream.decide(True, with_ids):
            yield out

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t")) \
        .mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
