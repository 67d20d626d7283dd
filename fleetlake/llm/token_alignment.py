"""Alignment of two tokenizations of the same text by diagonal run skipping.

A text, with a blank before it, is encoded by a byte-level tokenizer (A) and
by a piece tokenizer with byte fallback (B, which puts the blank there by
itself).  Both cover the same bytes, so a token is known by the byte at which
it ends.  With ``i`` and ``j`` the first tokens after a common end, the two
lists of ends are compared at the shift ``j - i``, over 1, 2, 4, ... tokens at
a time, until they differ; halving finds the first difference.  All tokens
passed are one-to-one groups.  The irregular group there is resolved by
stepping the side that is behind until both end together, which gives the next
shift.

Pair counts hold for the whole corpus: documents are aligned in blocks (at
most ``TEXT_BYTES`` of text, or one longer text), each written with its
distinct (A id, B id) pairs; the pairs of all blocks are summed, and each block
gets back the counts of its own pairs only.

Tokens are looked up by unit, a blank and what follows up to the next blank
after a non-blank: no token of either vocabulary goes across such a border
(checked when the vocabularies are loaded; otherwise the whole text is one
unit).

Defined cases: null, empty, and texts whose tokens do not spell the blank and
the text exactly (U+2581 in them) have no tokens; repeated rows count each for
itself, null doc_ids included; an empty table gives an empty result.  Only
doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from itertools import chain
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as X
from .shared import written

#: Text of one block.
TEXT_BYTES = 4 << 20
#: Distinct units a worker remembers before it starts anew.
KEEP = 600_000
#: Units encoded in one string.
JOINED = 256
#: Bits of a pair's code that hold the B id.
B_BITS = 24

_GAP = re.compile(r"(?<=\S) (?!\Z)")
#: Where a blank is no border of units: after white space, first or last.
_BLANK_GAP = re.compile(r"\s |^ | \Z")
_BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
_loaded: dict[tuple[str, str], "Vocabularies"] = {}


def byte_letters() -> dict[str, int]:
    """Byte of each letter that a byte-level vocabulary writes it with:
    printable bytes stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side:
    """One tokenizer's vocabulary: the bytes of each id, and the ids of the
    units met so far, one after the other."""

    def __init__(self, spelled: list[bytes], encode):
        self.spelled, self.encode = spelled, encode
        self.size = np.array([len(x) for x in spelled], np.int64)
        self.clear()

    def clear(self) -> None:
        self.ids = np.empty(0, np.int32)
        self.count = np.empty(0, np.int64)

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelled.__getitem__, ids))


class Vocabularies:
    """Ids of units under both tokenizers, encoding each distinct unit once."""

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        a = Tokenizer.from_file(byte_path)
        a.encode_special_tokens = True
        letters = byte_letters()
        names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
        b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        self.sides = (
            Side([bytes(letters[c] for c in x) for x in names],
                 lambda texts: [e.ids for e in a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]),
            Side([bytes([int(m[1], 16)]) if b.is_byte(i) and (m := _BYTE_PIECE.fullmatch(x))
                  else x.replace("▁", " ").encode() for i, x in enumerate(pieces)],
                 lambda texts: b.encode(texts, num_threads=1)))
        # A piece with a blank after something else would cross a unit's
        # border; A cuts there before it merges anything.
        self.by_unit = not any(re.search(rb"[^ ] ", s) for s in self.sides[1].spelled) \
            and not any(re.search(rb"[!-~] ", s) for s in self.sides[0].spelled)
        self.known: dict[str, int] = {}
        self.bad = np.empty(0, bool)

    def units(self, text: str | None) -> list[str]:
        """The text's units, without the blank each begins with."""
        if not text:
            return []
        if not self.by_unit:
            return [text]
        return _GAP.split(text) if _BLANK_GAP.search(text) else text.split(" ")

    def codes(self, units: list[str]) -> np.ndarray:
        if not all(map(self.known.__contains__, units)):
            new = [u for u in dict.fromkeys(units) if u not in self.known]
            if self.known and len(self.known) + len(new) > KEEP:
                self.known, self.bad = {}, np.empty(0, bool)
                for side in self.sides:
                    side.clear()
                new = list(dict.fromkeys(units))
            self._learn(new)
        for side in self.sides:
            side.first = np.cumsum(side.count) - side.count
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))

    def _learn(self, new: list[str]) -> None:
        """Units that end in a non-blank are encoded many at once and told
        apart by their bytes; the others, and strings that do not come out as
        they went in, one by one."""
        joinable = [u for u in new if u and not u[-1].isspace()] if self.by_unit else []
        groups = [joinable[i:i + JOINED] for i in range(0, len(joinable), JOINED)]
        texts = [" ".join(g) for g in groups]
        found = [side.encode(texts) for side in self.sides]
        order: list[str] = []
        ids: tuple[list, list] = ([], [])
        counts: tuple[list, list] = ([], [])
        for k, group in enumerate(groups):
            raw = b" " + texts[k].encode()
            ends = np.cumsum([1 + len(u.encode()) for u in group])
            cut = []
            for side, got in zip(self.sides, found):
                at = np.cumsum(side.size[got[k]])
                place = np.searchsorted(at, ends)
                if side.bytes_of(got[k]) != raw or not np.array_equal(at[place], ends):
                    break
                cut.append(np.diff(place, prepend=-1))
            if len(cut) == 2:
                order += group
                for s in (0, 1):
                    ids[s].append(np.asarray(found[s][k], np.int32))
                    counts[s].append(cut[s])
        bad = np.zeros(len(new), bool)
        done = set(order)
        alone = [u for u in new if u not in done]
        single = [side.encode(alone) for side in self.sides]
        for k, u in enumerate(alone):
            raw = b" " + u.encode()
            bad[len(order) + k] = any(side.bytes_of(got[k]) != raw for side, got in zip(self.sides, single))
            for s in (0, 1):
                ids[s].append(np.asarray(single[s][k], np.int32))
                counts[s].append(np.array([len(single[s][k])]))
        for s, side in enumerate(self.sides):
            side.ids = np.concatenate([side.ids, *ids[s]])
            side.count = np.concatenate([side.count, *counts[s]]).astype(np.int64)
        start = len(self.known)
        self.known.update(zip(order + alone, range(start, start + len(new))))
        self.bad = np.concatenate([self.bad, bad])


def vocabularies(byte_path: str, piece_path: str) -> Vocabularies:
    if (byte_path, piece_path) not in _loaded:
        _loaded[byte_path, piece_path] = Vocabularies(byte_path, piece_path)
    return _loaded[byte_path, piece_path]


def ends_together(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Runs (i, j, n): tokens i, i+1, ... of ``a`` end where j, j+1, ... of
    ``b`` do, n times.  Both lists ascend and have the same last value."""
    runs = []
    i, shift, n = 0, 0, len(a)
    while i < n:
        begin, step = i, 1
        while i < n and a[i:i + step] == b[i + shift:i + shift + step]:
            i += step
            step *= 2
        while step > 1:
            step //= 2
            if i < n and a[i:i + step] == b[i + shift:i + shift + step]:
                i += step
        if i > n:
            i = n
        if i > begin:
            runs.append((begin, begin + shift, i - begin))
        if i == n:
            break
        j = i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        runs.append((i, j, 1))
        i += 1
        shift = j + 1 - i
    return runs


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    before = np.cumsum(count) - count
    return np.repeat(first - before, count) + np.arange(int(count.sum()))


class Block:
    """The aligned tokens of several texts: ids of both sides one after the
    other (``bounds``: where each text's begin), and the positions of the
    tokens that end together."""

    def __init__(self, texts: list[str | None], words: Vocabularies):
        units = [words.units(t) for t in texts]
        n = np.array([len(u) for u in units], np.int64)
        codes = words.codes(list(chain.from_iterable(units)))
        doc = np.repeat(np.arange(len(texts)), n)
        fits = np.ones(len(texts), bool)
        fits[doc[words.bad[codes]]] = False
        keep = fits[doc]
        codes, doc = codes[keep], doc[keep]
        self.ids, self.bounds, ends = [], [], []
        for side in words.sides:
            count = side.count[codes]
            ids = side.ids[_spread(side.first[codes], count)]
            per_text = np.bincount(doc, count, len(texts)).astype(np.int64)
            self.ids.append(ids)
            self.bounds.append(np.concatenate(([0], np.cumsum(per_text))))
            ends.append(np.cumsum(side.size[ids]))
        (a, b), (a_at, b_at) = ends, self.bounds
        runs = []
        for k in range(len(texts)):
            lo, other = int(a_at[k]), int(b_at[k])
            found = ends_together(a[lo:a_at[k + 1]].tolist(), b[other:b_at[k + 1]].tolist())
            runs.append(np.array(found, np.int64).reshape(-1, 3) + (lo, other, 0))
        run = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
        self.a_last, self.b_last = _spread(run[:, 0], run[:, 2]), _spread(run[:, 1], run[:, 2])
        self.group_bounds = np.searchsorted(self.a_last, a_at)

    def pairs(self) -> np.ndarray:
        """Codes of the linked id pairs, link by link."""
        return self.ids[0][self.a_last].astype(np.int64) << B_BITS | self.ids[1][self.b_last]

    def digests(self) -> list[str]:
        """SHA-256 of each text's groups, ``a1,a2|b1;a3|b2,b3``; '' without
        tokens."""
        n_a, n_b = len(self.ids[0]), len(self.ids[1])
        after_a = np.full(n_a, ord(","), np.uint8)
        after_b = np.full(n_b, ord(","), np.uint8)
        after_a[self.a_last], after_b[self.b_last] = ord("|"), ord(";")
        # The A tokens of a group go before its B tokens.
        group_a = np.searchsorted(self.a_last, np.arange(n_a))
        group_b = np.searchsorted(self.b_last, np.arange(n_b))
        b_before = np.concatenate(([0], self.b_last + 1))
        place_a = np.arange(n_a) + b_before[group_a]
        place_b = np.arange(n_b) + self.a_last[group_b] + 1
        ids, after = np.empty(n_a + n_b, np.int32), np.empty(n_a + n_b, np.uint8)
        ids[place_a], ids[place_b] = self.ids
        after[place_a], after[place_b] = after_a, after_b
        raw, size = _decimal(ids, after)
        at = np.concatenate(([0], np.cumsum(size)))[self.bounds[0] + self.bounds[1]]
        return [hashlib.sha256(raw[lo:hi - 1]).hexdigest() if hi > lo else ""
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]


def _decimal(ids: np.ndarray, after: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The ids in decimal, each with its sign after it, and their lengths."""
    digits = len(str(int(ids.max()))) if len(ids) else 1
    out = np.zeros((len(ids), digits + 1), np.uint8)
    rest = ids.copy()
    size = np.full(len(ids), 2, np.int64)
    for k in range(digits - 1, -1, -1):
        shown = rest > 0 if k < digits - 1 else np.ones(len(ids), bool)
        rest, digit = np.divmod(rest, 10)
        out[:, k] = np.where(shown, digit + ord("0"), 0)
        if k < digits - 1:
            size += shown
    out[:, digits] = after
    flat = out.reshape(-1)
    return flat[flat > 0].tobytes(), size


def _lists(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values).cast(kind))


def _texts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    X.small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.col(f"`{text}`").cast("string").alias("t"))


def align(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, the ids of both sides and, for each
    group, the position of its last A and its last B token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies(byte_path, piece_path)
        for batch in batches:
            for lo, hi in X.slices(batch.column("t")):
                part = batch.slice(lo, hi - lo)
                b = Block(part.column("t").to_pylist(), words)
                n = np.diff(b.group_bounds)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("d"),
                    "a_ids": _lists(b.ids[0], b.bounds[0], pa.int32()), "b_ids": _lists(b.ids[1], b.bounds[1], pa.int32()),
                    "a_last": _lists(b.a_last - np.repeat(b.bounds[0][:-1], n), b.group_bounds, pa.int32()),
                    "b_last": _lists(b.b_last - np.repeat(b.bounds[1][:-1], n), b.group_bounds, pa.int32())})

    return _texts(docs, doc_id, text).mapInArrow(
        run, "doc_id long, a_ids array<int>, b_ids array<int>, a_last array<int>, b_last array<int>")


_BLOCK = ("block long, doc_id array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, digest array<string>, "
          "link array<int>, link_n array<int>, link_at array<int>, pair array<long>, n array<long>")


def _blocks(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str, text: str) -> DataFrame:
    """One row per block: its documents, its distinct pairs with their
    numbers, and for each document which of them it has how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabularies(byte_path, piece_path)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo, hi in X.slices(batch.column("t"), TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                b = Block(part.column("t").to_pylist(), words)
                groups = np.diff(b.group_bounds)
                pair, code, n = np.unique(b.pairs(), return_inverse=True, return_counts=True)
                width = max(1, len(pair))
                link, link_n = np.unique(np.repeat(np.arange(hi - lo), groups) * width + code, return_counts=True)
                row = {"block": number, "doc_id": part.column("d").to_pylist(), "n_a": np.diff(b.bounds[0]),
                       "n_b": np.diff(b.bounds[1]), "n_groups": groups, "digest": b.digests(),
                       "link": link % width, "link_n": link_n,
                       "link_at": np.searchsorted(link, np.arange(hi - lo + 1) * width), "pair": pair, "n": n}
                number += 1
                yield pa.RecordBatch.from_pydict(
                    {k: pa.array([v], t) for (k, v), t in zip(row.items(), (
                        pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.list_(pa.string()),
                        *[pa.list_(pa.int32())] * 3, *[pa.list_(pa.int64())] * 2))})

    return _texts(docs, doc_id, text).mapInArrow(run, _BLOCK)


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): links of each id pair in all blocks, and whether
    no other pair of its B id has more."""
    counts = written(blocks.select(F.inline(F.arrays_zip("pair", "n"))).groupBy("pair").agg(F.sum("n").alias("count")),
                     "pair_counts")
    b = F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, count, best) of every id pair linked in ``docs``."""
    blocks = written(_blocks(docs, byte_path, piece_path, doc_id, text), "aligned")
    return _pair_counts(blocks).select(F.shiftright("pair", B_BITS).cast("int").alias("a"),
                                       F.col("pair").bitwiseAND((1 << B_BITS) - 1).cast("int").alias("b"), "count", "best")


_COUNTED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def digest(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: tokens of both sides, groups, links, the links
    that are their B id's best, the sum of the links' counts, and the digest of
    the groups."""
    blocks = written(_blocks(docs, byte_path, piece_path, doc_id, text), "aligned")
    own = blocks.select("block", F.explode("pair").alias("pair")).join(_pair_counts(blocks), "pair")
    # A block's pairs are bounded by its text.
    back = own.groupBy("block").agg(F.collect_list(F.struct("pair", "count", "best")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].values for name in batch.schema.names if name != "block"}
                column = {name: np.asarray(v) for name, v in row.items() if name not in ("known", "digest", "doc_id")
                          and v is not None}
                known = row["known"]
                pair, count, best = (np.asarray(known.field(i)) for i in range(3)) if known is not None \
                    else (np.empty(0, np.int64),) * 3
                order = np.argsort(pair)
                count, best = count[order], best[order].astype(bool)
                link, times, at = column["link"], column["link_n"].astype(np.int64), column["link_at"].astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": row["doc_id"], **{c: row[c].cast(pa.int64()) for c in ("n_a", "n_b", "n_groups")},
                    "n_links": pa.array(X.per_text(times, at)),
                    "n_best": pa.array(X.per_text(times * best[link], at)),
                    "count_sum": pa.array(X.per_text(times * count[link], at)), "groups_sha256": row["digest"]})

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in _COUNTED)
    return blocks.drop("pair", "n").join(back, "block", "left").mapInArrow(run, schema)
