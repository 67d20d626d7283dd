"""Token counts that follow edits.

A document's pre-tokens (the pieces a byte-level tokenizer encodes one by one)
lie in the leaves of a segment tree; each tree node holds the characters and
tokens below it.  An edit finds its leaf by descending, re-encodes from a few
characters before it (``CONTEXT``, as far as a pre-token's end can depend on
what follows) until the new pre-tokens meet an old boundary behind it, puts
the result in place and updates the sums on the paths to the root.  Counts
after any edits equal those of encoding the edited text anew.

The pattern must take every character into some pre-token.  The work of an
edit follows what it takes out, puts in and encodes again, not the length of
the text; a single pre-token is always encoded whole, however long it is.

Defined cases: null texts count as empty (no tokens); edits out of range are
cut to the text; overlapping edits are applied in order, each to the result
of those before; repeated rows count alike; an empty table gives an empty
result.  Columns named like an added one are replaced.
"""

from __future__ import annotations

import os
from itertools import accumulate
from typing import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textcore as X

#: Pre-tokens in a leaf when a tree is built.
LEAF = 64
#: A pre-token's end depends on at most this many characters after it.
CONTEXT = 3
#: Distinct pre-tokens a worker remembers before it starts anew.
KEEP = 600_000
#: Pre-tokens encoded in one string.
JOINED = 256
#: Edit: (first character, characters taken out, text put in).
Edit = tuple[int, int, str]

_loaded: dict[str, "Counter"] = {}


class Counter:
    """Pre-tokens of a text and the number of tokens of each."""

    def __init__(self, tokenizer_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode what is new among ``pieces``."""
        new = [p for p in pieces if p not in self.known]
        if len(self.known) + len(new) > KEEP:
            self.known, new = {}, list(pieces)
        # Pieces of a blank and letters stay apart when they are put together.
        joined = [p for p in new if p[0] == " " and p[1:].isalpha()]
        alone = [p for p in new if not (p[0] == " " and p[1:].isalpha())]
        groups = [joined[i:i + JOINED] for i in range(0, len(joined), JOINED)]
        for group, e in zip(groups, self.tokenizer.encode_batch(["".join(g) for g in groups], add_special_tokens=False)):
            n = np.bincount(e.word_ids, minlength=len(group)).tolist()
            if len(n) == len(group):
                self.known.update(zip(group, n))
            else:  # a letter to us, not to the tokenizer
                alone += group
        got = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)
        self.known.update(zip(alone, map(len, got)))

    def counts(self, pieces: list[str]) -> list[int]:
        if not all(map(self.known.__contains__, pieces)):
            self.learn(set(pieces))
        return list(map(self.known.__getitem__, pieces))


def counter(tokenizer_path: str, pattern: str) -> Counter:
    if tokenizer_path not in _loaded:
        _loaded[tokenizer_path] = Counter(tokenizer_path, pattern)
    return _loaded[tokenizer_path]


class Tree:
    """Leaves of (pre-token, tokens) pairs under a binary tree of sums of
    characters, tokens and pre-tokens, kept as heaps.  Leaves that no edit has
    touched are slices of the first count.  An edit reads and writes only the
    leaves it reaches, whatever the length of the text; a leaf that grows past
    ``2 * LEAF`` is spread over its neighbours below the nearest node that has
    room (fuller nodes are allowed further down), so that leaves stay short
    wherever text is put in."""

    def __init__(self, text: str, count: Counter, pieces: list[str] | None = None):
        self.count, self.encoded = count, 0
        pieces = count.pattern.findall(text) if pieces is None else pieces
        self._lay(pieces, count.counts(pieces), max(1, -(-len(pieces) // LEAF)), LEAF)

    def _lay(self, pieces: list[str], tokens: list[int], n_leaves: int, size: int) -> None:
        """All pre-tokens in leaves of ``size``, under new sums."""
        self.base, self.changed, self.size = (pieces, tokens), {}, size
        self.width = 1 << (n_leaves - 1).bit_length()
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.sums = [self._heap(x) for x in (chars, np.array(tokens, np.int64), np.ones(len(pieces), np.int64))]

    def _heap(self, x: np.ndarray) -> list[int]:
        sums = np.zeros(self.width, np.int64)
        if len(x):
            parts = np.add.reduceat(x, np.arange(0, len(x), self.size))
            sums[:len(parts)] = parts
        levels = [sums]
        while len(levels[-1]) > 1:
            levels.append(levels[-1].reshape(-1, 2).sum(axis=1))
        return [0] + np.concatenate(levels[::-1]).tolist()

    def leaf(self, k: int) -> list[tuple[str, int]]:
        """(pre-token, tokens) of a leaf."""
        if k not in self.changed:
            at = slice(k * self.size, (k + 1) * self.size)
            self.changed[k] = list(zip(*(x[at] for x in self.base)))
        return self.changed[k]

    @property
    def chars(self) -> list[int]:
        return self.sums[0]

    @property
    def total(self) -> int:
        return self.sums[1][1]

    @property
    def text(self) -> str:
        return "".join(p for k in self._leaves(0, self.width) for p, _ in self.leaf(k))

    def _leaves(self, lo: int, hi: int) -> list[int]:
        return [k for k in range(lo, hi) if self.sums[2][self.width + k]]

    def _find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the pre-token that holds ``at``."""
        chars, k, first = self.sums[0], 1, 0
        while k < self.width:
            k *= 2
            if at - first >= chars[k] and chars[k + 1]:
                first += chars[k]
                k += 1
        return k - self.width, first

    def _next(self, leaf: int) -> int | None:
        """The next leaf that holds something."""
        n, k = self.sums[2], self.width + leaf
        while k > 1 and (k % 2 or not n[k + 1]):
            k //= 2
        if k <= 1:
            return None
        k += 1
        while k < self.width:
            k = 2 * k if n[2 * k] else 2 * k + 1
        return k - self.width

    def _set(self, leaf: int, pairs: list[tuple[str, int]]) -> None:
        self.changed[leaf] = pairs
        for heap, total in zip(self.sums, (sum(len(p) for p, _ in pairs), sum(n for _, n in pairs), len(pairs))):
            k = self.width + leaf
            heap[k] = total
            while k > 1:
                k //= 2
                heap[k] = heap[2 * k] + heap[2 * k + 1]

    def _spread(self, leaf: int) -> None:
        """Share out the pre-tokens of a leaf that has grown too long."""
        n, height = self.sums[2], max(1, self.width.bit_length() - 1)
        k, span, level = self.width + leaf, 1, 0
        while n[k] > (2 - level / height) * LEAF * span:
            if k == 1:  # no room anywhere: more leaves
                pairs = [x for j in self._leaves(0, self.width) for x in self.leaf(j)]
                size = max(1, LEAF // 2)
                self._lay([p for p, _ in pairs], [c for _, c in pairs], -(-len(pairs) // size), size)
                return
            k, span, level = k // 2, 2 * span, level + 1
        if level:
            lo = k * span - self.width
            pairs = [x for j in self._leaves(lo, lo + span) for x in self.leaf(j)]
            share = -(-len(pairs) // span)
            for j in range(span):
                self._set(lo + j, pairs[j * share:(j + 1) * share])

    def edit(self, at: int, taken: int, put: str) -> None:
        length = self.sums[0][1]
        at = min(max(at, 0), length)
        taken = min(max(taken, 0), length - at)

        # Where to begin: the last pre-token that starts CONTEXT characters or
        # more before the edit; pre-tokens ending there cannot have changed.
        leaf, begin = self._find(max(0, at - CONTEXT))
        skip = 0
        for p, _ in self.leaf(leaf):
            if begin + len(p) > at - CONTEXT:
                break
            begin, skip = begin + len(p), skip + 1

        # The old pre-tokens from there on, leaf by leaf: as many as it takes
        # until new pre-tokens meet an old boundary behind the edit.
        at, old_end, shift = at - begin, at - begin + taken, len(put) - taken
        old, leaves, firsts = self.leaf(leaf)[skip:], [leaf], [0]
        reach, want = sum(len(p) for p, _ in old), old_end + 16 * CONTEXT
        while True:
            after = self._next(leaves[-1])
            while reach < want and after is not None:
                leaves.append(after)
                firsts.append(len(old))
                old += self.leaf(after)
                reach += self.sums[0][self.width + after]
                after = self._next(after)
            pieces, kept = self._again(old, at, old_end, put, shift, after is None)
            if pieces is not None:
                break
            want = 2 * reach + 1
        self.encoded += len(pieces)

        new = self.leaf(leaf)[:skip] + list(zip(pieces, self.count.counts(pieces)))
        last = int(np.searchsorted(firsts, kept, "right")) - 1
        until = firsts[last + 1] if last + 1 < len(firsts) else len(old)
        if last:
            for k in leaves[1:last]:
                self._set(k, [])
            self._set(leaves[last], old[kept:until])
            self._set(leaf, new)
        else:
            self._set(leaf, new + old[kept:until])
        self._spread(leaf)

    def _again(self, old: list[tuple[str, int]], at: int, old_end: int, put: str, shift: int,
               whole: bool) -> tuple[list[str] | None, int]:
        """(new pre-tokens, old ones from which on all stay) for the text of
        ``old`` after an edit; None if it is too short to tell and the tree
        holds more (not ``whole``)."""
        before = "".join(p for p, _ in old)
        text = before[:at] + put + before[old_end:]
        ends = list(accumulate((len(p) for p, _ in old), initial=0))
        pieces, now, place = [], 0, 0
        for m in self.count.pattern.finditer(text):
            while place < len(ends) and (ends[place] < old_end or ends[place] + shift < now):
                place += 1
            if now >= at + len(put) and place < len(old) and ends[place] + shift == now:
                return pieces, place
            if not whole and m.end() + CONTEXT > len(text):
                return None, 0
            pieces.append(m.group())
            now = m.end()
        return (pieces, len(old)) if whole else (None, 0)


def cleaning_edits(text: str) -> list[Edit]:
    """The edits of a light cleaning, last first: e-mail addresses become
    ``<email>``, lines equal to an earlier line of 20 characters or more go."""
    edits, seen, at = [], set(), 0
    for line in text.split("\n"):
        if len(line) >= 20 and line in seen:
            edits.append((at, min(len(line) + 1, len(text) - at), ""))
        else:
            seen.add(line)
            if "@" in line:
                edits += [(at + m.start(), m.end() - m.start(), "<email>") for m in _EMAIL.finditer(line)]
        at += len(line) + 1
    return edits[::-1]


_EMAIL = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def count_edited(docs: DataFrame, tokenizer_path: str, pattern: str, text: str = "text",
                 edits: Callable[[str], list[Edit]] = cleaning_edits, with_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, n_edits, n_tokens_edited, n_reencoded (the
    pre-tokens encoded again for the edits) and ``with_text`` edited_text."""
    added = [(c, T.LongType()) for c in ("n_tokens", "n_edits", "n_tokens_edited", "n_reencoded")]
    added += [("edited_text", T.StringType())] if with_text else []

    def make():
        count = counter(tokenizer_path, pattern)

        def judge(texts: pa.Array) -> list[pa.Array]:
            rows, whole = [], [t or "" for t in texts.to_pylist()]
            pieces = [count.pattern.findall(t) for t in whole]
            count.learn(set().union(*pieces))
            for t, own in zip(whole, pieces):
                tree = Tree(t, count, own)
                n, todo = tree.total, edits(t)
                for e in todo:
                    tree.edit(*e)
                rows.append((n, len(todo), tree.total, tree.encoded, tree.text))
            return [pa.array([r[k] for r in rows]) for k in range(len(added))]

        return judge

    return X.add_columns(docs, text, added, make)


def prefix_tokens(tree: Tree) -> list[int]:
    """Tokens before each leaf, from the leaf sums."""
    return list(accumulate(tree.sums[1][tree.width:], initial=0))[:-1]
