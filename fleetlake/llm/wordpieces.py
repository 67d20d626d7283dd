"""Token ids of many words at once, encoding each distinct piece once.

For a tokenizer that lower-cases, drops white space and splits letters from
punctuation, the ids of a text are the ids of its pieces in order, where
pieces are cut at blanks and between ASCII letters or digits and ASCII
punctuation (not at apostrophes, which contractions need, nor next to other
characters, which may combine).  The strings of special tokens stay whole and
as they are.  A worker keeps the pieces it has met, up to ``KEEP`` of them.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from . import textcore as X

#: Distinct pieces a worker remembers before it starts anew.
KEEP = 600_000
#: Words encoded in one string.
JOINED = 256

_LETTER, _MARK, _OTHER = 1, 2, 3
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[ord("'")] = _OTHER
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _CLASS[_low:_high] = _LETTER
_CLASS[X.BLANKS] = 0

_loaded: dict[str, "WordIds"] = {}


def pieces(texts: list[bytes], special: list[bytes]) -> X.Scan:
    """The pieces of the texts, A-Z lower-cased."""
    raw = b"\n".join(texts) + b"\n"
    plain = np.frombuffer(raw, np.uint8)
    buf = X.LOWER[plain]
    kind = _CLASS[plain]
    low = buf.tobytes()
    for name in special:
        at = low.find(name)
        while at >= 0:  # the whole word that holds it stays as it is
            lo, hi = at, at + len(name)
            while lo and kind[lo - 1]:
                lo -= 1
            while kind[hi]:
                hi += 1
            kind[lo:hi], buf[lo:hi] = _OTHER, plain[lo:hi]
            at = low.find(name, hi)
    before, after = np.concatenate(([0], kind[:-1])), np.concatenate((kind[1:], [0]))
    start = np.flatnonzero((kind != 0) & ((before == 0) | (kind ^ before == _LETTER ^ _MARK)))
    end = np.flatnonzero((kind != 0) & ((after == 0) | (kind ^ after == _LETTER ^ _MARK))) + 1
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
    at = np.searchsorted(start, first)
    return X.Scan(buf, first, start, end, np.repeat(np.arange(len(texts)), np.diff(at)), at,
                  X.span_hashes(buf, start, end))


class WordIds:
    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # tokens that end a word
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        for token, i in self.tokenizer.get_vocab().items():
            self.last[i] = bool(suffix) and token.endswith(suffix)
        self._clear()

    def _clear(self) -> None:
        self.index = X.KeyIndex(np.empty(0, np.uint64))
        self.start, self.size = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.zeros(1 << 18, np.int32)
        self.used = 0

    def of(self, s: X.Scan) -> tuple[np.ndarray, np.ndarray]:
        """(first position in ``ids``, number of ids) of every piece of ``s``."""
        place, lost = self.index.find(s.hash)
        if len(lost):
            new, at = np.unique(s.hash[lost], return_index=True)
            if len(self.index.keys) + len(new) > KEEP:
                self._clear()
                new, at = np.unique(s.hash, return_index=True)
            else:
                at = lost[at]
            raw = s.buf.tobytes()
            flat, size = self._encode([raw[a:b] for a, b in zip(s.start[at].tolist(), s.end[at].tolist())])
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate((self.ids[:self.used], np.zeros(max(len(flat), len(self.ids)), np.int32)))
            self.ids[self.used:self.used + len(flat)] = flat
            keys, to = self.index.keys, np.searchsorted(self.index.keys, new)
            self.start = np.insert(self.start, to, self.used + np.cumsum(size) - size)
            self.size = np.insert(self.size, to, size)
            self.used += len(flat)
            self.index = X.KeyIndex(np.insert(keys, to, new))
            place, _ = self.index.find(s.hash)
        return self.start[place], self.size[place]

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        text = b" ".join(words).decode("utf-8", "replace").split(" ")
        # Words of letters are one unit of the tokenizer each, so many can be
        # encoded as one string and told apart by their last tokens.
        alone = [k for k, w in enumerate(text) if not (w.isalpha() and w.lower() == w)]
        out: list = [None] * len(text)
        for k, e in zip(alone, self.tokenizer.encode_batch_fast([text[k] for k in alone], add_special_tokens=False)):
            out[k] = e.ids
        joined = [k for k, x in enumerate(out) if x is None]
        strings = [" ".join([text[k] for k in joined[i:i + JOINED]]) for i in range(0, len(joined), JOINED)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        for i, ids in zip(range(0, len(joined), JOINED), got):
            group = joined[i:i + JOINED]
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            if len(ends) != len(group):  # a letter to us, not to the tokenizer
                for k in group:
                    out[k] = self.tokenizer.encode(text[k], add_special_tokens=False).ids
                continue
            a = 0
            for k, b in zip(group, ends):
                out[k] = ids[a:b]
                a = b
        size = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(size.sum())), size


def word_ids(tokenizer_path: str) -> WordIds:
    if tokenizer_path not in _loaded:
        _loaded[tokenizer_path] = WordIds(tokenizer_path)
    return _loaded[tokenizer_path]
