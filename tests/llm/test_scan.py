import random

import numpy as np

from fleetlake.llm import textcore as X
from . import brute


def test_words_and_windows_match_regular_expressions():
    r = random.Random(1)
    alphabet = "aB é日\t\n\x0b .,#9\x00\x7f"
    for _ in range(300):
        texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 5))]
        for separators, pattern in ((X.BLANKS, brute.BLANK_WORD), (X.NOT_ALNUM, brute.ALNUM_WORD)):
            s = X.scan([t.encode() for t in texts], separators, lower=True)
            want = [pattern.findall(brute.low(t)) for t in texts]
            got = [[s.word(j).decode() for j in range(a, b)] for a, b in zip(s.words_at[:-1], s.words_at[1:])]
            assert got == want
            flat = [w for ws in want for w in ws]
            assert len(set(zip(flat, s.hash.tolist()))) == len(set(flat))
            at, h = X.windows(s, 3)
            grams = [g for ws in want for g in brute.grams(ws, 3)]
            assert len(at) == len(grams) and len(set(zip(grams, h.tolist()))) == len(set(grams))


def test_hashes_do_not_depend_on_the_pass(monkeypatch):
    text = [b"some words of a text " * 50, b"x" * 500]
    whole = X.scan(text, X.BLANKS).hash
    monkeypatch.setattr(X, "CHUNK", 64)
    assert np.array_equal(X.scan(text, X.BLANKS).hash, whole)


def test_anagrams_and_long_runs_differ():
    words = [b"ab", b"ba", b"abc", b"cab", b"a" * 64, b"a" * 65, b"a" * 128]
    assert len(set(X.scan([b" ".join(words)], X.BLANKS).hash.tolist())) == len(words)
