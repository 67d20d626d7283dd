"""Quality rules, line first.

Each line of a text is judged on its own; failing lines are taken out, and a
document is rejected when it fails the base counts or loses too much of its
text.  A line (``\\n``-split, with a word) fails when

* punctuation: more than ``SYMBOL_SHARE`` % of its word characters are symbols
  of ``#*$%&|<>`` ;
* navigation: it has at least two menu marks (``|`` ``>`` as words of their
  own) and fewer than ``WORDS_PER_MARK`` words per mark;
* boilerplate: it holds one of ``BOILERPLATE`` (A-Z lower-cased).

Defined cases: a null text has no words and no lines, gives zeros and is not
kept (fewer than 50 words); an empty table gives an empty result; repeated
rows are judged alike, one result each; other columns are carried by
``clean`` and may have any name but those it adds, which replace them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textcore as X

MIN_WORDS = 50
REPEAT_SHARE = 50
SYMBOL_SHARE = 10
WORDS_PER_MARK = 4
#: A document that loses more than this share (%) of its word characters goes.
MAX_LOSS = 30
# Phrases of page furniture, lower case.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy",
    "enable javascript", "lorem ipsum", "privacy policy", "read more", "sign up for our newsletter",
    "skip to content", "subscribe to our newsletter", "terms of service", "terms of use",
)

_SYMBOLS = X.byte_class(*b"#*$%&|<>")
_ADDED = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
          ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
          ("n_lines", T.LongType()), ("n_lines_failed", T.LongType()),
          ("chars_lost", T.LongType()), ("base_failed", T.BooleanType()),
          ("kept", T.BooleanType())]


def _judge(texts: list[bytes], with_text: bool) -> dict[str, list | np.ndarray]:
    s = X.scan(texts, X.BLANKS)
    n = s.counts
    inside = ~X.BLANKS[s.buf]
    letters = inside & ((s.buf & 0xC0) != 0x80)  # the first byte of each code point
    symbols = _SYMBOLS[s.buf]
    word_chars, n_symbols = X.per_text(letters, s.first), X.per_text(symbols, s.first)

    # Words in three-word windows that the text holds twice or more.
    at, h = X.windows(s, 3)
    key = X.combine(h, s.doc[at])
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = at[count[inverse] > 1]
    edge = np.zeros(len(s.doc) + 3, np.int32)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + 3, -1)
    n_repeat = X.per_text(np.cumsum(edge)[:len(s.doc)] > 0, s.words_at)

    # Lines with a word.
    breaks = np.flatnonzero(s.buf == 0x0A)
    lo, hi = np.concatenate(([0], breaks[:-1] + 1)), breaks
    words_in = np.searchsorted(s.start, hi) - np.searchsorted(s.start, lo)
    full = words_in > 0
    lo, hi, words_in = lo[full], hi[full], words_in[full]
    doc = np.searchsorted(s.first, lo, "right") - 1
    line_at = np.searchsorted(doc, np.arange(s.n + 1))
    line_key = X.combine(X.span_hashes(s.buf, lo, hi), doc)
    _, earliest = np.unique(line_key, return_index=True)
    new = np.zeros(len(lo), bool)
    new[earliest] = True
    n_dup = X.per_text(~new, line_at)

    def inside_lines(flags):
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[hi] - total[lo]

    chars, marks_of = inside_lines(letters), inside_lines(symbols)
    mark_word = np.zeros(len(s.buf), bool)
    alone = s.start[(s.end - s.start) == 1]
    mark_word[alone[(s.buf[alone] == 0x7C) | (s.buf[alone] == 0x3E)]] = True
    marks = inside_lines(mark_word)
    failed = (100 * marks_of > SYMBOL_SHARE * chars) | (
        (marks >= 2) & (words_in - marks < WORDS_PER_MARK * marks))
    low = X.LOWER[s.buf].tobytes()
    for phrase in BOILERPLATE:
        p, found = phrase.encode(), low.find(phrase.encode())
        while found >= 0:
            line = int(np.searchsorted(lo, found, "right")) - 1
            failed[line] = True
            found = low.find(p, int(hi[line]))
    lost = X.per_text(np.where(failed, chars, 0), line_at)

    base = (n < MIN_WORDS) | (100 * n_repeat > REPEAT_SHARE * n)
    out = {"n_words": n, "word_chars": word_chars, "n_symbols": n_symbols,
           "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "n_lines": np.diff(line_at),
           "n_lines_failed": X.per_text(failed, line_at), "chars_lost": lost,
           "base_failed": base, "kept": ~base & (100 * lost <= MAX_LOSS * word_chars)}
    if with_text:
        out["clean_text"] = _without(s, texts, lo[failed], doc[failed])
    return out


def _without(s: X.Scan, texts: list[bytes], lo: np.ndarray, doc: np.ndarray) -> list[str]:
    """The texts without the lines that begin at ``lo``."""
    bad: dict[int, set[int]] = {}
    for d, at in zip(doc.tolist(), lo.tolist()):
        bad.setdefault(d, set()).add(at - int(s.first[d]))
    out = []
    for d, text in enumerate(texts):
        if d in bad:
            kept, at = [], 0
            for line in text.split(b"\n"):
                if at not in bad[d]:
                    kept.append(line)
                at += len(line) + 1
            text = b"\n".join(kept)
        out.append(text.decode("utf-8", "replace"))
    return out


def clean(docs: DataFrame, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with the counts, the verdict ``kept`` and (``with_text``) the
    text without failing lines, ``clean_text``; no row is dropped here."""
    added = _ADDED + ([("clean_text", T.StringType())] if with_text else [])

    def judge(texts: pa.Array) -> list[pa.Array]:
        got = _judge(X.text_bytes(texts), with_text)
        return [pa.array(got[name]) for name, _ in added]

    return X.add_columns(docs, text, added, lambda: judge)


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
trigrams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
twice AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p
        FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM trigrams) WHERE n > 1)
  GROUP BY doc_id),
lines AS (
  SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)),
judged AS (
  SELECT doc_id, line, length(array_to_string(w, '')) AS chars,
         len([x FOR x IN w IF x IN ('|', '>')]) AS marks, len(w) AS n,
         length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS symbols
  FROM lines WHERE len(w) > 0),
failed AS (
  SELECT doc_id, line, chars, 100 * symbols > 10 * chars OR (marks >= 2 AND n - marks < 4 * marks)
         OR regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{phrases}') AS bad
  FROM judged),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
         count(*) FILTER (bad) AS n_lines_failed, coalesce(sum(chars) FILTER (bad), 0) AS chars_lost
  FROM failed GROUP BY doc_id),
base AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(twice.n, 0) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_lines_failed, 0) AS n_lines_failed,
         CAST(coalesce(chars_lost, 0) AS BIGINT) AS chars_lost
  FROM t LEFT JOIN per_doc USING (doc_id) LEFT JOIN twice USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * chars_lost <= 30 * word_chars AS kept
FROM base
""".replace("{phrases}", "|".join(BOILERPLATE))
