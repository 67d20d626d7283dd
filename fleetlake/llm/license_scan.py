"""License scans by conditional compression.

The words around mentions of licensing, over line ends, are candidate blocks;
mentions near each other share one.  Around each mention, overlapping windows
of about a template's length are compressed alone and with the template as a
raw zstandard dictionary, as lower-case words with one blank between; the
bytes saved in the best window are compared with those the template saves on
itself, so neither a frame's own bytes nor what else is on the line counts.
Templates that save ``MIN_GAIN`` of that are aligned with every part around
the mention.  Of confirmed parts that overlap, the one with the greatest
saving wins.  A part is confirmed with at most ``MAX_DIFFERENCE`` of the
template's words changed and none of its ``names`` (the words that tell
licenses and versions apart; a template with a name missing around the mention
cannot be confirmed, so it is not compressed with).  ``TITLES`` win unchanged
on lines of their own; after ``SPDX``, the identifiers of the expression that
follows are the licenses.  Work follows the length of a text and its mentions.

Defined cases: null and empty texts have no blocks; repeated rows are judged
alike; an empty table gives an empty result.  Columns named like an added one
are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textcore as X

#: Compression level; lower ones do not find matches as short as a title.
LEVEL = 12
#: A template is compared word by word where it saves this share of what it
#: saves on its own wording.
MIN_GAIN = 0.2
#: Windows of a template begin this share of its words apart.
STEP = 0.125
#: Share of a template's words that may differ.
MAX_DIFFERENCE = 0.2
# Lower-case bytes, one of which every text with a mention holds.
STEMS = (b"licen", b"copyright", b"spdx", b"permission", b"redistribution", b"warranty", b"commons", b"domain",
         b"reserved")
# Byte strings, lower case, one of which every candidate holds.
MENTIONS = (b"licen", b"copyright", b"spdx", b"permission is hereby", b"permission to use", b"redistribution and use",
            b"without warranty", b"creative commons", b"public domain", b"all rights reserved")
# License, words that must not differ, wording.
TEMPLATES = (
    ("MIT", ("mit",), "Released under the MIT License."),
    ("MIT", ("mit",), "Licensed under the MIT License."),
    ("MIT", ("free", "charge", "sublicense"),
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
     "the Software"),
    ("Apache-2.0", ("apache", "2", "0"), "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", ("apache", "2", "0"),
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License."),
    ("GPL-3.0", ("gnu", "general", "3"), "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", ("gnu", "general", "2"), "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", ("gnu", "general", "3", "later"),
     "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0-or-later", ("gnu", "general", "2", "later"),
     "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
     "the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", ("gnu", "lesser", "3"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", ("gnu", "affero", "3"), "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", ("mozilla", "2", "0"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD", ("redistribution", "source", "binary"),
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met"),
    ("ISC", ("fee",), "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
                      "without fee is hereby granted"),
    ("Unlicense", ("public", "domain"), "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", ("cc0", "1", "0"), "Licensed under CC0 1.0 Universal."),
    ("CC-BY-4.0", ("by", "4", "0"), "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", ("by", "sa", "4", "0"), "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", ("by", "nc", "4", "0"), "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", ("by", "nd", "4", "0"), "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", ("by", "nc", "sa", "4", "0"), "Licensed under CC BY-NC-SA 4.0."),
    ("Proprietary", ("reserved",), "All rights reserved."),
)
# License and the words of its title.
TITLES = (
    ("MIT", "MIT License"), ("MIT", "The MIT License"), ("MIT", "The MIT License (MIT)"),
    ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International"),
    ("CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    ("CC-BY-NC-SA-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International"),
)
SPDX = "SPDX-License-Identifier:"
_COLON = re.compile(rb"\s*:")
_IDENTIFIER = re.compile(rb"[\s(]*([A-Za-z0-9][A-Za-z0-9.:+-]*)")
_NEXT = re.compile(rb"(?i)[ \t)]*\b(?<=[\s)])(and|or|with)\b(?=[\s(])")

_FOUND = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("start", T.LongType()),
    T.StructField("reduction", T.DoubleType()), T.StructField("n_diff", T.LongType()),
    T.StructField("differences", T.StringType())]))


def _words(text: bytes) -> tuple[list[bytes], X.Scan]:
    s = X.scan([text], X.NOT_ALNUM, lower=True, hashed=False)
    return [s.word(j) for j in range(len(s.start))], s


def _mentions(words: list[bytes]) -> list[int]:
    """Words at which a mention begins, whatever lies between the words."""
    joined, at = b" ".join(words), []
    begins = np.cumsum([0] + [len(w) + 1 for w in words])
    for mention in MENTIONS:
        found = joined.find(mention)
        while found >= 0:
            at.append(int(np.searchsorted(begins, found, "right")) - 1)
            found = joined.find(mention, found + len(mention))
    return sorted(set(at))


class Template:
    def __init__(self, name: str, names: tuple[str, ...], wording: str, title: bool = False):
        self.name, self.names, self.words = name, {n.encode() for n in names}, tuple(_words(wording.encode())[0])
        self.title, self.limit = title, 0 if title else int(MAX_DIFFERENCE * len(self.words))
        text = b" ".join(self.words)
        known = zstandard.ZstdCompressionDict(text, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.given = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False)
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.most = self.saved(text)
        self.reach = len(self.words) + self.limit + 1
        self.step = max(1, int(STEP * len(self.words)))

    @lru_cache(maxsize=1 << 12)
    def saved(self, text: bytes) -> int:
        return len(self.plain.compress(text)) - len(self.given.compress(text))

    @lru_cache(maxsize=1 << 12)
    def reduction(self, text: bytes) -> float:
        return self.saved(text) / len(self.plain.compress(text))

    def near(self, words: list[bytes], at: int) -> tuple[int, int] | None:
        """The words around the mention at a word, if the template helps to
        compress some part of them; none of its names may be missing there."""
        lo, hi = max(0, at - self.reach), min(len(words), at + self.reach)
        around = words[lo:hi]
        if not self.names <= set(around):
            return None
        size = len(self.words) + self.limit + self.step - 1
        for i in range(0, max(1, len(around) - size + self.step), self.step):
            window = around[i:i + size]  # one of them holds all of any part
            if self.names <= set(window) and self.saved(b" ".join(window)) >= MIN_GAIN * self.most:
                return lo, hi
        return None


class Disjoint:
    """Ranges that do not overlap."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, a: int, b: int) -> bool:
        place = bisect_left(self.starts, b)
        if place and self.ends[place - 1] > a:
            return False
        self.starts.insert(place, a)
        self.ends.insert(place, b)
        return True


class Templates:
    def __init__(self, templates=TEMPLATES):
        self.spdx = Template("", tuple(w.decode() for w in _words(SPDX.encode())[0]), SPDX)
        self.held = [Template(*t) for t in templates] + [
            Template(name, tuple(w.decode() for w in _words(title.encode())[0]), title, True)
            for name, title in TITLES] + [self.spdx]
        self.reach = 2 * max(t.reach for t in self.held)

    def best(self, block: bytes) -> dict | None:
        """The confirmed license of a block, or None."""
        found = self.findings(block)
        return min(found, key=lambda f: (f["n_diff"], -f["reduction"])) if found else None

    @lru_cache(maxsize=1 << 12)  # notices repeat
    def confirmed(self, around: tuple[bytes, ...], at: int) -> list[tuple[int, int, int, int, str]]:
        """(template, first word, end, differing words, what differs) of the
        confirmed parts near a mention."""
        out, have = [], set(around)
        for k, t in enumerate(self.held):
            if t.names <= have and (span := t.near(around, at)):
                lo, hi = span
                out += [(k, lo + a, lo + b, n_diff, differ) for a, b, n_diff, differ, touched in alignments(
                    t.words, around[lo:hi], t.limit) if not touched & t.names]
        return out

    def findings(self, block: bytes) -> list[dict]:
        """All confirmed licenses whose words do not overlap, in order.  Of
        a template's parts that overlap the least changed counts, of different
        templates' the one that saves most, then the least changed."""
        words, s = _words(block)
        found = {}
        for at in _mentions(words):
            first = max(0, at - self.reach // 2)
            for k, a, b, n_diff, differ in self.confirmed(tuple(words[first:at + self.reach // 2]), at - first):
                a, b, t, names = first + a, first + b, self.held[k], [self.held[k].name]
                text = b" ".join(words[a:b])
                if t is self.spdx:
                    names, end = identifiers(block, int(s.end[b - 1]))
                    b = int(np.searchsorted(s.start, end))
                if names and (not t.title or _own_lines(s, a, b)):
                    found[k, a, b] = (n_diff, differ, names, text)
        own = {k: Disjoint() for k, _, _ in found}
        ranked = []
        for (k, a, b), (n_diff, differ, names, text) in sorted(found.items(), key=lambda f: (
                f[1][0], f[0][1] - f[0][2], f[0])):
            if own[k].add(a, b):
                ranked.append((-self.held[k].saved(text), n_diff, a - b, a, b, k, differ, names, text))
        taken, out = Disjoint(), []
        for _, n_diff, _, a, b, k, differ, names, text in sorted(ranked, key=lambda f: f[:6]):
            if taken.add(a, b):
                out += [{"at": int(s.start[a]), "license": name, "reduction": round(self.held[k].reduction(text), 4),
                         "n_diff": n_diff, "differences": differ} for name in names]
        return sorted(out, key=lambda f: f["at"])


def identifiers(text: bytes, at: int) -> tuple[list[str], int]:
    """(identifiers, end) of the SPDX expression after a position, on the same
    line; exceptions, which follow ``WITH``, are no licenses."""
    stop = text.find(b"\n", at)
    stop = stop if stop >= 0 else len(text)
    colon = _COLON.match(text, at, stop)
    names, at, operator = [], colon.end() if colon else stop, b""
    while m := _IDENTIFIER.match(text, at, stop):
        at = m.end()
        if operator != b"with":
            names.append(m[1].rstrip(b".:-").decode())
        if not (m := _NEXT.match(text, at, stop)):
            break
        at, operator = m.end(), m[1].lower()
    return names, at


def _own_lines(s: X.Scan, a: int, b: int) -> bool:
    """Whether words ``a`` to ``b`` are all the words of their lines."""
    lo, hi = s.end[a - 1] if a else 0, s.start[b] if b < len(s.start) else len(s.buf)
    return (a == 0 or 10 in s.buf[lo:s.start[a]]) and (b == len(s.start) or 10 in s.buf[s.end[b - 1]:hi])


def alignments(wording: tuple[bytes, ...], words: tuple[bytes, ...], limit: int) -> list[tuple[int, int, int, str, set[bytes]]]:
    """Parts of ``words`` that differ from the ``wording`` in at most
    ``limit`` words: (first word, end, number of differing words, what
    differs, the words missing or replaced or added), the least changed part
    for each end."""
    m, n = len(wording), len(words)
    code = {w: i for i, w in enumerate(wording)}
    given = np.array([code.get(w, -1) for w in words], np.int64)
    rows, at = np.zeros((m + 1, n + 1), np.int64), np.arange(n + 1)
    for i, w in enumerate(wording, 1):
        rows[i, 0] = i
        rows[i, 1:] = np.minimum(rows[i - 1, :-1] + (given != code[w]), rows[i - 1, 1:] + 1)
        rows[i] = np.minimum.accumulate(rows[i] - at) + at  # words added
    if rows[m].min() > limit:
        return []
    out, rows = [], rows.tolist()
    for end in range(n + 1):
        if rows[m][end] > limit:
            continue
        i, j, steps = m, end, []
        while i:
            here = rows[i][j]
            if j and here == rows[i - 1][j - 1] + (wording[i - 1] != words[j - 1]):
                i, j = i - 1, j - 1
                steps.append((None, None) if here == rows[i][j] else (wording[i], words[j]))
            elif here == rows[i - 1][j] + 1:
                i -= 1
                steps.append((wording[i], None))
            else:
                j -= 1
                steps.append((None, words[j]))
        changes, old, new, touched = [], [], [], set()
        for x, y in steps[::-1] + [(None, None)]:
            if x is None and y is None:
                if old or new:
                    changes.append(f"-{_text(old)}+{_text(new)}")
                old, new = [], []
            else:
                old, new = old + [x] * (x is not None), new + [y] * (y is not None)
                touched |= {x, y} - {None}
        out.append((j, end, rows[m][end], "; ".join(changes), touched))
    return out


def _text(words: list[bytes]) -> str:
    return b" ".join(words).decode("utf-8", "replace")


def blocks(text: bytes, reach: int = 100) -> list[tuple[int, bytes]]:
    """(byte position, candidate): ``reach`` words on both sides of every
    mention of licensing, overlapping ones merged."""
    low = text.translate(bytes(X.LOWER))
    if not any(stem in low for stem in STEMS):
        return []
    words, s = _words(text)
    out: list[list[int]] = []
    for at in _mentions(words):
        lo, hi = max(0, at - reach), min(len(words), at + reach)
        if out and lo <= out[-1][1]:
            out[-1][1] = hi
        else:
            out.append([lo, hi])
    return [(int(s.start[lo]), text[s.start[lo]:s.end[hi - 1]]) for lo, hi in out]


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """``docs`` with ``n_blocks`` and ``found``: license, byte position,
    size reduction and wording differences of every confirmed license."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("reduction", pa.float64()),
                               ("n_diff", pa.int64()), ("differences", pa.string())]))

    def make():
        known = Templates(templates)

        def judge(texts: pa.Array) -> list[pa.Array]:
            n, found = [], []
            for t in X.text_bytes(texts):
                candidates = blocks(t, known.reach)
                n.append(len(candidates))
                found.append([f | {"start": at + f.pop("at")} for at, b in candidates for f in known.findings(b)])
            return [pa.array(n, pa.int64()), pa.array(found, kind)]

        return judge

    return X.add_columns(docs, text, [("n_blocks", T.LongType()), ("found", _FOUND)], make)
