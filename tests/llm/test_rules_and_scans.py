import random
import time
import textwrap

import pytest

from fleetlake.llm import catalogue, decontaminate, license_scan, quality_rules
from . import brute


def rule_rows(df):
    return sorted(map(tuple, quality_rules.clean(df).select(
        "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()), key=repr)


def test_quality_rules_match_plain_python(small_docs, odd):
    df, rows = small_docs
    assert rule_rows(df) == sorted(((t, *brute.rules(t)) for _, t in rows), key=repr)
    texts = [r.text for r in odd.select("text").collect()]
    assert rule_rows(odd) == sorted(((t, *brute.rules(t)) for t in texts), key=repr)


def test_quality_rules_take_out_failing_lines(spark):
    good = "A plain sentence of words that any reader would take for prose."
    text = "\n".join([good] * 3 + ["Home | News | About | Contact", "### $$$ ***", "please Read More here", ""])
    got = quality_rules.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).head()
    assert got.clean_text == "\n".join([good] * 3 + [""]) and got.n_lines_failed == 3


def test_quality_rules_empty_table_and_columns(no_docs, odd):
    assert quality_rules.clean(no_docs).count() == 0
    out = quality_rules.clean(odd)
    assert out.where("doc_id = 5").count() == 2 and dict(out.dtypes)["kept"] == "boolean" and "row" in out.columns


def hits(df, bench, **more):
    return sorted(map(tuple, decontaminate.digest(decontaminate.find(df, bench, **more)).collect()), key=repr)


def test_decontamination_matches_plain_python(spark, small_docs, odd):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    df, rows = small_docs
    want = sorted(((i, *brute.contaminated(t, items)) for i, t in rows), key=repr)
    assert hits(df, bench) == want and any(w[-1] for w in want)
    assert hits(df, bench, slice_chars=3000) == want  # several broadcast sets


def test_decontamination_odd_cases(spark, odd, no_docs):
    from .conftest import ODD_TEXTS, PASSAGE
    items = [(1, PASSAGE), (2, "without an id"), (3, ""), (4, None), (None, "a b c"), (1, PASSAGE), (12, "A, B; C")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(((i, *brute.contaminated(t, [x for x in items if None not in x])) for i, t in ODD_TEXTS), key=repr)
    assert hits(odd, bench) == want
    assert hits(no_docs, bench) == []
    assert not any(r[-1] for r in hits(odd, bench.limit(0)))
    assert 8 not in {r.doc_id for r in decontaminate.remove(odd, bench).collect()}  # mostly the passage
    left = decontaminate.remove(odd, bench, min_left=0.0)
    assert left.columns == odd.columns and left.where("text is null").count() == 2
    assert not any(r[-1] for r in hits(left, bench))
    kept = {r.doc_id: r.text for r in left.collect()}
    assert 7 not in kept and 5 not in kept and kept[8] == "Before it.  , after it." and kept[2] == ""


@pytest.mark.parametrize("name,_,wording", license_scan.TEMPLATES)
def test_each_template_is_found_in_its_own_words(name, _, wording):
    known = license_scan.Templates()
    text = ("Some words before.\n" + wording + "\nSome words after.").encode()
    found = [known.best(b) for _, b in license_scan.blocks(text)]
    assert [f["license"] for f in found if f] and found[0]["license"] == name and found[0]["n_diff"] == 0


def test_license_wording_differences():
    known = license_scan.Templates()
    assert known.best(b"Licensed under the Apache License, Version 1.1.") is None
    got = known.best(b"This file is licensed under the GNU General Public License, version 3.")
    assert got["license"] == "GPL-3.0" and got["n_diff"] == 1 and got["differences"] == "-work+file"
    assert known.best(b"You need a driving licence for this vehicle.") is None


PROSE = "the old harbour town lies between two hills and its market opens early on most days of the long summer "


@pytest.mark.parametrize("name,_,wording", license_scan.TEMPLATES)
def test_each_template_is_found_inside_a_long_line(name, _, wording):
    known = license_scan.Templates()
    for n in (20, 50, 150, 300, 1500):
        line = (PROSE * 20)[:n] + ". " + wording + " " + (PROSE * 20)[:n]
        found = [known.best(b) for _, b in license_scan.blocks(line.encode())]
        assert [(f["license"], f["n_diff"]) for f in found if f] == [(name, 0)], n


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
def test_wrapped_wordings_are_found(prefix):
    known = license_scan.Templates()
    for name, _, wording in license_scan.TEMPLATES:
        for width in (70, 30):
            lines = textwrap.wrap(PROSE * 3 + ". " + wording + " " + PROSE * 3, width, break_on_hyphens=False)
            text = "\r\n".join(prefix + x for x in lines)
            found = [known.best(b) for _, b in license_scan.blocks(text.encode())]
            assert [(f["license"], f["n_diff"]) for f in found if f] == [(name, 0)], (name, width)


def licenses(text):
    known = license_scan.Templates()
    return [f["license"] for _, b in license_scan.blocks(text.encode()) for f in known.findings(b)]


def test_license_titles_and_spdx_lines():
    for name, title in license_scan.TITLES:
        for text in (title, "some words\n# " + title.upper() + "\n\nmore words", title + "\r\n" + PROSE):
            assert licenses(text) == [name], text
        assert licenses("unlike the " + title + " of old") == []
    assert licenses("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n" + PROSE) == ["GPL-3.0"]
    for line, want in (("MIT", ["MIT"]), ("GPL-3.0-or-later", ["GPL-3.0-or-later"]), ("Apache-2.0 */", ["Apache-2.0"]),
                       ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause"]),
                       ("GPL-2.0-only WITH Classpath-exception-2.0 or MIT-0 -->", ["GPL-2.0-only", "MIT-0"]), ("", [])):
        assert licenses("// SPDX-License-Identifier: " + line + "\nint main()") == want, line


def test_all_licenses_of_a_line_are_found(spark):
    two = "Licensed under CC BY 4.0. Released under the MIT License."
    every = " ".join(wording for _, _, wording in license_scan.TEMPLATES)
    far = "All rights reserved. " + PROSE * 12 + "Released under the MIT License."
    texts = [two, "é " + far, every, two + " " + two]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        for f in r.found:
            assert r.text.encode()[f.start:f.start + 3].isalnum() and f.n_diff == 0
    got = {r.doc_id: [f.license for f in r.found] for r in rows}
    assert got[0] == ["CC-BY-4.0", "MIT"] and got[1] == ["Proprietary", "MIT"] and got[3] == got[0] * 2
    assert got[2] == [name for name, _, _ in license_scan.TEMPLATES]


def plain_findings(text):
    """Every template against every part of the text, ranked by what it saves."""
    known, words = license_scan.Templates(), license_scan._words(text.encode())[0]
    ranked = []
    for k, t in enumerate(known.held):
        parts = []
        for a in range(len(words) if t is not known.spdx else 0):
            for b in range(a + len(t.words) - t.limit, min(len(words), a + len(t.words) + t.limit) + 1):
                part = words[a:b]
                d = list(range(len(part) + 1))
                for i, w in enumerate(t.words, 1):
                    above, d = d, [i]
                    for j, x in enumerate(part):
                        d.append(min(above[j] + (w != x), above[j + 1] + 1, d[j] + 1))
                if d[-1] <= t.limit and t.names <= set(part) and (
                        not t.title or b" ".join(part).decode() in text.lower().splitlines()):
                    parts.append((d[-1], a - b, a, b))
        own = []
        for n_diff, n, a, b in sorted(parts):
            if all(b <= x or y <= a for x, y in own):
                own.append((a, b))
                ranked.append((-t.saved(b" ".join(words[a:b])), n_diff, n, a, b, k, t.name))
    taken = []
    for _, n_diff, _, a, b, _, name in sorted(ranked):
        if all(b <= x or y <= a for x, y, *_ in taken):
            taken.append((a, b, name, n_diff))
    return [x[2:] for x in sorted(taken)]


def test_license_scan_equals_every_template_on_every_part():
    r, prose = random.Random(4), PROSE.split()
    known = license_scan.Templates()
    short = [t for t in known.held if 4 < len(t.words) < 30 and not t.title and t is not known.spdx]
    for _ in range(25):
        lines = []
        for t in r.sample(short, 2):
            words = [w.decode() for w in t.words]
            told = {i + d for i in license_scan._mentions(list(t.words)) for d in range(3)}  # without these none is looked for
            free = [i for i, w in enumerate(t.words) if w not in t.names and i not in told]
            for i in r.sample(free, min(len(free), r.randint(0, t.limit))):
                words[i] = r.choice(prose)
            lines.append(" ".join(r.choices(prose, k=r.randint(0, 8)) + words))
        text = "\n".join([lines[0], "mit license", lines[1]])
        found = [(f["license"], f["n_diff"]) for _, b in license_scan.blocks(text.encode()) for f in known.findings(b)]
        assert found == plain_findings(text) and len(found) >= 3, text


def test_one_long_text_of_notices_takes_linear_time():
    start, n = time.monotonic(), 150_000
    text = ("Released under the MIT License. " * n + "// SPDX-License-Identifier: MIT " * 10_000).encode()  # 5 MB
    known = license_scan.Templates()
    found = [f for _, b in license_scan.blocks(text, known.reach) for f in known.findings(b)]
    assert len(found) >= n and time.monotonic() - start < 60


def test_license_scan_frame(odd, no_docs):
    out = license_scan.scan(odd)
    assert {r.doc_id for r in out.where("size(found) > 0").collect()} == {15}
    assert out.count() == odd.count() and license_scan.scan(no_docs).count() == 0


def test_license_scan_counts_planted_lines(spark):
    rows = catalogue.op6_license_scan(spark, "/root/testdata/sf0.001").collect()
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    planted = {r.doc_id for r in texts if any(x in r.text for x in ("icensed under", "Released under", "All rights reserved"))}
    assert {r.doc_id for r in rows if r.n_found} == planted
