import math
import random
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlake.llm import catalogue, packing, token_counts, url_filter
from . import brute
from .conftest import ODD_TEXTS

WORD = public_tokenizers.path(catalogue.WORD_TOKENIZER)
BYTE = public_tokenizers.path(catalogue.BYTE_TOKENIZER)


def check_pieces(pieces, docs, size=4096):
    """Every id of every document in one piece; sequences gapless and within
    size.  Returns the share of padding."""
    tok = Tokenizer.from_file(WORD)
    ids_of = defaultdict(list)
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        ids_of[i].append(ids)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids_of)
    for i, several in ids_of.items():
        pool = Counter((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[i])
        assert sum(n * x[1] for x, n in pool.items()) == sum(map(len, several))
        for ids in several:  # a cover of each text by pieces of its own
            at = 0
            while at < len(ids):
                x = next(x for x in pool if x[0] == at and x[3] == len(ids) and pool[x]
                         and x[2] == zlib.crc32(np.array(ids[at:at + x[1]], "<u4").tobytes()))
                pool[x] -= 1
                at += x[1]
    pad = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    total = sum(p.length for p in pieces)
    return pad / (pad + total)


def test_packing_small_documents(small_docs):
    df, rows = small_docs
    pieces = packing.pack(df, WORD).collect()
    assert check_pieces(pieces, rows) < 0.02
    tok = Tokenizer.from_file(WORD)
    text = dict(rows)
    for p in pieces[::17]:
        assert p.ids == (tok.encode(text[p.doc_id], add_special_tokens=False).ids + [2])[p.start:p.start + p.length]


def test_packing_odd_cases(odd, no_docs):
    pieces = packing.pack(odd, WORD, with_ids=False).collect()
    assert check_pieces(pieces, ODD_TEXTS) < 0.02
    assert packing.pack(no_docs, WORD).count() == 0


def test_blocks_only_bound_memory(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 300)
    r, stream, out, sizes = random.Random(1), packing._Stream(32, 0), [], []
    for d in range(60):
        n = r.choice((1, 3, 20, 70, 500))
        sizes.append(n)
        stream.add(np.full(n, d, np.int32), np.arange(7, n + 1, 7), np.array([0]), np.array([n]), [d])
        if stream.length >= packing.BLOCK and (b := stream.decide(False, True)):
            out += b.to_pylist()
    out += stream.decide(True, True).to_pylist()
    assert [i for p in out for i in p["ids"]] == [d for d, n in enumerate(sizes) for _ in range(n)]
    at = defaultdict(int)
    for p in out:
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == sizes[p["doc_id"]]
        at[p["doc_id"]] += p["length"]
    assert [at[d] for d in range(60)] == sizes


def test_cuts_are_the_cheapest():
    r = random.Random(5)
    for _ in range(200):
        size = r.choice((8, 16, 40))
        p = np.cumsum([0] + [r.randint(1, size) for _ in range(r.randint(1, 30))])
        cost = np.array([0.0] + [float(r.choice((0, 3, 10))) for _ in p[1:]])

        def price(i, j):
            n = p[j] - p[i]
            return math.inf if n > size else (0 if n & (n - 1) == 0 else size - n) + cost[j]

        best = [0.0] + [math.inf] * (len(p) - 1)
        for j in range(1, len(p)):
            best[j] = min(best[i] + price(i, j) for i in range(j))
        chosen = packing.cuts(p, cost, size)
        assert chosen[0] == 0 and chosen[-1] == len(p) - 1
        assert sum(price(i, j) for i, j in zip(chosen, chosen[1:])) == best[-1]


def test_edited_counts_equal_encoding_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 4)
    count, r = token_counts.counter(BYTE, public_tokenizers.PATTERN), random.Random(3)
    alphabet = "ab 'sre\n\t.!12é  lvd\u00a0\x85<|>"
    for _ in range(3000):
        tree = token_counts.Tree("".join(r.choice(alphabet) for _ in range(r.randint(0, 60))), count)
        for _ in range(r.randint(1, 5)):
            tree.edit(r.randint(-2, len(tree.text) + 2), r.randint(0, 8), "".join(r.choice(alphabet) for _ in range(r.randint(0, 5))))
            assert tree.total == len(count.tokenizer.encode(tree.text, add_special_tokens=False).ids)
            assert tree.chars[1] == len(tree.text)
            assert token_counts.prefix_tokens(tree)[-1] <= tree.total


def test_edits_touch_few_tokens():
    count = token_counts.counter(BYTE, public_tokenizers.PATTERN)
    tree = token_counts.Tree("some words of a text. " * 5000, count)
    tree.edit(50_000, 3, "other words")
    assert 0 < tree.encoded < 20


def test_edited_text_and_short_leaves(monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 4)
    count, r = token_counts.counter(BYTE, public_tokenizers.PATTERN), random.Random(5)
    alphabet = "ab 'sre\n\t.!12é  lvd\u00a0"
    for _ in range(150):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 400)))
        tree, hot = token_counts.Tree(text, count), r.randint(0, len(text))
        for _ in range(30):
            at = min(len(text), hot if r.random() < 0.5 else r.randint(0, len(text)))
            taken, put = r.choice((0, 0, 3, 150)), "".join(r.choice(alphabet) for _ in range(r.choice((0, 2, 90))))
            tree.edit(at, taken, put)
            text = text[:at] + put + text[at + taken:]
            assert tree.text == text and tree.chars[1] == len(text)
            assert tree.total == len(count.tokenizer.encode(text, add_special_tokens=False).ids)
            assert all(len(pairs) <= 2 * token_counts.LEAF for pairs in tree.changed.values())


def test_many_edits_of_a_long_text_take_linear_time():
    count = token_counts.counter(BYTE, public_tokenizers.PATTERN)
    text = "one and the same line of words, again and again\n" * 105_000  # 5 MB
    tree, edits, start = token_counts.Tree(text, count), token_counts.cleaning_edits(text), time.monotonic()
    for e in edits:
        tree.edit(*e)
    assert len(edits) > 100_000 and len(tree.text) < 100
    word = token_counts.Tree("", count)
    for _ in range(50_000):  # all put in at one place
        word.edit(20, 0, " three more words")
    assert word.total == len(count.tokenizer.encode(word.text, add_special_tokens=False).ids)
    assert time.monotonic() - start < 60


def test_token_count_frame(odd, no_docs, small_docs):
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    for df, n in ((odd, len(ODD_TEXTS)), (small_docs[0], len(small_docs[1]))):
        rows = token_counts.count_edited(df, BYTE, public_tokenizers.PATTERN).collect()
        assert len(rows) == n and any(r.n_edits for r in rows)
        for r in rows:
            assert r.n_tokens == len(tok.encode(r.text or "", add_special_tokens=False).ids)
            assert r.n_tokens_edited == len(tok.encode(r.edited_text, add_special_tokens=False).ids)
    assert token_counts.count_edited(no_docs, BYTE, public_tokenizers.PATTERN).count() == 0


URLS = [(1, "http://A.Example.COM/en/1?x=1#y"), (2, "https://www.example.com/en/"), (3, "http://example.com/en"),
        (4, "http://example.com"), (5, "http://com/"), (6, "http://xcom/"), (7, "http://x.net/es/1://b"), (8, "http://x.net/fr/"),
        (9, "http://x.net/de/"), (10, None), (11, "no scheme"), (12, ""), (13, "://"), (14, "http://"), (15, "a://b?c/d"),
        (16, "http://W.www.example.com/en/z"), (9, "http://x.net/de/"), (None, "http://é.COM/Ü"), (17, "x\n://h\n/p\n#f")]


def expected_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = brute.low(rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda x: len(x[0])) if fit else (None, None)


def test_explicit_url_rules(spark):
    df = spark.createDataFrame([(*u, "x") for u in URLS], "page_id long, url string, verdict string")
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in url_filter.judge(df).collect()), key=repr)
    assert got == sorted(((i, *expected_rule(u)[:2], expected_rule(u)[2][0]) for i, u in URLS), key=repr)
    verdicts = {r.page_id: r.verdict for r in url_filter.judge(df).collect()}
    assert verdicts[1] == "block" and verdicts[2] == "allow" and verdicts[7] == "block" and verdicts[10] == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge(df.where("page_id in (9, 10)")).collect()} == {"allow"}  # nothing mined


def named(rule, basket):
    """The tokens of a basket that its deciding rule, like ``net/es/``, names."""
    host, *path = rule.split("/")
    labels = host.split(".")
    own = {"h:" + ".".join(labels[k:]) for k in range(len(labels))} | {f"p:{x}" for x in path if x}
    return {x for x in basket if x in own or x.startswith("h:") and x.endswith("." + host)}


def test_mined_url_rules_match_plain_python(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    address = pages.select("url").toDF("url")
    host, path = url_filter.host_of(address["url"]), url_filter.path_of(address["url"])
    baskets = {r.url: frozenset(r.items) for r in address.select(
        "url", url_filter.tokens(address["url"], host, path).alias("items")).distinct().collect()}
    urls = [r.url for r in pages.collect()]
    labelled = [(baskets[u], expected_rule(u)[2][1]) for u in urls if expected_rule(u)[2][0]]
    least = math.ceil(url_filter.MIN_SUPPORT * len(labelled))
    single = Counter(x for b, _ in labelled for x in b)
    n, n_label = Counter(), Counter()
    for b, label in labelled:
        b = sorted(x for x in b if single[x] >= least)
        for k in range(1, len(b) + 1):
            for c in combinations(b, k):
                n[c] += 1
                n_label[c, label] += 1
    rules = [(c, label, m / n[c], m / len(labelled)) for (c, label), m in n_label.items()
             if m >= least and m / n[c] >= url_filter.MIN_CONFIDENCE]
    free = [(b - named(expected_rule(u)[2][0], b), label) for (b, label), u in
            zip(labelled, [u for u in urls if expected_rule(u)[2][0]])]
    every, rules = rules, [r for r in rules if sum(set(r[0]) <= b and label == r[1] for b, label in free) >= least]
    assert (("p:en",), "block") in [r[:2] for r in every] and (("p:en",), "block") not in [r[:2] for r in rules]
    rules = [r for r in rules if not any(o[1] == r[1] and set(o[0]) < set(r[0]) and o[2] >= r[2] for o in rules)]
    assert rules
    for r in url_filter.judge(pages).join(pages, "page_id").collect():
        if r.rule is None:
            fired = [x for x in rules if set(x[0]) <= baskets[r.url]]
            best = max(((x[2], x[3], -len(x[0]), x[1]) for x in fired), default=(0, 0, 0, url_filter.DEFAULT))
            assert r.verdict == best[3] and (r.confidence is None) == (not fired)


def test_stages_keep_the_columns(spark, odd, no_docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontaminate", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.columns == odd.columns, name
        assert 0 < out.count() <= odd.count(), name
        assert stage(spark, no_docs, "/root/testdata/sf0.001").count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() > 0


def test_stages_carry_columns_named_like_their_own(spark, odd):
    names = ["score", "_score", "Score_0", "n_lines", "_n_lines", "n_dropped", "_n_dropped", "n_lines_0"]
    named = odd.select("*", *[F.lit(c).alias(c) for c in names if c not in odd.columns])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, "/root/testdata/sf0.001")
        assert out.columns == named.columns, name
        plain = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.count() == plain.count() > 0, name
        added = [c for c in names if c not in odd.columns]
        assert out.select(added).distinct().collect() == [tuple(added)], name


def test_pipeline_matches_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    pieces = corpus_pipeline.run(spark, sf).collect()
    scores = {r.doc_id: r.predicted for r in catalogue.op1_quality_classifier(spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if scores[r.doc_id] == 1]
    docs = [(i, t) for (i, old), (_, d, t) in zip(docs, brute.line_dedup(docs)) if not (d and not t.strip(" \t\n\x0b\x0c\r"))]
    near = brute.near(docs)
    docs = [d for k, d in enumerate(docs) if near[k][1] == d[0]]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {i: t for i, t in docs if not brute.contaminated(t, items)[-1]}
    hit = {i for i, _ in docs} - set(clean)
    got = {p.doc_id for p in pieces}
    assert set(clean) <= got <= set(clean) | hit
    tok = Tokenizer.from_file(WORD)
    ids = defaultdict(dict)
    for p in pieces:
        ids[p.doc_id][p.start] = p.ids
    for i, parts in ids.items():
        whole = [x for s in sorted(parts) for x in parts[s]]
        if i in clean:
            assert whole == tok.encode(clean[i], add_special_tokens=False).ids + [2]
        else:
            assert not brute.contaminated(tok.decode(whole[:-1]), items)[-1]


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql_oracles(spark, name):
    from oracle_compare import duck, rows_of
    df = catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    cur = duck("/root/testdata/sf0.001").execute(catalogue.oracle_sql()[name])
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
