"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlake.llm import catalogue, periodic_runs, pivot_index, token_alignment
from . import brute

BYTE = public_tokenizers.path(catalogue.BYTE_TOKENIZER)
PIECE = public_tokenizers.path(catalogue.PIECE_TOKENIZER)


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    letters = token_alignment.byte_letters()

    def piece(i):
        x = b.id_to_piece(i)
        return bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode()

    def both(text):
        """Tokens of whole texts as (id, end), without any cutting in units."""
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        spelled = [[bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [piece(i) for i in ids[1]]]
        if any(b"".join(s) != (" " + text).encode() for s in spelled):
            return [], []
        return tuple(list(zip(i, np.cumsum([len(x) for x in s]).tolist())) for i, s in zip(ids, spelled))
    return both


def groups(a, b):
    """Ids of both sides between common ends."""
    common = sorted({e for _, e in a} & {e for _, e in b})
    out, lo = [], 0
    for hi in common:
        out.append(tuple([i for i, e in side if lo < e <= hi] for side in (a, b)))
        lo = hi
    return out


def alignment(rows, both):
    tokens = [(i, *both(t)) for i, t in rows]
    links = [[(x, y) for x, e in a for y, f in b if e == f] if len(a) < 300 else
             [(x, dict((f, y) for y, f in b)[e]) for x, e in a if e in {f for _, f in b}] for _, a, b in tokens]
    count = Counter(link for several in links for link in several)
    most = defaultdict(int)
    for (x, y), n in count.items():
        most[y] = max(most[y], n)
    for (i, a, b), several in zip(tokens, links):
        g = groups(a, b)
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        yield (i, len(a), len(b), len(g), len(several), sum(count[x] == most[x[1]] for x in several),
               sum(count[x] for x in several), sha(text) if g else "")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


ODD_TOKENS = ["", None, " ", "  a", "a  b   c ", "a\n b\n\n c\t d", "x ▁ y", "don't it's 'll <|endoftext|> <s> </s> <0x0A>",
              "\x00 a\x1c b", "é ü 日本語 テキスト 🙂 ok", "  a 　b", "a\r\n b", "aaaa aaaa", " x " * 40]


def test_alignment_equals_brute_force(spark, encoders):
    rng = random.Random(3)
    letters = "ab c  \n\t.'1é▁　日🙂\x1c\x85\xa0<|>"
    texts = ODD_TOKENS + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    rows = [(k // 2 if k % 7 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_a string").repartition(3)
    assert ordered(token_alignment.digest(df, BYTE, PIECE).collect()) == ordered(alignment(rows, encoders))


def test_alignment_of_documents(spark, small_docs, encoders):
    df, rows = small_docs
    short = [(i, t) for i, t in rows if len(t or "") < 4000]
    picked = df.where(F.length("text") < 4000)
    got = token_alignment.digest(picked, BYTE, PIECE)
    assert ordered(got.collect()) == ordered(alignment(short, encoders))
    pairs = token_alignment.pair_counts(picked, BYTE, PIECE)
    assert pairs.agg(F.sum("count")).head()[0] == got.agg(F.sum("n_links")).head()[0]
    one = token_alignment.align(picked, BYTE, PIECE).orderBy("doc_id").head()
    a, b = encoders(dict(short)[one.doc_id])
    assert [x for x, _ in a] == one.a_ids and [x for x, _ in b] == one.b_ids
    assert [a[x][1] for x in one.a_last] == [b[x][1] for x in one.b_last]


def test_alignment_odd_rows_and_empty_table(spark, odd, no_docs):
    out = token_alignment.digest(odd, BYTE, PIECE)
    assert out.count() == odd.count()
    assert all(r.n_links == r.n_groups for r in out.collect())
    assert token_alignment.digest(no_docs, BYTE, PIECE).count() == 0


def test_ends_together_skips_whatever_the_shift():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(1, 60)
        a, b = (sorted({*rng.sample(range(1, n + 1), rng.randint(1, n)), n}) for _ in range(2))
        got = [(i + k, j + k) for i, j, m in token_alignment.ends_together(a, b) for k in range(m)]
        assert got == [(a.index(e), b.index(e)) for e in sorted(set(a) & set(b))]


def all_runs(words):
    """Every run (start, length, period) by comparing all words."""
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            s, e = i, j + q
            if j > i and e - s >= max(24, 3 * q) and \
                    not any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q)):
                out.append((s, e - s, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_row(i, text):
    words = brute.BLANK_WORD.findall(text or "")
    if i is not None and words:
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, len(words))]
    found = all_runs(words)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else (None, None, None)
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None,
            sha("".join("%d,%d,%d\n" % r for r in found)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def periodic_texts(rng, n):
    for _ in range(n):
        words = []
        while len(words) < rng.randint(1, 500):
            c = rng.random()
            if c < 0.3:
                words += [rng.choice("abcd") for _ in range(rng.randint(1, 30))]
            elif c < 0.8:
                unit = [rng.choice("abcdefghijklmnop"[:rng.choice([1, 2, 16])]) for _ in range(rng.randint(1, rng.choice([3, 12, 60])))]
                words += (unit * rng.randint(2, 12))[:rng.randint(1, 300)]
            else:
                words += ["x"] * rng.randint(1, 120)
        yield rng.choice([" ", "\n", " \t"]).join(words)


@pytest.mark.parametrize("tile", [periodic_runs.TILE, 16])
def test_runs_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(periodic_runs, "TILE", tile)
    rows = [(k if k % 9 else None, t) for k, t in enumerate(periodic_texts(random.Random(tile), 60))]
    rows += [(70, None), (71, ""), (72, " \n"), (73, "a " * 24), (73, "a " * 23), (74, "a b c d e f g h " * 3)]
    ids, texts, key = [r[0] for r in rows], [(r[1] or "").encode() for r in rows], 0
    # The tile size holds in this process: its parts are made here, the rest in Spark.
    made = [row for b in periodic_runs._slice_parts(ids, texts, key, periodic_runs.planted_order, False) for row in b.to_pylist()]
    assert any(r["g"] for r in made) == (tile == 16)
    parts = spark.createDataFrame([tuple(r[c] for c in periodic_runs._ARROW.names) for r in made], periodic_runs._PART)
    monkeypatch.setattr(periodic_runs, "_parts", lambda *a, **b: parts)
    got = periodic_runs.runs(parts, with_text=True)
    assert ordered(r[:8] for r in got.collect()) == ordered(run_row(*r) for r in rows)


def test_runs_of_documents(spark, small_docs):
    df, rows = small_docs
    short = [(i, t) for i, t in rows if len(t or "") < 6000]
    got = periodic_runs.runs(df.where(F.length("text") < 6000), with_text=False, order=periodic_runs.planted_order)
    assert ordered(got.collect()) == ordered(run_row(*r) for r in short)
    assert sum(r[1] for r in map(lambda r: run_row(*r), short)) > 10


def test_runs_odd_rows_and_long_text(spark, odd, no_docs):
    out = periodic_runs.runs(odd)
    assert out.count() == odd.count()
    assert periodic_runs.runs(no_docs).count() == 0
    long = spark.createDataFrame([(1, "a " * 300_000), (2, " ".join(f"w{k % 30011}" for k in range(200_000)))],
                                 "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs.runs(long).collect()}
    assert (got[1].n_runs, got[1].start, got[1].length, got[1].period, got[1].collapsed) == (1, 0, 300_000, 1, "a")
    assert (got[2].n_runs, got[2].length, got[2].period) == (1, 200_000, 30011)


def nearest(rows, every, k=10):
    ids, m = [r[0] for r in rows], np.array([r[1] for r in rows], np.float64)
    for n, (i, v) in enumerate(rows):
        if i is not None and i % every == 0:
            d = np.sqrt(((m - m[n]) ** 2).sum(1))
            yield i, sorted((d[j], ids[j] is None, ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]


def test_search_recall_and_exact_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {q: v for q, v in nearest(rows, 20)}
    got = defaultdict(list)
    for r in pivot_index.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
    assert set(got) == set(want)
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    hits = 0
    for q, found in got.items():
        assert [r.rank for r in found] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in found] == sorted((r.score, r.vec_id) for r in found)
        for r in found:
            assert math.isclose(r.score, np.sqrt(((vectors[q] - vectors[r.vec_id]) ** 2).sum()), rel_tol=1e-12)
        hits += len({r.vec_id for r in found} & {x[2] for x in want[q]})
    assert hits >= 0.95 * 10 * len(want)


def test_search_odd_vectors_copies_and_ties(spark):
    rng = np.random.default_rng(1)
    common = [float(x) for x in rng.normal(size=8)]
    rows = [(k, common) for k in range(3000)] + [(3000 + k, [float(x) for x in rng.normal(size=8)]) for k in range(3000)]
    rows += [(7000, None), (7100, [0.0] * 8), (7200, [float("nan")] + [1.0] * 7), (7300, [None] + [1.0] * 7),
             (7400, [float("inf")] * 8), (7500, []), (None, common), (200, common), (7600, common[:5])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, score int") \
        .repartition(5)
    got = defaultdict(list)
    for r in pivot_index.nearest(df, F.col("id") % 100 == 0).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert not {7000, 7100, 7200, 7300, 7400, 7500} & set(got) and 7600 in got
    assert [x[1] for x in sorted(got[0])] == list(range(1, 11))          # ties to smaller ids
    assert len(got[200]) == 20                                          # both rows of that id are answered
    usable = [(i, (v + [0.0] * 8)[:8]) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    want = dict(nearest(usable, 100))
    hits = [len({x[1] for x in got[q]} & {x[2] for x in want[q]}) for q in want if q >= 3000]
    assert sum(hits) >= 0.9 * 10 * len(hits)


def test_search_small_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert pivot_index.nearest(spark.createDataFrame([], schema), F.col("id") % 100 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], schema)
    assert pivot_index.nearest(one, F.col("id") % 100 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [4.0, 0.0])], schema)
    assert [tuple(r) for r in pivot_index.nearest(few, F.col("id") % 100 == 0).orderBy("rank").collect()] == \
        [(0, 1, 1, math.sqrt(2)), (0, 2, 2, 3.0)]
