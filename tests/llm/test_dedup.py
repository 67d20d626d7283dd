import hashlib
import random

from fleetlake.llm import line_dedup, near_dedup
from fleetlake.llm.components import components
from . import brute
from .conftest import ODD_TEXTS


def test_line_dedup_matches_plain_python(odd, small_docs, no_docs):
    df, rows = small_docs
    for frame, docs, more in ((df, rows, {}), (odd, ODD_TEXTS, {}), (odd, ODD_TEXTS, {"batches": 7, "fanout": 2})):
        got = sorted(map(tuple, line_dedup.digest(line_dedup.dedup(frame, **more)).collect()), key=repr)
        want = sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest())
                       for (i, _), (n, d, t) in zip(docs, brute.line_dedup(docs))), key=repr)
        assert got == want
    out = line_dedup.dedup(odd)
    assert out.where("text is null").count() == 2 and "row" in out.columns and "o" in out.columns
    assert line_dedup.dedup(no_docs).count() == 0


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for k in range(5):
        keys = spark.range(k * 3, k * 3 + 6).selectExpr("id AS h1", "id AS h2", f"{k}L AS first", f"{k}L AS last")
        owned = runs.owners(keys)
        assert {r.h1: r.owner for r in owned.collect()} == {
            h: (max(0, (h - 3) // 3) if k and h < k * 3 + 3 else None) for h in range(k * 3, k * 3 + 6)}
        runs.add(owned.where("owner IS NULL").selectExpr("h1", "h2", "first AS owner"))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    owners = {r.h1: r.owner for run in runs.runs() for r in run.collect()}
    assert owners == {h: max(0, (h - 3) // 3) for h in range(18)}
    plan = runs.runs()[0].join(runs.runs()[1].hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan.split("Physical Plan")[1]  # bucket meets bucket


def components_of(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect() if r.doc_id is not None)



def brute_rows(docs):
    out = brute.near(docs)
    return sorted((docs[x][0], n, c, docs[x][0] == c) for x, (n, c) in out.items() if docs[x][0] is not None)


def test_near_duplicates_match_plain_python(spark, small_docs):
    df, rows = small_docs
    assert components_of(near_dedup.near_duplicates(df)) == brute_rows(rows)


def test_near_duplicates_in_a_large_group(spark):
    """Copies of one text with a changed word here and there: many pairs are
    just above and below the threshold, and lists are long."""
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(90)]
    docs = []
    for i in range(160):
        w = list(words)
        for _ in range(r.choice((0, 1, 1, 2, 3, 5))):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        docs.append((i * 3, " ".join(w)))
    docs += [(1000 + i, docs[5][1]) for i in range(40)]                       # exact copies
    docs += [(2000 + i, " ".join(words[:30] + [f"y{r.randrange(10**6)}" for _ in range(60)])) for i in range(60)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert components_of(near_dedup.near_duplicates(df)) == brute_rows(docs)


def family(r, n, shared=40, each=31, words=20):
    """Documents that hold most of the same passages, each pair near 0.63."""
    passages = [" ".join(f"p{r.randrange(10**6)}" for _ in range(words)) for _ in range(shared)]
    return [(i, " ".join(passages[k] for k in sorted(r.sample(range(shared), each)))) for i in range(n)]


def test_near_duplicates_in_a_family_below_the_threshold(spark, monkeypatch):
    docs = family(random.Random(12), 90)
    want = brute_rows(docs)
    assert 1 < len({c for _, _, c, _ in want}) < 90  # some links, most pairs have none
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert components_of(near_dedup.near_duplicates(df)) == want
    monkeypatch.setattr(near_dedup, "SPARE", 0)  # new pivots, as in much larger groups
    monkeypatch.setattr(near_dedup, "PIVOTS", 3)
    assert components_of(near_dedup.near_duplicates(df)) == want


def test_intermediate_tables_are_deleted(spark):
    import os

    from fleetlake.session import checkpoint_dir
    at = checkpoint_dir(spark).removeprefix("file:") + "/llm"
    docs = spark.createDataFrame(family(random.Random(3), 20), "doc_id long, text string")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    out = near_dedup.near_duplicates(docs)
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before}
    assert left == {"signatures", "classes", "roots"} and out.count() == 20


def test_near_duplicates_odd_cases(odd, no_docs):
    got = near_dedup.near_duplicates(odd)
    assert components_of(got) == brute_rows(ODD_TEXTS)
    assert got.count() == odd.count() and got.where("doc_id is null").count() == 2
    left = near_dedup.drop_copies(odd)
    assert left.columns == odd.columns
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_rows_without_an_id_are_documents_of_their_own(spark):
    r = random.Random(9)
    one, two, three, four = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    near = four + " and more"
    docs = [(1, one), (2, two), (2**63 - 1, three), (None, one), (None, two), (None, four), (None, near), (None, four)]
    docs += [(None, " ".join(f"v{r.randrange(10**6)}" for _ in range(20))) for _ in range(30)] + [(None, ""), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(df)
    assert components_of(got) == [(1, 56, 1, True), (2, 56, 2, True), (2**63 - 1, 56, 2**63 - 1, True)]
    lost = [(r.component_id, r.kept) for r in got.where("doc_id is null").collect()]
    assert sorted(lost, key=repr) == sorted([(1, False), (2, False)] + [(None, False)] * 2 + [(None, True)] * 33, key=repr)
    left = near_dedup.drop_copies(df).collect()
    assert sorted(r.doc_id for r in left if r.doc_id) == [1, 2, 2**63 - 1]
    texts = [r.text for r in left if r.doc_id is None]
    assert len(texts) == 33 and not {one, two} & set(texts) and len({four, near} & set(texts)) == 1
    assert near_dedup.drop_copies(df.where("doc_id is null")).count() == 35


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b").unionByName(
        spark.createDataFrame([(500, 700), (700, 600), (500, 500)], "a long, b long"))
    roots = {r.node: r.root for r in components(links, "a", "b").collect()}
    assert roots == {k: 0 for k in range(1, 200)} | {600: 500, 700: 500}
