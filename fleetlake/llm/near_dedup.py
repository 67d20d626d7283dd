"""Near-duplicate documents by an inverted join of signature coordinates.

A document's set holds its distinct ``SHINGLE``-word shingles; documents with
equal sets form a class that its smallest id stands for.  Each class has a
MinHash signature of ``K`` coordinates and is posted under its
(coordinate, value) pairs.  A pair of classes at the similarity threshold
agrees in fewer than ``T`` coordinates with a probability near 1e-7, so:

* prefix: a class is posted only under its rarest pairs, all but ``T - 1`` of
  those that any other class has; two classes with ``T`` agreements meet in
  at least one of these lists, and very common values are hardly ever posted;
* skip: the remaining coordinates are not merged list by list but compared in
  the two signatures; pairs with ``T`` or more agreements stay;
* links are confirmed on the full sets.

First each list's most typical class (the one whose values are most common)
meets all others.  Classes whose lists still hold several components are then
posted anew under the rarest shingles of their full sets; of lists with the
same members (the shingles of one shared passage) only the first is kept.
While the pairs left in these lists far outnumber their entries, about
``PIVOTS`` new pivots of every list meet its members of other components, in
rounds, until a round brings nothing together.  What is left then meets only
if it is in different components, one outside the list's largest, and the
shingles from the meeting point on still suffice for the similarity.  Before
their full sets are compared, such pairs must also agree in ``FINE_T`` of
``FINE`` one-bit coordinates, which a pair at the threshold misses with a
probability near 1e-7 and a pair at 0.63 reaches once in some 200 times.

Defined cases: empty and null texts have an empty set and are linked with
nothing; with 1 to 4 words the whole sequence is the one shingle; each row
with a null id is a document of its own after all others, so of null-id
copies one stays, and none where an id has the text; rows that share an id are
one document, linked if any of its texts is; an empty table gives an empty
result.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as X
from .components import components
from .shared import scratch, written

SHINGLE = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
K = 48
T = 20
#: One-bit coordinates; two of them agree with probability (1 + similarity) / 2.
FINE = 2048
FINE_T = 1714
#: New pivots of a list in a round; rounds go on while pairs > SPARE * entries.
PIVOTS = 32
SPARE = 64

_FIRST, _LAST = -(1 << 63), (1 << 63) - 1
_U = np.uint64
_rng = np.random.default_rng(77)
_MUL = _rng.integers(1, 1 << 63, K, dtype=np.uint64) | _U(1)
_ADD = _rng.integers(0, 1 << 63, K, dtype=np.uint64)
_FINE_MUL = _rng.integers(1, 1 << 63, FINE, dtype=np.uint64) | _U(1)


def _sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Per text, the sorted distinct hashes of its shingles."""
    s = X.scan(texts, X.BLANKS, lower=True)
    at, h = X.windows(s, size)
    bounds = np.searchsorted(at, s.words_at)
    out = []
    for d in range(s.n):
        n = int(s.words_at[d + 1] - s.words_at[d])
        if 0 < n < size:
            one = X.scan([texts[d]], X.BLANKS, lower=True)
            out.append(X.windows(one, n)[1])
        else:
            out.append(np.unique(h[bounds[d]:bounds[d + 1]]))
    return out


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature rows, two set fingerprints) of non-empty sets."""
    values = np.concatenate(sets)
    first = np.cumsum([0] + [len(x) for x in sets[:-1]])
    sig = np.empty((len(sets), K), np.uint32)
    for k in range(K):
        sig[:, k] = np.minimum.reduceat((values * _MUL[k] + _ADD[k]) >> _U(32), first)
    prints = [np.add.reduceat(X.mix(values ^ _U(c)), first) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
    return sig.view(np.int32), prints[0].view(np.int64), prints[1].view(np.int64)


def _fine_bits(values: np.ndarray) -> np.ndarray:
    """FINE one-bit coordinates of a set, as 64-bit words."""
    bits = np.empty(FINE, np.uint8)
    step = max(1, (1 << 20) // max(1, len(values)))
    for k in range(0, FINE, step):
        least = (values[None, :] * _FINE_MUL[k:k + step, None]).min(axis=1)
        bits[k:k + step] = X.mix(least) & _U(1)
    return np.packbits(bits).view(np.int64)


class Numbered:
    """Rows of ``docs`` as (o, row), where ``o`` is a number of the document:
    its id less ``shift``, and from ``after`` on one for each row without an
    id.  Such rows are written, so that every pass gives them the same one."""

    def __init__(self, docs: DataFrame, doc_id: str):
        own = F.col(f"`{doc_id}`").cast("long")
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        low, high, lost = docs.agg(F.min(own), F.max(own), F.count_if(own.isNull())).head()
        self.shift, self.after = 0, None
        self.named, self.nameless = docs.select(own.alias("o"), row), None
        if lost:
            rows = written(docs.where(own.isNull()).select(F.monotonically_increasing_id().alias("o"), row), "no-id")
            width = rows.agg(F.max("o")).head()[0] + 1
            low, high = (0, -1) if high is None else (low, high)
            self.shift = max(0, high + width - _LAST)
            if low - self.shift < _FIRST:
                raise ValueError("the ids leave no numbers for the rows without one")
            self.after = high + 1 - self.shift
            self.nameless = rows.select((F.col("o") + F.lit(self.after)).alias("o"), "row")
            self.named = docs.where(own.isNotNull()).select((own - F.lit(self.shift)).alias("o"), row)
        self.rows = self.named.unionByName(self.nameless) if lost else self.named

    def id_of(self, o):
        """The id behind a number, null for a row without one."""
        return o if self.after is None else F.when(o < self.after, o + F.lit(self.shift))


def signatures(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(o, n, f1, f2, sig) of texts (o, t): number of the document, set size,
    set fingerprint, signature."""
    X.small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in X.slices(batch.column("t")):
                part = batch.slice(lo, hi - lo)
                sets = _sets(X.text_bytes(part.column("t")), shingle)
                n = np.array([len(x) for x in sets], np.int64)
                full = np.flatnonzero(n)
                f1, f2 = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
                sig = np.empty((0, K), np.int32)
                if len(full):
                    sig, f1[full], f2[full] = _signatures([sets[i] for i in full])
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, K, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("o"), pa.array(n), pa.array(f1), pa.array(f2),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()))],
                    names=["o", "n", "f1", "f2", "sig"])

    return texts.mapInArrow(run, "o long, n long, f1 long, f2 long, sig array<int>")


def postings(classes: DataFrame, match: int = T) -> DataFrame:
    """(token, rep, score): each class under its prefix of coordinate-value
    pairs, rarest first; ``score`` is higher the more common its values."""
    tokens = classes.select("rep", F.posexplode("sig").alias("k", "v")).select(
        "rep", (F.shiftleft(F.col("k").cast("long"), 32) + F.col("v").cast("long")).alias("token"))
    # Written, so that AQE may split the tokens of a very common value below.
    common = written(tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1"), "common-values")
    held = tokens.join(common, "token").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("held"))  # at most K of a text
    size = F.size("held")
    score = F.aggregate("held", F.lit(0.0), lambda s, x: s + F.log2(x["n"]))
    return held.where(size >= match).select(
        "rep", F.round(score, 6).alias("score"),
        F.explode(F.slice("held", F.lit(1), size - (match - 1))).alias("p")).select("p.token", "rep", "score")


def _full_sets(texts: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """(rep, n, set) of the classes that are in some list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in X.slices(batch.column("t")):
                part = batch.slice(lo, hi - lo)
                sets = _sets(X.text_bytes(part.column("t")), shingle)
                ends = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("rep"),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))],
                    names=["rep", "set"])

    return texts.withColumnRenamed("o", "rep").join(reps, "rep", "left_semi") \
        .mapInArrow(run, "rep long, set array<long>")


def _alike(pairs: DataFrame, classes: DataFrame, match: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those of possible sizes that agree in
    ``match`` coordinates."""
    side = classes.select("rep", "n", "sig")
    return (pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
            .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
            .where(F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0),
                               lambda s, x: s + x) >= match)
            .select("a", "b"))


def _finely(pairs: DataFrame, sets: DataFrame, match: int) -> DataFrame:
    """Of written pairs (a, b), those that agree in ``match`` one-bit
    coordinates; these are made for classes in some pair only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_fine_bits(x.values.to_numpy().view(np.uint64)) for x in batch.column("set")]
            ends = np.arange(len(bits) + 1, dtype=np.int32) * (FINE // 64)
            flat = np.concatenate(bits) if bits else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["rep", "bits"])

    reps = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    bits = written(sets.join(reps, "rep", "left_semi").mapInArrow(run, "rep long, bits array<long>"), "bits")
    apart = F.aggregate(F.zip_with("xa", "xb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.join(bits.toDF("a", "xa"), "a").join(bits.toDF("b", "xb"), "b") \
        .where(FINE - apart >= match).select("a", "b")


def _confirmed(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    inter = F.size(F.array_intersect("xa", "xb"))
    return (near.join(sets.toDF("b", "xb"), "b").join(sets.toDF("a", "xa"), "a")
            .where(100 * inter >= percent * (F.size("xa") + F.size("xb") - inter))
            .select("a", "b"))


def _mixed(lists: DataFrame) -> DataFrame:
    """The rows (token, root, ...) of lists with several components, with each
    list's largest one as ``main``, its ``size`` and the list's ``rows``."""
    parts = lists.groupBy("token", "root").agg(F.count("*").alias("size"))
    main = parts.groupBy("token").agg(F.max(F.struct("size", "root")).alias("main"), F.sum("size").alias("rows"),
                                      F.count("*").alias("roots")).where("roots > 1")
    return lists.join(written(main.select("token", "main.root", "main.size", "rows")
                              .toDF("token", "main", "size", "rows"), "mixed-lists"), "token")


def _set_prefixes(full: DataFrame, percent: int) -> DataFrame:
    """(token, f, rep, n, ahead): each class under the rarest shingles of its
    full set, one of which it shares with any class similar enough; ``ahead``
    counts the shingles from this one on, so the overlap of two classes that
    first meet here is at most the smaller ``ahead``."""
    shingles = full.select("rep", "n", F.explode("set").alias("token"))
    common = written(shingles.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"), "common-shingles")
    held = shingles.join(common, "token").groupBy("rep", "n").agg(
        F.sort_array(F.collect_list(F.struct("f", "token"))).alias("held"))  # at most the set
    shared = F.size("held")
    length = shared - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    return held.where(length > 0).select("rep", "n", shared.alias("shared"),
                                         F.posexplode(F.slice("held", F.lit(1), length)).alias("at", "p")) \
        .select("p.token", "p.f", "rep", "n", (F.col("shared") - F.col("at")).alias("ahead"))


def _distinct_lists(posted: DataFrame) -> DataFrame:
    """The lists of two classes or more; of those with the same members only
    the first in the order of prefixes, where every ``ahead`` is largest."""
    members = posted.groupBy("token", "f").agg(
        F.count("*").alias("rows"), F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(5), "rep")).alias("y")).where("rows > 1")
    first = members.groupBy("rows", "x", "y").agg(F.min(F.struct("f", "token"))["token"].alias("token"))
    return posted.join(written(first.select("token"), "list-names"), "token").drop("f")


def _apart(x: str, y: str, percent: int):
    """Whether two entries of a list may still be linked, in other components."""
    return ((F.col(f"{x}.token") == F.col(f"{y}.token")) & (F.col(f"{x}.root") != F.col(f"{y}.root"))
            & (100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n"))
            & ((100 + percent) * F.least(f"{x}.ahead", f"{y}.ahead")
               >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def links(texts: DataFrame, signed: DataFrame, classes: DataFrame, shingle: int, percent: int,
          match: int) -> DataFrame:
    """(node, root) for every class that is linked with another one."""
    with scratch(texts.sparkSession) as kept:
        return kept(_links(texts, signed, classes, shingle, percent, match), "roots")


def _links(texts: DataFrame, signed: DataFrame, classes: DataFrame, shingle: int, percent: int,
           match: int) -> DataFrame:
    posted = written(postings(classes, match), "postings")
    lists = posted.groupBy("token").agg(
        F.max(F.struct("score", (-F.col("rep")).alias("rep"))).alias("top"), F.count("*").alias("n"))
    lists = written(lists.where("n > 1").select("token", (-F.col("top.rep")).alias("pivot")), "lists")
    in_list = posted.join(lists, "token")
    sets = written(_full_sets(texts, in_list.select("rep").distinct(), shingle), "sets")

    met = written(in_list.where("rep <> pivot")
                  .select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct(),
                  "pairs")
    found = written(_confirmed(_alike(met, classes, match, percent), sets, percent), "links")
    roots = components(found, "a", "b")

    # What the typical classes did not bring together.
    rooted = written(posted.select("token", "rep").join(roots.toDF("rep", "root"), "rep", "left")
                     .select("token", "rep", F.coalesce("root", "rep").alias("root")), "rooted")
    left = written(_mixed(rooted).select("rep").distinct(), "unsettled")
    full = sets.join(left, "rep").select("rep", "set", F.size("set").alias("n"))
    lists = written(_distinct_lists(written(_set_prefixes(full, percent), "prefixes")), "lists")

    def linked(pairs: DataFrame) -> DataFrame:
        near = written(_alike(pairs, classes, match, percent), "pairs")
        # The fine coordinates hold for this similarity; other settings go without them.
        near = _finely(near, sets, FINE_T) if percent >= PERCENT else near
        return written(_confirmed(near, sets, percent), "links")

    before, turn = None, 0
    while True:
        mixed = written(_mixed(lists.join(roots.toDF("rep", "root"), "rep", "left")
                               .withColumn("root", F.coalesce("root", "rep"))), "mixed-lists")
        outside = (F.col("rows") - F.col("size")).cast("double")
        one = mixed.select("token", "rows", outside.alias("out"), (F.col("rows") - outside).alias("size"))
        # Each list's pairs, shared out among its rows.
        pairs, rows = one.agg(F.coalesce(F.sum((F.col("out") * F.col("size") + F.col("out") * F.col("out") / 2)
                                               / F.col("rows")), F.lit(0.0)), F.count("*")).head()
        if pairs <= SPARE * rows or (before is not None and pairs > 0.9 * before):
            break
        before, turn = pairs, turn + 1
        # A pivot of one list is mostly one of lists like it, too, so pairs recur.
        chance = F.abs(F.xxhash64(F.lit(turn), "rep").cast("double")) / float(1 << 63)
        pivots = written(mixed.where(chance * F.col("rows") < PIVOTS), "pivots")
        star = written(_pairs(pivots.alias("x").join(mixed.alias("y"), _apart("x", "y", percent)))
                       .join(met, ["a", "b"], "left_anti"), "pairs")
        more = linked(star)
        met, roots = met.unionByName(star), components(roots.toDF("a", "b").unionByName(more), "a", "b")
    x, y = mixed.where("root <> main").alias("x"), mixed.alias("y")
    rest = _pairs(x.join(y, _apart("x", "y", percent)
                         & ((F.col("y.root") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))))
    more = linked(rest.join(met, ["a", "b"], "left_anti"))
    # Texts under one id are one document.
    several = signed.where("n > 0").groupBy("o").agg(F.min("f1").alias("x"), F.max("f1").alias("y")) \
        .where("x <> y").select("o")
    same = signed.join(several, "o", "left_semi").join(classes, ["f1", "f2"]) \
        .select(F.col("o").alias("a"), F.col("rep").alias("b"))
    return components(roots.toDF("a", "b").unionByName(more).unionByName(same), "a", "b")


def _components(numbered: Numbered, text: str, shingle: int = SHINGLE, percent: int = PERCENT,
                match: int = T) -> DataFrame:
    """(o, n, component) of every row; a component is the smallest number
    reachable."""
    texts = numbered.rows.select("o", F.col(f"row.`{text}`").cast("string").alias("t"))
    signed = written(signatures(texts, shingle), "signatures")
    classes = written(signed.where("n > 0").groupBy("f1", "f2").agg(
        F.min("o").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    roots = links(texts, signed, classes, shingle, percent, match)
    root_of = classes.select("f1", "f2", "rep").join(roots.toDF("rep", "root"), "rep", "left") \
        .select("f1", "f2", F.coalesce("root", "rep").alias("root"))
    component = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("o"))
    return signed.select("o", "n", "f1", "f2").join(root_of, ["f1", "f2"], "left") \
        .select("o", "n", component.alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, match: int = T) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest id reachable, null if only rows without an id are) and kept
    (whether that is its own; one of rows without an id)."""
    numbered = Numbered(docs, doc_id)
    return _components(numbered, text, shingle, percent, match).select(
        numbered.id_of(F.col("o")).alias("doc_id"), F.col("n").alias("n_shingles"),
        numbered.id_of(F.col("component")).alias("component_id"), (F.col("o") == F.col("component")).alias("kept"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without those that a smaller id, or another row if they have
    none, stands for; same columns."""
    numbered = Numbered(docs, doc_id)
    gone = _components(numbered, text, **settings).where("o <> component").select("o").distinct()
    return numbered.rows.join(gone, "o", "left_anti").select("row.*")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
           WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
linked AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, linked.b FROM reach JOIN linked ON reach.b = linked.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""
