"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order in which it sees a fixed set of pivots,
nearest first.  The index holds vectors in blocks of at most ``BLOCK``; each
block has an inverted file per pivot, with the place the pivot takes in the
order of every vector posted there.  A query walks the files of all pivots,
adds up the footrule distance (the sum of ``|place for the query - place for
the vector|``) and so ranks the block; the best ``SHARE`` of it, with all that
tie with the last of them, is ranked again by the distance itself.  The share
is the same for every block, so the recall does not fall as tables grow.

Pivots are ``PIVOTS`` distinct vectors of a sample drawn by a hash of the id
(at most ``PIVOT_SAMPLE`` rows reach the driver); every vector is indexed.
Blocks of queries meet blocks of the index by shard (a key both have), so
neither side is broadcast, and each pair of blocks yields at most ``k`` rows a
query.

Distances are Euclidean, computed in double precision from the differences of
the original components.  Defined cases: vectors that are null, empty, zero, or
hold null or non-finite components take no part; shorter vectors count as
filled up with zeros; a row's own id is never its neighbour, so rows of one id
do not find each other, and each such query row is answered for itself; rows
with a null id are candidates only (last among ties); an empty table gives an
empty result.  Only the id and the vector are read.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textcore as X

#: Pivots; at most 256, so that a place fits a byte.
PIVOTS = 256
PIVOT_SAMPLE = 4 * PIVOTS
#: Part of each block that is ranked again by distance, and vectors at least.
SHARE = 0.25
LEAST = 64
#: Vectors of an index block, queries of a query block.
BLOCK = 4096
QUERIES = 256
#: Index blocks of a shard (queries are copied once for each shard).
SHARD_BLOCKS = 64

_BLOCK = "shard int, ids binary, size int, vectors binary, files binary"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    part = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~part & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    """The vectors of a list column as rows, filled up with zeros."""
    out = np.zeros((len(column), width), kind)
    values = np.asarray(column.flatten())
    size = np.asarray(pc.list_value_length(column), np.int64)
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def pivots(vectors: DataFrame, width: int, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> np.ndarray:
    """Up to ``n`` distinct vectors, chosen by a hash of the id.  At most
    ``sample`` rows reach the driver."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()
    found = {}
    for r in rows:
        v = np.zeros(width)
        v[:len(r.v)] = r.v
        found.setdefault(v.tobytes(), v)
    return np.array(list(found.values())[:n]).reshape(-1, width)


def places(matrix: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Place of each pivot (columns) in the order of each vector (rows)."""
    order = np.argsort((pivot ** 2).sum(1) - 2 * matrix.astype(np.float64) @ pivot.T, axis=1, kind="stable")
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.arange(len(pivot), dtype=np.uint8)[None], 1)
    return out


def _blocks(vectors: DataFrame, pivot: np.ndarray, width: int, kind: str, rows: int, shards: int) -> DataFrame:
    """Index blocks: ids, vectors, and per pivot the places it takes."""
    X.small_batches(vectors.sparkSession, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * 7919
        waiting: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(waiting).combine_chunks()
            ids = np.asarray(table["id"].fill_null(np.iinfo(np.int64).max), np.int64)
            matrix = _matrix(table["v"].combine_chunks(), width, kind)
            number += 1
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([number % shards], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
                "size": pa.array([len(ids)], pa.int32()), "vectors": pa.array([matrix.tobytes()], pa.binary()),
                "files": pa.array([np.ascontiguousarray(places(matrix, pivot).T).tobytes()], pa.binary())})

        held = 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, rows - held)
                waiting.append(part)
                held += part.num_rows
                batch = batch.slice(part.num_rows)
                if held == rows:
                    yield block()
                    waiting, held = [], 0
        if held:
            yield block()

    return vectors.mapInArrow(run, _BLOCK)


def rank(query: np.ndarray, own: np.ndarray, ids: np.ndarray, matrix: np.ndarray, files: np.ndarray,
         pivot: np.ndarray, k: int, share: float = SHARE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the (ids, distances) of up to ``k`` nearest rows of a
    block, nearest first."""
    few = min(len(ids), max(LEAST, int(np.ceil(share * len(ids)))))
    footrule = np.empty(len(ids), np.uint16)  # a sum is at most PIVOTS ** 2 / 2
    for q, i, place in zip(query, own, places(query, pivot)):
        footrule[:] = 0
        for p in range(len(pivot)):  # the inverted file of each pivot
            at = files[p]
            footrule += np.maximum(at, place[p]) - np.minimum(at, place[p])
        footrule[ids == i] = np.iinfo(np.uint16).max
        last = np.partition(footrule, few - 1)[few - 1]
        near = np.flatnonzero((footrule <= last) & (ids != i))
        gap = matrix[near] - q
        distance = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        if len(near) > k:
            kth = np.partition(distance, k - 1)[k - 1]
            best = np.flatnonzero(distance <= kth)
            near, distance = near[best], distance[best]
        order = np.lexsort((ids[near], distance))[:k]
        yield ids[near[order]], distance[order]


def _pairs(index: DataFrame, asked: DataFrame, pivot: np.ndarray, width: int, kind: str, k: int, share: float) -> DataFrame:
    """Per block of queries and block of the index, each query's nearest."""
    both = index.join(asked.select("shard", F.col("number").alias("asked"), F.col("ids").alias("own"),
                                   F.col("vectors").alias("query")), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["own"], np.int64)
                matrix = np.frombuffer(row["vectors"], kind).reshape(-1, width)
                files = np.frombuffer(row["files"], np.uint8).reshape(len(pivot), -1)
                found = list(rank(np.frombuffer(row["query"], kind).reshape(-1, width).astype(np.float64), own, ids, matrix, files, pivot, k, share))
                n = np.array([len(f[0]) for f in found], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "asked": pa.array(row["asked"] + np.repeat(np.arange(len(own)), n)),
                    "query_id": pa.array(np.repeat(own, n)), "vec_id": pa.array(np.concatenate([f[0] for f in found])),
                    "score": pa.array(np.concatenate([f[1] for f in found]))})

    return both.mapInArrow(run, "asked long, query_id long, vec_id long, score double")


def _asked(vectors: DataFrame, is_query: Column, width: int, kind: str, shards: int) -> DataFrame:
    """Blocks of queries, once for each shard.  ``number``: that of the
    block's first query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                yield pa.RecordBatch.from_pydict({
                    "number": pa.array([number]),
                    "ids": pa.array([np.asarray(part.column("id"), np.int64).tobytes()], pa.binary()),
                    "vectors": pa.array([_matrix(part.column("v"), width, kind).tobytes()], pa.binary())})
                number += part.num_rows

    blocks = vectors.where(is_query).mapInArrow(run, "number long, ids binary, vectors binary")
    return blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 10,
            share: float = SHARE, n_pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """The ``k`` nearest rows found for each row where ``is_query`` (over the
    columns ``id`` and ``v``) holds: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")))
    stats = kept.agg(F.max(F.size("v")).alias("width"), F.count(F.lit(1)).alias("n")).head()
    result = "query_id long, rank int, vec_id long, score double"
    if not stats.n:
        return spark.createDataFrame([], result)
    width = stats.width
    pivot = pivots(kept, width, min(n_pivots, 256))
    # Enough shards for every core, and a bounded number of blocks in each.
    shards = max(spark.sparkContext.defaultParallelism, -(-stats.n // (block * SHARD_BLOCKS)))
    kind = "f4" if isinstance(kept.schema["v"].dataType.elementType, T.FloatType) else "f8"
    if kind == "f8":
        kept = kept.withColumn("v", F.col("v").cast("array<double>"))
    index = _blocks(kept, pivot, width, kind, block, shards)
    asked = _asked(kept, is_query & F.col("id").isNotNull(), width, kind, shards)
    found = _pairs(index, asked, pivot, width, kind, k, share)
    place = F.row_number().over(Window.partitionBy("asked").orderBy("score", "vec_id"))
    missing = np.iinfo(np.int64).max
    return found.withColumn("rank", place).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"),
        F.when(F.col("vec_id") != missing, F.col("vec_id")).alias("vec_id"), "score")
