"""Connected components by alternating large and small stars.

Each round rewires links to smaller neighbours until every link leads to the
smallest node of its component.  All steps are joins and minimum
aggregates: the neighbours of a node are never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node of ``links`` but the roots themselves."""
    edges = written(links.select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root"))
                    .where("node <> root").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        # Written, so that AQE may split the links of a node that very many have.
        least = written(both.groupBy("node").agg(F.min("root").alias("m"))
                        .select("node", F.least("node", "m").alias("m")), "least")
        large = both.join(least, "node").where("root > node") \
            .select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
        large = written(large, "links")
        least = written(large.groupBy("node").agg(F.min("root").alias("m")), "least")
        small = large.join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")) \
            .unionByName(least.select("node", F.col("m").alias("root"))).where("node <> root").distinct()
        edges = written(small, "links")
        before, state = state, _state(edges)
        if state == before:
            return edges


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(20,0)"))).head())
