"""Connected components by alternating star contraction: every step is a grouped minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import forget, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root from undirected edges (a, b): root is the smallest node that can be reached. Nodes without an edge to another
    node are not returned. The number of rounds follows the logarithm of a component's diameter."""
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        wide = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = wide.groupBy("a").agg(F.min("b").alias("m"))
        near = wide.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(near.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        forget(edges)
        edges, before, state = after, state, _state(after)
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
