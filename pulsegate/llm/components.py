"""Connected components of links by alternating large and small stars.

Each round is joins and map-side minima; no task holds a component.  Rounds grow with the
logarithm of the longest chain.  Lineage is cut by a reliable checkpoint per round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegate.session import durable


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(links: DataFrame, write: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """``node, root`` for every linked node but the roots; ``links`` are rows ``a, b`` of longs, a root is the least node.

    ``write`` keeps the edges of a round.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = write(ordered.distinct())
    state = _state(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: a node's larger neighbours move to its least neighbour.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: smaller neighbours and the node itself move to the least of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(lower, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = write(moved.union(lower.select("a", F.col("m").alias("b"))).distinct())
        before, state = state, _state(edges)
        if before == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
