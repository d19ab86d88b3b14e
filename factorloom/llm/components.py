"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import Scratch, stored


def components(links: DataFrame, scratch: Scratch | None = None, most_rounds: int = 50) -> DataFrame:
    """node, component (the smallest node that links reach) for every node of links (a, b) that isn't its component's smallest.

    In a step every node's larger, then smaller neighbours are linked to the
    smallest node that it knows. That is found by an aggregation and brought back
    by a join, so the neighbours of a node with very many are never in one task.
    The work ends once every node is linked to one smaller node alone, or to
    larger ones alone: then each component is a star around its smallest node.
    """
    turned = lambda x: x.select(F.col("b").alias("a"), F.col("a").alias("b"))
    store = scratch.store if scratch else stored
    links = store(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    for _ in range(most_rounds):
        both = links.union(turned(links))
        lowest = store(both.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most")), "lowest")
        if lowest.filter("m < a and most != m").isEmpty():
            return lowest.filter("m < a").select(F.col("a").alias("node"), F.col("m").alias("component"))
        large = store(both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).filter("a != b"), "large")
        lower = store(large.groupBy("a").agg(F.min("b").alias("m")), "lower")
        met = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b")))
        links = store(met.filter("a != b").distinct(), "small")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")
