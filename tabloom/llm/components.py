"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import stored


def _state(edges: DataFrame) -> tuple[int, int]:
    """Count and order-free digest of a set of links, to see when it no longer changes."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``links(a, b)``; ``root`` is the smallest node that it reaches.

    A node's least neighbour is found by an aggregate that combines before the shuffle and is joined back, so a hub
    with a very large share of the links is never gathered in one place. The number of rounds grows with the logarithm of
    the longest path. Null ends and links of a node with itself are ignored; no links give no rows.
    """
    edges = stored(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        # Large star: neighbours above a node move to its least neighbour.
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("n")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large-star")
        # Small star: a node and its lower neighbours move to the least of these.
        lower = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(lower, F.col("a") == F.col("n")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = stored(small.unionByName(lower.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
