"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonehour.llm.common import dropped, staged


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest of u and its neighbours."""
    both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    m = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "links-min")
    return both.where("b > a").join(m, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, is linked to the smallest neighbour."""
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    m = staged(down.groupBy("u").agg(F.min("v").alias("m")), "links-min")
    linked = down.join(m, "u")
    return linked.select(F.col("m").alias("a"), F.col("v").alias("b")).union(m.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def _stars(e: DataFrame) -> bool:
    """Whether each node is either a smallest one or linked once, to a smallest one."""
    ends = e.select(F.col("a").alias("node"), F.lit(0).alias("above")).union(e.select("b", F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("above").alias("above"), F.min("above").alias("least"))
    return not seen.where("above > 1 or above = 1 and least = 0").take(1)


def components(links: DataFrame) -> DataFrame:
    """links(a, b) of comparable ids -> (node, component), the smallest id reachable.

    Nodes without a link are not in the result. Every round is a table in the
    shared folder, so that a lost executor costs that round at most. The rounds
    grow with the logarithm of the longest path, not with a component's size. A
    node that many link to is hot in a join: the smallest neighbours are tables
    of their own, so that both sides of a join are plain exchanges, whose hot
    partitions adaptive execution splits.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while not _stars(edges):
        nxt = staged(_small_star(_large_star(edges)), "links")
        dropped(edges)
        edges = nxt
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select("a", "a").distinct())
