"""Connected components of an edge table by star contraction, on DataFrames alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from colloquy.llm.common import stored


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    near = both_ways(edges)
    least = stored(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    return near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")), "least")
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return (row[0], row[1])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that is not its component's least node.

    Every round halves the distance to the root or better, and leaves at most as many edges as
    there are nodes; its result is a written table, so nothing is recomputed from the start.
    Minima are reduced before the shuffle and written, so that the joins with them are plain equi
    joins, which adaptive execution splits at a node that has very many neighbours.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    seen = signature(now)
    while seen[0]:
        now = stored(small_star(large_star(now)), "edges")
        before, seen = seen, signature(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
