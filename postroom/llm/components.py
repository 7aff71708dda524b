"""Connected components by alternating large and small stars, in DataFrame operations.

Nodes are longs.  Every round maps each edge towards smaller ids; the number of
edges does not grow, the rounds are logarithmic in the longest chain, and the
edges of a round are written to the shared folder, so that lineage stays short
and a lost executor costs one round.  Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postroom.llm.common import join_hot, stored


def _star(edges: DataFrame) -> DataFrame:
    """One large star and one small star over edges a > b."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    low = edges.unionByName(back).groupBy("a").agg(F.min("b").alias("m"), F.sum((F.col("b") > F.col("a")).cast("long")).alias("n"))
    low = stored(low.select("a", F.least("a", "m").alias("m"), "n").filter("n > 0"), "lows")
    # a centre can have a large share of all edges
    large = stored(join_hot(back, low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
    low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    low = stored(low, "lows")
    rest = join_hot(large, low.filter("n > 1"), "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every edge already leads to the end of its component."""
    twice = edges.groupBy("a").count().filter("count > 1").select("a")
    return twice.unionByName(edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")).isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node reachable.

    Loops, repeats and both directions of an edge are allowed; no edges give no rows.
    """
    now = stored(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if _stars(now):
            break
        now = stored(_star(now), "edges")
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def merged(found: DataFrame, edges: DataFrame) -> DataFrame:
    """``found``, as made by ``components``, after more ``edges`` (a, b), which are stored."""
    if edges.isEmpty():
        return found
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(edges))
