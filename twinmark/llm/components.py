"""Connected components of a link table, by rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def large_star(edges: DataFrame) -> DataFrame:
    """Points every larger neighbour of a node, in both directions of its links, at the node's least neighbour."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Points every node and its smaller neighbours at the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has a link; ``component`` is the least id reachable.

    ``edges`` has long columns a and b; direction, repeats and loops do not matter.  Alternating large and small
    stars end in stars around the least ids after a number of rounds that grows with the logarithm of the size.
    A node with very many links is aggregated before the shuffle, and the joins can be split.  Each round is
    written to the shared folder; it is the last one if every node has one link, to a node that has none.  No links
    give no rows.
    """
    now = store(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")

    for _ in range(rounds):
        heads = now.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if heads.where("n > 1").isEmpty() and now.join(heads.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        now = store(small_star(large_star(now)), "stars")
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
