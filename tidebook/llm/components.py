"""Connected components of a distributed graph by alternating large-star and small-star rounds.

Each round points every edge closer to the smallest node of its component: a minimum per node (combined before the
shuffle) and a join back.  The edges of hubs, nodes that over one in ``HUB_SHARE`` edges have, are joined by broadcast
and never meet in one task; no neighbour list is ever gathered.  Rounds end when the edges are stars, each node pointing to
the smallest of its component and that one to none, which takes about the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import hub_join, shared_checkpoint

#: A node that over one in so many edges have is a hub; there are fewer than twice as many hubs.
HUB_SHARE = 1000


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    up = both.where(F.col("v") > F.col("u"))
    return hub_join(up, lowest, "u", n, HUB_SHARE).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = hub_join(down, lowest, "u", n, HUB_SHARE)
    moved = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(lowest.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 60, most: int | None = None) -> DataFrame:
    """(node, component) for every node that has an edge to another; component is the smallest node reachable.

    ``edges`` has two columns of one type.  Self-loops, repeated edges and nulls have no effect.  ``most`` bounds the rows of
    ``edges``, if that is known.
    """
    a, b = edges.columns
    now = edges.select(F.col(f"`{a}`").alias("u"), F.col(f"`{b}`").alias("v")).where(F.col("u") != F.col("v")).distinct()
    now = shared_checkpoint(now, most)

    def state(df: DataFrame) -> tuple:
        """Number of edges, and whether a node points to two others, or is pointed to and points on."""
        ends = df.select(F.col("u").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("pointed"))
        ends = ends.unionByName(df.select(F.col("v").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("pointed")))
        nodes = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("pointed").alias("pointed"))
        busy = (F.col("points") > 1) | ((F.col("points") > 0) & (F.col("pointed") > 0))
        row = nodes.agg(F.sum("points").alias("n"), F.bool_or(busy).alias("busy")).first()
        return row["n"] or 0, bool(row["busy"])

    n = now.count()
    busy = n > 0
    for _ in range(max_rounds):
        if not busy:
            break
        # neither star has more rows than edges and nodes together
        large = shared_checkpoint(_large_star(now, n).distinct(), 3 * n)
        now = shared_checkpoint(_small_star(large, n).distinct(), 3 * n)
        n, busy = state(now)
    else:
        if busy:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
