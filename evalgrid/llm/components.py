"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is two shuffles of the edges; the number of rounds grows with the
logarithm of the number of nodes, whatever the shape of the components. The
edges of a round are checkpointed, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrid.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of its neighbours and itself."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # checkpointed, so that the join's sides are plain shuffles and a centre with many links can be split
    least = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = checkpointed(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a and b, longs): the smallest node it reaches.

    The order of longs is the usual one. Loops and repeated edges are allowed;
    a node with a loop alone is left out, as are nodes without edges.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = checkpointed(_small_star(_large_star(now)))
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    centres = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
