"""Connected components by alternating large and small stars, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

ROWS = 100_000  # rows of a partition; small graphs aren't spread over more tasks than they fill


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) to (node, component), the smallest node that can be reached.

    A step sends the neighbours of a node to the smallest of them: first those larger than
    the node, then those smaller.  The smallest is found by an aggregate that is combined
    before its shuffle and joined back, so a node with very many edges is no single task's
    work.  Ends when only stars are left: every node has one edge, to a node that has none
    of its own.  Nodes without an edge to another node are left out; edges with a null end
    count as none.
    """
    ties = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to"))
    stars = checkpointed(ties.distinct())
    while True:
        stars = stars.coalesce(stars.count() // ROWS + 1)
        lows = stars.groupBy("node").agg(F.min("to").alias("low"), F.max("to").alias("high"))
        centres = stars.select(F.col("to").alias("centre")).distinct()
        open_ = lows.join(centres, F.col("node") == F.col("centre"), "left").where("low < high OR centre IS NOT NULL")
        if open_.isEmpty():
            break
        both = stars.union(stars.select("to", "node"))
        low = both.groupBy("node").agg(F.least("node", F.min("to")).alias("low"))
        large = both.where("to > node").join(low, "node").select(F.col("to").alias("node"), F.col("low").alias("to")).distinct()
        least = large.groupBy("node").agg(F.min("to").alias("low"))
        moved = large.join(least, "node").where("to <> low").select(F.col("to").alias("node"), F.col("low").alias("to"))
        stars = checkpointed(moved.union(least.select("node", F.col("low").alias("to"))).distinct())
    return stars.select("node", F.col("to").alias("component")).union(stars.select("to", "to").distinct())
