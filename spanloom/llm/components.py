"""Connected components of a graph given as pairs, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on one key, so no neighbour list is ever gathered; every round is written to
the shared folder, which keeps the lineage short and the graph off any single machine, and deleted after the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1_000_003)).first()
    return tuple(row)


def _to_minimum(pairs: DataFrame, node: str, other: str) -> DataFrame:
    """Each (node, other) pair and the least of node and all its others."""
    least = pairs.groupBy(node).agg(F.min(other).alias("m")).withColumn("m", F.least("m", node))
    return pairs.join(least.hint("rebalance"), node)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one ordered type); root is the least node reachable.

    Pairs with a null end, loops and repeated pairs count for nothing. Raises if most_rounds don't suffice.
    """
    with Scratch() as hold:
        # an edge always points from the greater node a to the lesser node b
        now = hold(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        before = None
        for _ in range(most_rounds):
            mark = _signature(now)
            if mark == before or not mark[0]:
                ends = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
                return stored(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(ends))
            before = mark
            both = now.union(now.select("b", "a"))
            large = _to_minimum(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            small = _to_minimum(large, "a", "b")
            small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(large.groupBy("a").agg(F.min("b").alias("b")))
            last, now = now, hold(small.distinct())
            hold.drop(last)
    raise RuntimeError(f"components: {most_rounds} rounds did not suffice")
