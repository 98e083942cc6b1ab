"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the smallest node that can be reached; nodes without a link are not listed.

    Alternating rounds of large stars (each node hands the smallest neighbour to its larger ones) and small stars (to
    its smaller ones), until no link changes; O(log n) rounds for the chains that similarity links form. Each round
    only groups links by a node and joins on it, so a hub with millions of links is combined per task before it is
    exchanged, and the join on it can be split. Each round is a stored table.
    """
    edges = stored(_ordered(links.select(F.col(a).alias("hi"), F.col(b).alias("lo"))))
    while True:
        # Large star: both directions; every neighbour above the node gets the least of the neighbourhood.
        both = edges.union(edges.select("lo", "hi")).toDF("node", "near")
        least = both.groupBy("node").agg(F.least("node", F.min("near")).alias("least"))
        large = _ordered(both.where("near > node").join(least, "node").select(F.col("near").alias("hi"), F.col("least").alias("lo")))
        # Small star: the node and its smaller neighbours get the least of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(low, "hi").select("lo", "hi", "least")
        step = _ordered(small.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).union(low.select("hi", F.col("least").alias("lo"))))
        step = stored(step)
        if _sum(step) == _sum(edges):
            return step.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        edges = step


def _ordered(df: DataFrame) -> DataFrame:
    return df.where("hi <> lo").select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct()


def _sum(df: DataFrame) -> tuple:
    """Count, and sums over hashes of the links: equal only if the links are."""
    seen = F.xxhash64("hi", "lo")
    return tuple(df.agg(F.count("*"), F.sum(seen.cast("decimal(38,0)")), F.bit_xor(seen)).first())
