"""Connected components of a graph of longs by alternating large-star and small-star steps.

Every step is a join and an aggregation over edges; nothing of the graph is gathered anywhere. The number of rounds
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long, not null) to ``(node, root)``: root is the smallest node reachable.

    Loops and repeated edges are allowed; nodes without an edge to another node are not returned. An empty table gives an
    empty table.
    """
    e = cut(_oriented(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    said = None
    while True:
        e = cut(_small_star(_large_star(e)))
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if said == now:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        said = now


def _oriented(e: DataFrame) -> DataFrame:
    """Each edge once, from its larger node u to its smaller node v."""
    return e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the least of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    smaller = e.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _oriented(smaller.unionByName(least.select("u", F.col("m").alias("v"))))
