"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.session import cut

#: The alternation needs O(log^2 n) rounds; far more than any real graph takes.
MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected ``edges``; ``component`` is the smallest node of it.

    Nulls and loops are dropped (a node that has only loops is not returned), repeated edges count once. Nothing is
    collected: each round is two group-bys and joins on a node, and a hub's rows can be split by AQE because the other
    side of each join has one row a node. Each round is checkpointed. Empty input gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = cut(e), None
    for _ in range(MAX_ROUNDS):
        e = cut(_small_star(_large_star(e)))
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to the smallest of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node's smaller neighbours and the node itself are tied to the smallest of them. Here u > v in every edge."""
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    tied = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
