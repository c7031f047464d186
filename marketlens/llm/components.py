"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum joined back to the edges, so a node with very many
neighbours is pre-aggregated and its rows can be split by an adaptive join. Each
round is written to the shared folder; nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketlens.llm.common import stored


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct())


def _small_star(e: DataFrame) -> DataFrame:
    """``e`` points from larger to smaller: every neighbour and the node go to the smallest one."""
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    j = e.join(low, "a")
    near = j.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = low.select("a", F.col("m").alias("b"))
    return near.unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): every node that has an edge, with the smallest node it reaches (b < a)."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
               "cc")
    state = None
    while True:
        n = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(n) == state or n[0] == 0:
            return e
        state = tuple(n)
        e = stored(_small_star(_large_star(e)), "cc")
