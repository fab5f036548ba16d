"""Connected components of an edge table by alternating large and small stars.

Every round is joins and grouped minima, so a node with very many neighbours is a skewed join key, which adaptive
execution splits, and never one task's list. Each round is written to the shared checkpoint folder, so lost executors
cost a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import _common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges: u, v (orderable, u <> v not needed). Returns node, root: root is the least node reachable, for every node
    of the edges but the roots themselves."""
    spark = edges.sparkSession
    now = _common.checkpoint(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()  # u > v holds
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _common.checkpoint(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct())
        last, state = state, _state(now)
        _common.release(spark)
        if state == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)), F.bit_xor(F.xxhash64("v", "u"))).first()
    return tuple(row)
