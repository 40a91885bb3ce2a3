"""Connected components by alternating large-star and small-star steps (Kiveris and others)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import Scratch


def components(edges: DataFrame, kept: Scratch) -> DataFrame:
    """node, root (the least node of its component) for every node with an edge to another.

    edges has columns a, b of an ordered type, in any direction and repeated at will. Each step groups by node with
    minima only, so a node of very many edges is no burden to one task.
    """
    now = kept.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges0")
    turn, before = 0, None
    while True:
        # Large star: every greater neighbour of a node goes to the node's least neighbour or itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: every lesser neighbour of a node, and itself, goes to the least of them.
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        turn += 1
        now = kept.save(small, f"edges{turn}")
        sums = now.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sums == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = sums
