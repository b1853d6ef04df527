"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import join_groups, release, settle


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds. A round emits at most one row per edge, takes
    minima with map-side aggregation, and is written to the shared folder, so no neighbour list
    is ever gathered and a lost executor repeats one round at most; the neighbours of a hub are
    joined with its minimum by broadcast. No edges give no rows.
    """
    now = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settle(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")).select("a", F.least("a", "m").alias("m"), "c"), f"{label}-low")
        large = join_groups(both, low, "a", "c").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.distinct(), f"{label}-large")
        release(now, low)
        least = settle(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c")), f"{label}-least")
        joined = join_groups(large, least, "a", "c").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = settle(least.select("a", F.col("m").alias("b")).unionByName(joined).distinct(), f"{label}-small")
        release(large, least)
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
