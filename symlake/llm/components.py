"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str = "links") -> DataFrame:
    """node, label for every node of edges (u, v); label is the smallest node of its component.

    Each round links the neighbours of a node to the smallest of them, which at last leaves a star
    around every smallest node; the number of rounds grows with the logarithm of the nodes. All rounds
    are joins and aggregates over edges, written to the shared folder.
    """
    now = scratch.table(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    last, turn = mark(now), 0
    while last[0]:
        turn += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.table(large, f"{name}-large-{turn}")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = scratch.table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}", f"{name}-large-{turn}")
        now, before, last = after, last, mark(after)
        if last == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
