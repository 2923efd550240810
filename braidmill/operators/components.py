"""Connected components without gathering a component anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidmill.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a long, b long)``; the label is the smallest node.

    Large-star and small-star steps in turn until nothing changes.  Minima are
    partial aggregates and the joins are left to adaptive execution, so a hub
    that holds most edges is never gathered in one task.  Each round is written
    to the shared folder.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        star = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = star.unionByName(low.where("a > m").select("a", F.col("m").alias("b"))).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        small = star.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("e"))
        now = materialize(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        after = _signature(now)
        if after == before:
            break
        before = after
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return leaves.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first())
