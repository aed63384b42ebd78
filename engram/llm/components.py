"""Connected components by alternating large and small stars, on stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm import common as C


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b: long).

    Each round hangs larger neighbours on the smallest one, first around every node and then
    below it; the number of rounds grows with the logarithm of the longest chain.  Nothing is
    gathered per node but a minimum.  Loops and repeated links are ignored; no links, no rows.
    """
    pairs = C.staged(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = C.staged(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
                         .alias("p")).select("p.u", "p.v").filter("u <> v").distinct())
        pairs = C.staged(small, "links")
        # Stars: every node hangs on one other, and none of those hangs on anything.
        roots = pairs.select(F.col("v").alias("u")).distinct()
        loose = (pairs.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
                 .unionByName(pairs.select("u").join(roots, "u", "left_semi")))
        if loose.isEmpty():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
