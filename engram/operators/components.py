"""Connected parts of a graph, for dealing dependent rows to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import cut_lineage


def connected(edges: DataFrame) -> DataFrame:
    """node, part (the smallest node reachable) of every node of edges (a, b: long).

    Every round takes the smallest part among neighbours and then the part of that part, so
    the rounds grow with the logarithm of the longest path in ordinary graphs."""
    both = cut_lineage(edges.select("a", "b").unionByName(
        edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    parts = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("part")))
    while True:
        near = (both.join(parts.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("part").alias("near")))
        own = parts.join(near, "node").withColumn("low", F.least("part", "near"))
        up = parts.select(F.col("node").alias("low"), F.col("part").alias("top"))
        moved = cut_lineage(own.join(up, "low", "left").select(
            "node", F.col("part").alias("before"),
            F.least("low", "top").alias("part")))
        if moved.filter("part <> before").isEmpty():
            return moved.select("node", "part")
        parts = moved.select("node", "part")
