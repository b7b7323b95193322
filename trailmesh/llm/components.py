"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root its component's smallest node.

    Alternates large-star (each node links its larger neighbours to its smallest) and small-star (its smaller ones)
    until nothing changes; the number of rounds grows with the logarithm of the longest path. Each round's edges are
    a written table. Minima are combined before the shuffle and no neighbour list is gathered, so a node with very
    many edges is no heavier than its rows; its side of the join is one that AQE can split.
    """
    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    before = None
    while True:
        both = e.union(e.select("lo", "hi")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = saved(both.filter("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "edges")
        low = e.groupBy("hi").agg(F.min("lo").alias("m"))
        small = e.join(low, "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").union(low.select("hi", F.col("m").alias("lo")))
        e = saved(small.distinct(), "edges")
        state = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)")), F.lit(0).cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            roots = e.groupBy("hi").agg(F.min("lo").alias("root")).select(F.col("hi").alias("node"), "root")
            return roots.union(roots.select("root").distinct().select(F.col("root").alias("node"), "root"))
        before = tuple(state)
