"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop, join_counted, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges; a component is its smallest node.

    Alternates large-star and small-star steps: each node's greater, then smaller
    neighbours move to the smallest node next to it, until nothing changes. Every step
    is aggregations and joins on node ids, written to the shared folder; edges never
    grow in number, and the neighbours of a node with very many stay in many tasks.
    """
    spark = edges.sparkSession
    current, path = stored(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n"))
        large = join_counted(both.where("v > u"), low, ["u"], low, "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, ["u"], least, "n")
        small = small.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = stored(small, "edges")
        # a forest of stars whose centres have no smaller neighbour changes no more
        changed = after.join(current, ["u", "v"], "left_anti").limit(1).count() + current.join(after, ["u", "v"], "left_anti").limit(1).count()
        drop(spark, path)
        current, path = after, after_path
        if not changed:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
