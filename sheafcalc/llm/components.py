"""Connected components by alternating star operations on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheafcalc.llm.common import discard, release, stored


def least_neighbour(edges: DataFrame) -> DataFrame:
    """u, v, m: m is the least of u and its neighbours. The minimum is taken before the join, so a hot u sends a row per task."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "u")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of the edges u, v: a stored table. Rounds go on until one
    changes nothing; each replaces the table of the one before."""
    spark = edges.sparkSession
    now = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = least_neighbour(large.filter("u <> v"))
        joined = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        after = stored(joined.filter("u <> v").distinct())
        seen = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        discard(now)
        now = after
        release(spark)
        if mark == seen:
            break
        mark = seen
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = stored(roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
    discard(now)
    return out
