"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import drop, shared_folder, written


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _rejoined(pairs: DataFrame) -> DataFrame:
    """pairs(u, v) with m, the least of u and its v: a sum for each u and one join, so a node with many links is no group."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root: every node of edges(a, b) with the least node that it reaches.

    Each round links all larger neighbours of a node to its least neighbour, then all smaller ones; the number of
    rounds grows with the logarithm of the longest path. A round's links are written to the shared folder, and those that
    they came from deleted.
    """
    spark, path = edges.sparkSession, shared_folder(edges.sparkSession)
    now = written(_oriented(edges), path=path)
    size = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _rejoined(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _rejoined(large)
        small = near.select(F.col("v").alias("a"), F.col("m").alias("b")).union(near.select(F.col("u").alias("a"), F.col("m").alias("b")))
        before, path = path, shared_folder(spark)
        now = written(small.where("a <> b").distinct(), path=path)
        drop(spark, before)
        was, size = size, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if size == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
