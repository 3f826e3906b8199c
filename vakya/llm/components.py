"""Connected components by alternating stars, with DataFrame operations and tables in the shared folder only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _least(edges: DataFrame) -> DataFrame:
    """For each node u of (u, v): the least of u and its neighbours; pre-aggregated before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges(u, v)``: the least node reachable. Rounds grow as a logarithm of the longest path."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        # In ``large`` each u is greater than its v.
        small = large.join(_least(large), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        shorter = written(small.select("e.u", "e.v").where("u <> v").distinct())
        now = _mark(shorter)
        forget(large)
        forget(edges)
        edges = shorter
        if now == mark:
            break
        mark = now
    found = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return written(found.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
