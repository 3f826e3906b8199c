"""Operators over ordered rows: islands, running state, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(df: DataFrame, key: list[str], order: list[str], starts: Column, out: str = "island") -> DataFrame:
    """Numbers runs of rows: a run starts where ``starts`` holds (over the rows of a key in order), from 0."""
    w = W.partitionBy(*key).orderBy(*order)
    return df.withColumn(out, (F.sum(F.when(starts, 1).otherwise(0)).over(w)).cast("bigint"))


def gap_segments(df: DataFrame, key: str, ts: str, tie: str, seconds: int) -> DataFrame:
    """A new segment after more than so many silent seconds; numbered from 0 within a key."""
    w = W.partitionBy(key).orderBy(ts, tie)
    silent = F.lag(ts).over(w) < F.col(ts) - F.expr(f"interval {seconds} seconds")
    marked = df.withColumn("__new", F.coalesce(silent, F.lit(False)))
    return islands(marked, [key], [ts, tie], F.col("__new"), "segment").drop("__new")


def before(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """The last non-null value of earlier rows of the key."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def after(df: DataFrame, key: str, order: list[str], value: Column, out: str) -> DataFrame:
    """The first non-null value of later rows of the key."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    return df.withColumn(out, F.first(value, ignorenulls=True).over(w))


def rank_in_bins(df: DataFrame, group: list[str], bin_: Column, order: list[str], out: str = "rank") -> DataFrame:
    """The rank of each row of a group from 1, in the order of the bins and then of ``order``: rows are ranked within bins, which are counted first, so a group may be larger than a task. Bins must be ordered as ``order`` would order them."""
    binned = df.withColumn("__bin", bin_)
    sizes = binned.groupBy(*group, "__bin").agg(F.count(F.lit(1)).alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(W.partitionBy(*group).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*group, "__bin", earlier.alias("__start"))
    within = binned.withColumn("__k", F.row_number().over(W.partitionBy(*group, "__bin").orderBy(*order)))
    return within.join(starts, [*group, "__bin"]).withColumn(out, F.col("__start") + F.col("__k")).drop("__bin", "__start", "__k")
