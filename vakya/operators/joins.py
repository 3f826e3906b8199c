"""Joins on intervals and on the nearest row, as equi-joins on time bins or windows over unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def interval_overlap(left: DataFrame, right: DataFrame, key: str, start: str, end: str, bin_width: int) -> DataFrame:
    """Pairs of one key with ``right.end > left.start and right.start < left.end`` (numbers), each once.

    Both sides are dealt out to the bins they reach, so the join is an equality on (key, bin) that neither compares all
    rows of a key nor needs them in one task; a pair counts in the first bin that both reach.
    """
    def bins(df: DataFrame) -> DataFrame:
        lo, hi = F.floor(F.col(start) / bin_width), F.floor(F.col(end) / bin_width)
        return df.withColumn("bin", F.explode(F.sequence(lo, F.greatest(lo, hi))))

    a = bins(left).select(F.col(key), "bin", F.struct(*left.columns).alias("a"))
    b = bins(right).select(F.col(key), "bin", F.struct(*right.columns).alias("b"))
    meet = F.greatest(F.floor(F.col(f"a.{start}") / bin_width), F.floor(F.col(f"b.{start}") / bin_width))
    return a.join(b, [key, "bin"]).where((F.col(f"b.{end}") > F.col(f"a.{start}")) & (F.col(f"b.{start}") < F.col(f"a.{end}")) & (F.col("bin") == meet)).select("a", "b")


def nearest_before(left: DataFrame, right: DataFrame, key: str, at: str, value: Column, tie: str, out: str) -> DataFrame:
    """For each row of ``left`` the value of the last row of ``right`` of its key that is strictly earlier: one shuffle of the union, no join."""
    both = left.select(F.col(key), F.col(at), F.col(tie), F.struct(*left.columns).alias("row"), F.lit(None).cast(right.select(value).schema[0].dataType).alias("value"), F.lit(0).alias("side"))
    other = right.select(F.col(key), F.col(at), F.col(tie), F.lit(None).cast(both.schema["row"].dataType).alias("row"), value.alias("value"), F.lit(1).alias("side"))
    w = W.partitionBy(key).orderBy(at, "side", tie).rowsBetween(W.unboundedPreceding, -1)
    found = both.unionByName(other).withColumn(out, F.last("value", ignorenulls=True).over(w)).where("side = 0")
    return found.select("row.*", out)


def set_report(left: DataFrame, right: DataFrame, key: str, left_ok: Column, right_ok: Column) -> DataFrame:
    """Of the keys of both: how many are good in both, in one only, in neither."""
    wide = left.select(key, left_ok.alias("l")).join(right.select(key, right_ok.alias("r")), key, "full_outer")
    l, r = F.coalesce("l", F.lit(False)), F.coalesce("r", F.lit(False))  # noqa: E741
    return wide.agg(F.count_if(l & r).alias("both"), F.count_if(l & ~r).alias("only_left"), F.count_if(~l & r).alias("only_right"), F.count_if(~l & ~r).alias("neither"))
