"""Samples, quotas and splits by hash; exact counts without a global sort into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BINS = 4096


def hash_quota(df: DataFrame, h: Column, share: float, tie: str) -> DataFrame:
    """The round(share * n) rows of the least hash, ties by ``tie``; a null hash is never chosen.

    Rows are counted in bins of the hash. Bins below the one in which the quota ends are taken whole, and only the rows
    of that bin are ordered.
    """
    binned = df.withColumn("__h", h).withColumn("__bin", F.floor(F.col("__h") * BINS).cast("int"))
    sizes = binned.groupBy("__bin").agg(F.count(F.lit(1)).alias("__n"))  # at most BINS + 1 rows
    upto = sizes.where("__bin is not null").select("__bin", "__n", F.coalesce(F.sum("__n").over(W.orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    quota = sizes.agg(F.round(F.sum("__n") * F.lit(share)).cast("bigint").alias("q")).scalar()
    open_bins = F.broadcast(upto.withColumn("__quota", quota).where("__before < __quota"))
    kept = binned.join(open_bins, "__bin")
    whole = kept.where("__before + __n <= __quota")
    edge = kept.where("__before + __n > __quota").withColumn("__rn", F.row_number().over(W.partitionBy("__bin").orderBy("__h", tie)))
    return whole.unionByName(edge.where("__rn <= __quota - __before").drop("__rn")).select(*df.columns)


def sample_per_stratum(df: DataFrame, stratum: list[str], h: Column, k: int, tie: str) -> DataFrame:
    """k rows of each stratum in the order of the hash; partial orders are cut to k before the shuffle by salting."""
    salted = df.withColumn("__h", h).withColumn("__salt", F.pmod(F.xxhash64(F.col(tie)), F.lit(16)))
    first = salted.withColumn("__rn", F.row_number().over(W.partitionBy(*stratum, "__salt").orderBy("__h", tie))).where(F.col("__rn") <= k)
    last = first.withColumn("__rn", F.row_number().over(W.partitionBy(*stratum).orderBy("__h", tie))).where(F.col("__rn") <= k)
    return last.drop("__h", "__salt", "__rn")


def ratio_per_group(df: DataFrame, group: list[str], is_positive: Column, ratio: float, h: Column, tie: str) -> DataFrame:
    """All positives, and round(ratio * positives) of the others of each group, in the order of the hash."""
    counted = df.withColumn("__pos", is_positive).withColumn("__h", h)
    n_pos = counted.groupBy(*group).agg(F.count_if("__pos").alias("__n"))
    w = W.partitionBy(*group, "__pos").orderBy("__h", tie)
    ranked = counted.withColumn("__rn", F.row_number().over(w)).join(n_pos, group)
    return ranked.where(F.col("__pos") | (F.col("__rn") <= F.round(F.col("__n") * F.lit(ratio)))).drop("__pos", "__h", "__rn", "__n")


def round_robin(df: DataFrame, group: str, h: Column, n: int, tie: str) -> DataFrame:
    """The first n rows when groups take turns, each in the order of its hash; groups in the order of their names."""
    ranked = df.withColumn("__rn", F.row_number().over(W.partitionBy(group).orderBy(h, tie)))
    return ranked.orderBy("__rn", group).limit(n).drop("__rn")
