"""Aggregations in levels, percentiles of several definitions, and rank correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Bins of values whose ranks are counted apart.
RANK_BINS = 4096


def two_level(df: DataFrame, group: list[str], inner: list[str], value: str) -> DataFrame:
    """Mean and population deviation over the inner groups' means, with the number of inner groups."""
    means = df.groupBy(*group, *inner).agg(F.avg(value).alias("m"))
    return means.groupBy(*group).agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_pop("m"), 6).alias("std"), F.count("m").alias("n"))


def linear(value: str, q: float) -> Column:
    """Percentile with linear interpolation."""
    return F.expr(f"percentile({value}, {q}d)")


def at_indexes(df: DataFrame, group: list[str], value: str, indexes: dict[str, Column]) -> DataFrame:
    """For each group the values at indexes (from 0, of the column ``n``, the number of values) of the ordered values.

    Distinct values are counted first, so no group is held as a whole; a value is taken where the running count passes
    the index.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__k"))
    ordered = W.partitionBy(*group)
    upto = F.sum("__k").over(ordered.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = counts.withColumn("__upto", upto).withColumn("n", F.sum("__k").over(ordered))
    return ranked.groupBy(*group).agg(*[F.min(F.when(F.col("__upto") > i, F.col(value))).alias(name) for name, i in indexes.items()])


def percentiles(df: DataFrame, group: list[str], value: str, points: dict[str, float], breadth: float, weight: str | None = None) -> DataFrame:
    """(group, ``n``, ``nulls``, points): exact percentiles with linear interpolation, for few groups of very many values.

    Values are counted in bins of ``breadth`` first. Only what lies in the bins of the wanted ranks is then ordered,
    distinct values counted, so no task holds the values of a group. ``df`` is read twice. ``n`` counts values and
    ``nulls`` rows without one; ``weight``, a whole number above 0, makes a row count more than once.
    """
    times = F.sum(weight) if weight else F.count(F.lit(1))
    binned = df.withColumn("__bin", F.rint(F.col(value) / F.lit(breadth)))
    bins = binned.groupBy(*group, "__bin").agg(times.alias("__k"))
    every = W.partitionBy(*group)
    known = F.when(F.col("__bin").isNotNull(), F.col("__k")).otherwise(0)
    upto = F.sum(known).over(every.orderBy("__bin").rowsBetween(W.unboundedPreceding, 0))
    ranked = bins.select(*group, "__bin", upto.alias("__upto"), (upto - known).alias("__before"), F.sum(known).over(every).alias("n"), (F.sum("__k").over(every) - F.sum(known).over(every)).alias("nulls"))
    places = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in points.items()}
    ends = [end for place in places.values() for end in (F.floor(place), F.ceil(place))]
    wanted = ranked.where(F.exists(F.array(*ends), lambda i: (i >= F.col("__before")) & (i < F.col("__upto"))))
    wanted = wanted.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__bin").alias("__at"), "__before", "n")  # two rows a point and group at most

    def same(names: list[str]) -> Column:
        on = F.lit(True)
        for g in names:
            on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
        return on

    counts = binned.join(F.broadcast(wanted), same(group) & (F.col("__bin") == F.col("__at"))).groupBy(*group, "__bin", "__before", "n", value).agg(times.alias("__k"))
    within = F.sum("__k").over(W.partitionBy(*group, "__bin").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    found = counts.withColumn("__upto", F.col("__before") + within)
    taken = lambda i: F.min(F.when(F.col("__upto") > i, F.col(value)))
    sides = found.groupBy(*group, "n").agg(*[taken(end(place)).alias(f"__{name}_{side}") for name, place in places.items() for side, end in (("low", F.floor), ("high", F.ceil))])

    def between(name: str, place: Column) -> Column:
        low, high = F.col(f"__{name}_low"), F.col(f"__{name}_high")
        return F.when(low == high, low).otherwise(low * (F.ceil(place) - place) + high * (place - F.floor(place)))

    placed = sides.select(*[F.col(g).alias(f"__{g}") for g in group], *[between(name, place).alias(name) for name, place in places.items()])
    totals = ranked.groupBy(*group).agg(F.max("n").alias("n"), F.max("nulls").alias("nulls"))
    return totals.join(placed, same(group), "left").select(*group, "n", "nulls", *points)


def truncated_rank(q: float) -> Column:
    return F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(q)))


def half_up_rank(q: float) -> Column:
    return F.floor((F.col("n") - 1) * F.lit(q) + 0.5)


def lower_rank(q: float) -> Column:
    return F.floor((F.col("n") - 1) * F.lit(q))


def share(k: Column, n: Column) -> Column:
    """{k, n, pct}: per cent with one digit, null of none."""
    return F.struct(k.alias("k"), n.alias("n"), F.round(F.try_divide(k * 100.0, n), 1).alias("pct"))


def tie_averaged_ranks(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ranks of values, ties by their mean.

    Distinct values are counted first. Their running count is taken within bins of equal breadth, and over the bins, so
    no task orders all values.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    low, high = counts.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
    low, breadth = low or 0.0, ((high or 0.0) - (low or 0.0)) / RANK_BINS
    bin_ = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(breadth or 1.0)), F.lit(RANK_BINS)).cast("int")
    binned = counts.withColumn("__bin", bin_)
    bins = binned.groupBy("__bin").agg(F.sum("__n").alias("__in_bin"))  # at most RANK_BINS + 1 rows
    starts = bins.select("__bin", F.coalesce(F.sum("__in_bin").over(W.orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    within = F.coalesce(F.sum("__n").over(W.partitionBy("__bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    upto = binned.withColumn("__within", within).join(F.broadcast(starts), "__bin").withColumn("__before", F.col("__start") + F.col("__within"))
    return df.join(upto.select(value, (F.col("__before") + (F.col("__n") + 1) / 2).alias(out)), value)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Tie-averaged rank correlation; null if either side has one value only."""
    ranked = tie_averaged_ranks(tie_averaged_ranks(df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "__rx"), y, "__ry")
    varied = (F.stddev_pop("__rx") > 0) & (F.stddev_pop("__ry") > 0)
    top, bottom = F.covar_pop("__rx", "__ry"), F.stddev_pop("__rx") * F.stddev_pop("__ry")
    return ranked.agg(F.when(varied, F.round(F.try_divide(top, bottom), 6)).alias("rho"), F.count(F.lit(1)).alias("n"))
