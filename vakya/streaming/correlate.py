"""Joins of two streams by an id and a bound of time; the same functions work on batches.

Both sides have watermarks, so a row waits only as long as an answer may still come, and what waits is bounded by the
bound of time and the delays. Besides the id, rows meet by bins of the bound's length: a row of the left side lies in
one bin, one of the right side in two, so that an id with very many rows is spread over many tasks and a row meets only
what may be in reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import percentiles


def _seconds(bound: str) -> int:
    n, unit = bound.split()
    return int(n) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def answered(asked: DataFrame, answers: DataFrame, keys: list[str], ts: str, bound: str, late: str, answer: str = "back", carried: tuple[str, ...] = ()) -> DataFrame:
    """All rows of ``asked`` with each of their answers: rows of ``answers`` with the same keys that come at the same time or within ``bound``.

    Rows that nothing answers in time are lost: they come once, without an answer, when the watermarks have passed what
    they could wait for. Columns: those of ``asked``, ``answer`` (the time of the answer or null), ``lag_s``, and those
    of ``answers`` that are ``carried``. Rows with a null key or time are never answered; in a stream they are not given out if they have no time.
    """
    seconds = _seconds(bound)
    bin_of = lambda c: F.floor(F.unix_seconds(c) / seconds)
    stamp = lambda df: F.col(ts).cast("timestamp")
    left = asked.withColumn(ts, stamp(asked)).withWatermark(ts, late).withColumn("__bin", bin_of(F.col(ts)))
    right = answers.select(*[F.col(k).alias(f"__{k}") for k in keys], *carried, stamp(answers).alias(answer)).withWatermark(answer, late)
    right = right.select("*", F.explode(F.array(bin_of(F.col(answer)), bin_of(F.col(answer)) - 1)).alias("__near"))
    same = [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__bin") == F.col("__near")]
    reach = F.col(answer).between(F.col(ts), F.col(ts) + F.expr(f"interval {bound}"))
    on = reach
    for c in same:
        on = c & on
    joined = left.join(right, on, "left")
    lag = (F.unix_micros(answer) - F.unix_micros(ts)) / F.lit(1000000.0)
    return joined.select(*asked.columns, answer, lag.alias("lag_s"), *carried)


def lag_report(pairs: DataFrame, ts: str, period: str, weight: str | None = None) -> DataFrame:
    """Answered and lost rows of each period with the percentiles of their lags; in streams, windows close by the watermark that the pairs carry.

    In batches no lag is kept: they are counted by seconds, and only those of the seconds in question are ordered; a
    row may stand for as many pairs as ``weight`` says.
    """
    points = {"p50": 0.5, "p95": 0.95}
    window = F.window(ts, period)
    if pairs.isStreaming:
        p = [F.round(F.expr(f"percentile(lag_s, {q}d)"), 6).alias(name) for name, q in points.items()]
        return pairs.groupBy(window).agg(F.count("lag_s").alias("answered"), F.count_if(F.col("lag_s").isNull()).alias("lost"), *p).select(F.col("window.start").alias("start"), "answered", "lost", *points)
    rows = pairs.select(window.alias("w"), "lag_s", *([weight] if weight else [])).withColumn("start", F.col("w.start")).drop("w")
    found = percentiles(rows, ["start"], "lag_s", points, 1.0, weight)
    return found.select("start", F.col("n").alias("answered"), F.col("nulls").alias("lost"), *[F.round(name, 6).alias(name) for name in points])
