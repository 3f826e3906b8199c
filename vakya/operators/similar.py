"""Similarity join by the matching ratio (twice the matched characters over all characters), with exact candidates.

If a share t of S characters is matched (S of both texts), at most (1 - t) * S are not, so the match has at most
(1 - t) * S + 1 blocks, and a block of k characters has k - 1 pairs of neighbours. Two texts with a ratio of at least t
thus share (1.5 * t - 1) * S - 1 pairs of neighbouring characters or more, repeats counted. This bound makes a prefix
filter exact: of the pairs of a text, in one order for both sides, only the first need be looked at. Where one shared pair
isn't enough to keep the groups small, two or three shared pairs make up a key. Texts so short that the bound says
nothing are joined on single characters in the same way. Equal texts are one text.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import written

#: Most rows that may share a key before keys of one token more are taken.
CROWD = 2000
LEVELS = (1, 2, 3)


def shared_pairs(total: Column, percent: int) -> Column:
    """Least number of shared pairs of neighbours of two texts with so many characters together; in whole numbers, never too high."""
    return F.ceil((total * (3 * percent - 200) - 200) / 200)


def least_partner(n: Column, percent: int) -> Column:
    """Length of the shortest text that can reach the ratio with one of n characters."""
    return F.ceil(n * percent / (200 - percent))


def ratio_from(percent: int):  # noqa: ANN201
    """A vectorised function: the matching ratio where it reaches the share, else null; a bound by counts of characters spares most of the work."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        found = []
        for x, y in zip(a, b, strict=True):
            m = SequenceMatcher(None, x, y)
            r = m.ratio() if m.quick_ratio() * 100 >= percent else 0.0
            found.append(r if r >= percent / 100 else None)
        return pd.Series(found, dtype="float64")

    return ratio


def _runs(texts: DataFrame, size: int) -> DataFrame:
    """(text, n, token): all runs of ``size`` characters, the k-th equal one of a text as a token of its own."""
    at = F.explode(F.sequence(F.lit(1), F.col("n") - size + 1))
    grams = texts.where(F.col("n") >= size).select("text", "n", at.alias("i")).select("text", "n", F.substring("text", F.col("i"), F.lit(size)).alias("gram"))
    counted = grams.groupBy("text", "n", "gram").count()
    return counted.select("text", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("count").cast("int")), lambda k: F.concat(F.col("gram"), k.cast("string")))).alias("token"))


def _placed(sides: list[DataFrame], size: int) -> list[DataFrame]:
    """For each side the tokens that the last side has, with their ``place`` (from 1) in one order for both: from the rarest of the last side, tokens that it doesn't have being the first."""
    found = [_runs(s, size) for s in sides]
    rare = found[-1].groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    per = W.partitionBy("text", "n")
    place = F.col("n") - size + 1 - F.count(F.lit(1)).over(per) + F.row_number().over(per.orderBy("df", "token"))
    return [t.join(rare, "token").withColumn("place", place).select("text", "n", "token", "place") for t in found]


def _tokens(texts: DataFrame, size: int) -> DataFrame:
    """(text, n, token, place) of texts among themselves."""
    return _placed([texts], size)[0]


def _keys(tokens: DataFrame, least: Column, size: int, level: int) -> DataFrame:
    """(text, n, key): for a text that shares ``least`` tokens or more with its partners, all sets of ``level`` of its first tokens, one of which both texts have."""
    tokens = tokens.withColumn("least", F.greatest(least, F.lit(1)))
    prefix = tokens.where(F.col("place") <= F.col("n") - size + 1 - F.col("least") + level)
    if level == 1:
        return prefix.select("text", "n", "least", F.col("token").alias("key"))
    lists = prefix.groupBy("text", "n", "least").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]).alias("t"))
    chosen = F.transform(F.col("t"), lambda x: F.array(x))
    for _ in range(level - 1):  # sets in the order of the list
        chosen = F.flatten(F.transform(chosen, lambda part: F.transform(F.filter(F.col("t"), lambda x: F.array_position(F.col("t"), x) > F.array_position(F.col("t"), F.element_at(part, -1))), lambda x: F.array_append(part, x))))
    return lists.select("text", "n", "least", F.explode(F.transform(chosen, lambda part: F.array_join(F.array_sort(part), "\x01"))).alias("key"))


def _level(tokens: list[DataFrame], least: Column, size: int) -> int:
    """The first level at which no key is shared by a crowd; the last one if all are."""
    for level in LEVELS[:-1]:
        shared = [_keys(t, least, size, level).where(F.col("least") >= level).select("key") for t in tokens]
        every = shared[0] if len(shared) == 1 else shared[0].unionByName(shared[1])
        if (every.groupBy("key").count().agg(F.max("count")).first()[0] or 0) <= CROWD:
            return level
    return LEVELS[-1]


def candidates(texts: DataFrame, others: DataFrame | None, percent: int) -> DataFrame:
    """(text, other): distinct pairs of distinct texts, all that can reach the ratio among them; without ``others`` of the texts themselves, the lesser first."""
    if percent < 70:
        raise ValueError("below 70 percent the bound says nothing")
    prepare = lambda df: df.where(F.length("text") > 0).select("text", F.length("text").alias("n")).distinct()
    # Texts and tokens are stored, as the level is found by counts of keys before the pairs are.
    sides = [written(prepare(s)) for s in ([texts] if others is None else [texts, others])]
    small = 300 // (3 * percent - 200) + 1  # two texts of so many characters together needn't share a pair
    found = []
    # Short texts: shared characters, of which there are percent * S / 200 at least.
    short = _placed([s.where(F.col("n") < small) for s in sides], 1)
    found.append(_paired([_keys(t, F.ceil((F.col("n") + least_partner(F.col("n"), percent)) * percent / 200), 1, 1) for t in short], F.col("n") + F.col("m") <= small))
    tokens = [written(t) for t in _placed(sides, 2)]
    least = shared_pairs(F.col("n") + least_partner(F.col("n"), percent), percent)
    level = _level(tokens, least, 2)
    for k in range(1, level + 1):
        # A pair is looked for at the level that its lesser bound allows.
        keys = [_keys(t, least, 2, k).where(F.col("least") >= k) for t in tokens]
        found.append(_paired(keys, F.least(F.lit(level), "least", "other_least") == k))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    n, m = F.length("text"), F.length("other")
    return pairs.distinct().where(F.least(n, m) * 200 >= (n + m) * percent)


def _paired(keys: list[DataFrame], met: Column) -> DataFrame:
    right = keys[-1].select(F.col("text").alias("other"), F.col("n").alias("m"), F.col("least").alias("other_least"), "key")
    pairs = keys[0].join(right, "key").where(met)
    return (pairs.where("text < other") if len(keys) == 1 else pairs.where("text <> other")).select("text", "other")


def similar_texts(texts: DataFrame, others: DataFrame | None = None, percent: int = 85) -> DataFrame:
    """(text, other, ratio) of all distinct pairs with a matching ratio of ``percent`` or more.

    Both sides have a column ``text``; null and empty texts are like nothing, equal texts count once and aren't paired
    with themselves. The ratio is that of (text, other) in this order.
    """
    return candidates(texts, others, percent).withColumn("ratio", ratio_from(percent)("text", "other")).where("ratio is not null")
