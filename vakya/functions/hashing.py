"""Deterministic pseudo-random values from keys: the same on any partitioning, in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNIT = float(1 << 48)


def h01(*parts: Column) -> Column:
    """A number in [0, 1) from the first 12 hex digits of the SHA-256 of the parts joined by ``|``."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(key, 256), 1, 12), 16, 10).cast("bigint") / F.lit(UNIT)


def seed_of(*parts: Column) -> Column:
    """An integer from the first 8 hex digits of the MD5 of the parts joined by ``|``."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def band(h: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """The label of the first limit that ``h`` is below, else ``last``."""
    found = F.lit(last)
    for below, label in reversed(limits):
        found = F.when(h < below, F.lit(label)).otherwise(found)
    return found


def bucket(h: Column, n: int) -> Column:
    """A choice from 0 to n - 1."""
    return F.floor(h * n).cast("int")


def weighted(h: Column, weights: list[tuple[str, float]]) -> Column:
    """A weighted choice by cumulative thresholds."""
    total = sum(w for _, w in weights)
    limits, upto = [], 0.0
    for label, w in weights[:-1]:
        upto += w / total
        limits.append((upto, label))
    return band(h, limits, weights[-1][0])


def jitter(h: Column, least: float, width: float) -> Column:
    return F.lit(least) + F.lit(width) * h
