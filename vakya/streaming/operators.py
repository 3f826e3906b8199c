"""Stateful operators over streams, and the same folds over batches.

Each fold is a plain class with a small state: ``step`` takes the time of the next event of a key and says whether it
passes. Batches run it over the ordered events of each key, streams keep its state in Spark's state store.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


class Debounce:
    """Passes an event if so many seconds have gone since the last that passed."""

    def __init__(self, seconds: float, last: float | None = None) -> None:
        self.seconds, self.last = seconds, last

    def step(self, at: float) -> bool:
        if self.last is not None and at - self.last < self.seconds:
            return False
        self.last = at
        return True

    def state(self) -> tuple[list[float]]:
        return ([] if self.last is None else [self.last],)

    @classmethod
    def resumed(cls, seconds: float, kept: list[float]) -> Debounce:
        return cls(seconds, kept[0] if len(kept) else None)


class RateLimit:
    """Passes an event if fewer than k have passed in the last seconds; only those that passed count."""

    def __init__(self, k: int, seconds: float, passed: list[float] | None = None) -> None:
        self.k, self.seconds, self.passed = k, seconds, deque(passed or [])

    def step(self, at: float) -> bool:
        while self.passed and self.passed[0] <= at - self.seconds:
            self.passed.popleft()
        if len(self.passed) >= self.k:
            return False
        self.passed.append(at)
        return True

    def state(self) -> tuple[list[float]]:
        return (list(self.passed),)


def _seconds(ts: str):
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1000000.0)


def _batch(df: DataFrame, key: str, ts: str, tie: str, make) -> DataFrame:
    """Events in the order of time, key by key, through one fold a key: rows stream, so a large key needs no memory."""
    kind, tie_kind = dict(df.dtypes)[key], dict(df.dtypes)[tie]
    ordered = df.select(key, tie, _seconds(ts).alias("__at")).repartition(key).sortWithinPartitions(key, "__at", tie)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, fold = object(), None
        for frame in frames:
            keep = []
            for k, at in zip(frame[key], frame["__at"], strict=True):
                if fold is None or k != now:
                    now, fold = k, make()
                keep.append(fold.step(at))
            yield frame.loc[keep, [key, tie]]

    return ordered.mapInPandas(run, f"`{key}` {kind}, `{tie}` {tie_kind}")


def debounce_batch(df: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """(key, tie) of the events that pass."""
    return _batch(df, key, ts, tie, lambda: Debounce(seconds))


def rate_limit_batch(df: DataFrame, key: str, ts: str, tie: str, k: int, seconds: float) -> DataFrame:
    return _batch(df, key, ts, tie, lambda: RateLimit(k, seconds))


def _stream(df: DataFrame, key: str, ts: str, tie: str, resume) -> DataFrame:
    kind, tie_kind = dict(df.dtypes)[key], dict(df.dtypes)[tie]
    timed = df.select(key, tie, _seconds(ts).alias("at"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = resume(list(state.get[0]) if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["at", tie])
        keep = [fold.step(at) for at in rows["at"]]
        state.update(fold.state())
        yield rows.loc[keep, [key, tie]]

    return timed.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{tie}` {tie_kind}", "kept array<double>", "append", GroupStateTimeout.NoTimeout)


def debounce_stream(df: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """The same over a stream whose micro-batches come in the order of time."""
    return _stream(df, key, ts, tie, lambda kept: Debounce.resumed(seconds, kept))


def rate_limit_stream(df: DataFrame, key: str, ts: str, tie: str, k: int, seconds: float) -> DataFrame:
    return _stream(df, key, ts, tie, lambda kept: RateLimit(k, seconds, kept))


def windowed_metrics(df: DataFrame, ts: str, value: str, period: str, late: str) -> DataFrame:
    """Counts and extremes of tumbling windows of a stream, dropping what is later than ``late``."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, period)).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")).select(F.col("window.start").alias("start"), "n", "least", "most")


def sessions(df: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Session windows of a stream."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def first_of_each(df: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Drops repeats of the keys within the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def daily_quota(df: DataFrame, key: str, ts: str, most: int, late: str) -> DataFrame:
    """Uses of a key by day, and whether they are over the quota; for streams and batches."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    counted = timed.groupBy(key, F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(key, F.col("w.start").alias("day"), "n", (F.col("n") > most).alias("over_quota"))


def stage_latency(df: DataFrame, key: str, ts: str, stage: str, stages: list[str]) -> DataFrame:
    """Seconds from each stage of a key to the next, by their first times; for streams in update or complete mode, and batches."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    first = df.groupBy(key).agg(*[F.min(F.when(F.col(stage) == s, at)).alias(s) for s in stages])
    return first.select(key, *[F.round((F.col(b) - F.col(a)) / F.lit(1000000.0), 3).alias(f"{a}_to_{b}") for a, b in zip(stages, stages[1:], strict=False)])


def latest_of_each(df: DataFrame, key: str, ts: str, tie: str, kind: str, value: str, kinds: list[str]) -> DataFrame:
    """The latest value of each kind of event of a key, and how many events are of no known kind; for streams in update or complete mode, and batches."""
    is_ = lambda k: F.col(kind) == k
    latest = [F.max_by(F.when(is_(k), F.col(value)), F.when(is_(k), F.struct(ts, tie))).alias(f"last_{k}") for k in kinds]
    return df.groupBy(key).agg(*latest, F.count_if(~F.col(kind).isin(*kinds)).alias("unknown"))


def expired(df: DataFrame, key: str, ts: str, idle: str, late: str) -> DataFrame:
    """Sessions of a key with the time at which they expire: their last event and the idle time; for streams and batches."""
    return sessions(df, key, ts, idle, late).select(key, F.col("start"), F.col("stop").alias("expires"), "n")


class Ring:
    """What a buffer of the last seconds holds: the number of events, including this one."""

    def __init__(self, seconds: float, held: list[float] | None = None) -> None:
        self.seconds, self.held = seconds, deque(held or [])

    def step(self, at: float) -> int:
        while self.held and self.held[0] < at - self.seconds:
            self.held.popleft()
        self.held.append(at)
        return len(self.held)

    def state(self) -> tuple[list[float]]:
        return (list(self.held),)


def ring_counts(df: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """(key, tie, held) of a stream: events of the last seconds at each event. The state of a key is bounded by what the time holds."""
    kind, tie_kind = dict(df.dtypes)[key], dict(df.dtypes)[tie]
    timed = df.select(key, tie, _seconds(ts).alias("at"))

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = Ring(seconds, list(state.get[0]) if state.exists else [])
        rows = pd.concat(list(frames)).sort_values(["at", tie])
        rows["held"] = [fold.step(at) for at in rows["at"]]
        state.update(fold.state())
        yield rows[[key, tie, "held"]]

    return timed.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{tie}` {tie_kind}, held long", "kept array<double>", "append", GroupStateTimeout.NoTimeout)
