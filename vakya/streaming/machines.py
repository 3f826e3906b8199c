"""State machines over the events of a key: one plain class, run over batches and over streams with timers.

A machine has its state in ``self.s`` (a dict that JSON can hold), takes events in the order of their time, and may ask
to be woken at a time of its own (``due``), whether a row comes or not. Batches run it over sorted rows, key by key, a
row at a time. Streams keep the state and the rows that the watermark hasn't passed yet in Spark's state store and use
its timers: rows are taken in the order of event time once the watermark passes them, so late and unordered arrival
within the watermark changes nothing, and a batch over the same rows gives the same output. A key's state goes when the
machine is idle. State can be seeded from a table (``snapshot``), such as one read from another query's checkpoint.

Times are whole microseconds. A timer that is due when an event comes fires before the event.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

SECOND = 1_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine:
    """What a machine has to say; this one says nothing."""

    def __init__(self) -> None:
        self.s: dict = {}

    def on(self, at: int, row: tuple) -> Iterable[tuple]:
        """Rows to give out for an event."""
        return ()

    def due(self) -> int | None:
        """When to be woken, if no event comes before."""
        return None

    def wake(self, at: int) -> Iterable[tuple]:
        """Rows to give out at the time that was due; ``due`` must be later afterwards, or None."""
        return ()

    def idle(self) -> bool:
        """Whether the state of the key may go."""
        return False


Make = Callable[[], Machine]


def woken(machine: Machine, until: int | None) -> Iterator[tuple]:
    """Fires the timers up to a time; None: all that are ever due."""
    while (due := machine.due()) is not None and (until is None or due <= until):
        yield from machine.wake(due)


def advanced(machine: Machine, pending: list[list], until: int) -> Iterator[tuple]:
    """Takes the pending rows [at, tie, *values], which are sorted, and the timers up to a time out of the list."""
    n = 0
    for at, _, *row in pending:
        if at > until:
            break
        yield from woken(machine, at)
        yield from machine.on(at, tuple(row))
        n += 1
    del pending[:n]
    yield from woken(machine, until)


def _schema(spark: SparkSession, df: DataFrame, key: str, fields: str) -> StructType:
    return StructType.fromDDL(f"`{key}` {dict(df.dtypes)[key]}, {fields}")


def _timed(df: DataFrame, key: str, ts: str, tie: str, columns: list[str]) -> DataFrame:
    stamp = F.col(ts).cast("timestamp")
    return df.select(F.col(key), stamp.alias("__ts"), F.unix_micros(stamp).alias("__at"), F.col(tie).alias("__tie"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])


def fold_batch(df: DataFrame, key: str, ts: str, tie: str, columns: list[str], make: Make, fields: str, timeless: bool = False) -> DataFrame:
    """(key, fields) that the machines give out over all rows of a table; rows without a time are left out, or last if ``timeless``.

    Rows stream through one machine a key, so a large key needs no memory; the null key is one of its own. At the end
    of a key its timers fire.
    """
    schema = _schema(df.sparkSession, df, key, fields)
    arrow = to_arrow_schema(schema)
    timed = _timed(df, key, ts, tie, columns).drop("__ts")
    timed = timed.withColumn("__at", F.coalesce("__at", F.lit(2**63 - 1))) if timeless else timed.where("__at is not null")
    ordered = timed.repartition(key).sortWithinPartitions(key, "__at", F.col("__tie").asc_nulls_last())

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, machine = None, None
        for batch in batches:
            for k, at, _, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if machine is None or k != now:
                    if machine is not None:
                        yield from ((now, *r) for r in woken(machine, None))
                    now, machine = k, make()
                yield from ((k, *r) for r in woken(machine, at))
                yield from ((k, *r) for r in machine.on(at, tuple(row)))
        if machine is not None:
            yield from ((now, *r) for r in woken(machine, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for row in outputs(batches):
            rows.append(row)
            if len(rows) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return ordered.mapInArrow(run, schema)


class _Processor(StatefulProcessor):
    """Keeps (machine, pending rows, timer) of a key; one timer at a time, for whatever comes first."""

    def __init__(self, make: Make, names: list[str], event_time: bool) -> None:
        self.make, self.names, self.event_time = make, names, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "machine string, pending string, timer long")

    def load(self) -> tuple[Machine, list[list], int | None]:
        machine = self.make()
        if not self.kept.exists():
            return machine, [], None
        state, pending, timer = self.kept.get()
        machine.s = json.loads(state)
        return machine, json.loads(pending), None if timer < 0 else timer

    def store(self, machine: Machine, pending: list[list], timer: int | None) -> None:
        """Saves the state with a timer for the next thing that is due, or removes it."""
        times = [x for x in (machine.due(), pending[0][0] if pending else None) if x is not None]
        wanted = -(-min(times) // 1000) if times else None
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is not None and timer != wanted:
            self.handle.registerTimer(wanted)
        if machine.idle() and not pending and wanted is None:
            self.kept.clear()
        else:
            self.kept.update((json.dumps(machine.s), json.dumps(pending), -1 if wanted is None else wanted))

    def clock(self, values) -> int:
        return 1000 * (values.getCurrentWatermarkInMs() if self.event_time else values.getCurrentProcessingTimeInMs())

    def moved(self, key: tuple, machine: Machine, pending: list[list], timer: int | None, until: int) -> Iterator[pd.DataFrame]:
        pending.sort(key=lambda r: r[:2])
        rows = [(*key, *r) for r in advanced(machine, pending, until)]
        self.store(machine, pending, timer)
        if rows:
            yield pd.DataFrame(rows, columns=self.names)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        machine, pending, timer = self.load()
        until = self.clock(timerValues)
        for frame in rows:
            for row in frame.iloc[:, 2:].itertuples(index=False):  # after the key and the time
                at, tie, *values = (None if x != x else x.item() if hasattr(x, "item") else x for x in row)
                if not self.event_time:
                    at = until
                if at > until or not self.event_time:
                    pending.append([int(at), tie, *values])
        yield from self.moved(key, machine, pending, timer, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        machine, pending, timer = self.load()
        if timer == expiredTimerInfo.getExpiryTimeInMs():
            timer = None  # Spark removes it
        yield from self.moved(key, machine, pending, timer, self.clock(timerValues))

    def handleInitialState(self, key, initialState, timerValues) -> None:  # noqa: N802
        machine, _, timer = self.load()
        machine.s = json.loads(initialState["machine"].iloc[0])
        self.store(machine, json.loads(initialState["pending"].iloc[0]), timer)

    def close(self) -> None:
        pass


def use_rocks(spark: SparkSession) -> None:
    """Timers need Spark's RocksDB state store; set unless the session names another one than the default."""
    if "HDFSBackedStateStoreProvider" in spark.conf.get(STORE):
        spark.conf.set(STORE, ROCKS)


def fold_stream(df: DataFrame, key: str, ts: str, tie: str, columns: list[str], make: Make, fields: str, late: str, mode: str = "append", snapshot: DataFrame | None = None) -> DataFrame:
    """The same over a stream, by event time: rows up to ``late`` behind the latest count, later ones don't. ``snapshot`` has (key, machine, pending), as ``saved_state`` gives it."""
    use_rocks(df.sparkSession)
    schema = _schema(df.sparkSession, df, key, fields)
    timed = _timed(df, key, ts, tie, columns).withWatermark("__ts", late)
    processor = _Processor(make, schema.names, True)
    seed = snapshot.select(key, "machine", "pending").groupBy(key) if snapshot is not None else None
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, mode, "EventTime", initialState=seed)


def fold_stream_now(df: DataFrame, key: str, ts: str, tie: str, columns: list[str], make: Make, fields: str, mode: str = "append") -> DataFrame:
    """The same by the clock of the machine that runs it: rows count when they come, timers fire at processing time."""
    use_rocks(df.sparkSession)
    schema = _schema(df.sparkSession, df, key, fields)
    return _timed(df, key, ts, tie, columns).groupBy(key).transformWithStateInPandas(_Processor(make, schema.names, False), schema, mode, "ProcessingTime")


def saved_state(spark: SparkSession, checkpoint: str, key: str) -> DataFrame:
    """(key, machine, pending) of the keys that a stopped query has left in its checkpoint."""
    use_rocks(spark)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "kept").load()
    return state.select(F.col(f"key.{key}").alias(key), "value.machine", "value.pending")
