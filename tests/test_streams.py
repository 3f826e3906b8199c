"""Streams give what batches give: events come in several files, one micro-batch each."""

import pytest
from pyspark.sql import functions as F

from vakya.streaming import operators as O

EVENTS = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("events") / "parts")
    rows = spark.read.parquet(EVENTS)
    for i in range(4):  # in the order of time
        rows.where(F.floor((F.col("event_id") - 1) / 250) == i).coalesce(1).write.mode("append").parquet(path)
    return path


def streamed(spark, folder, f, mode, name):
    schema = spark.read.parquet(EVENTS).schema
    out = f(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder))
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(300)
    return spark.table(name)


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.mark.parametrize(
    ("name", "mode", "f"),
    [
        ("metrics", "complete", lambda df: O.windowed_metrics(df, "ts", "value", "6 hours", "1 day")),
        ("sessions", "complete", lambda df: O.sessions(df, "user_id", "ts", "2 hours", "1 day")),
        ("expired", "complete", lambda df: O.expired(df, "user_id", "ts", "2 hours", "1 day")),
        ("quota", "complete", lambda df: O.daily_quota(df, "user_id", "ts", 4, "1 day")),
        ("stages", "complete", lambda df: O.stage_latency(df, "user_id", "ts", "event_type", ["view", "click", "purchase"])),
        ("latest", "complete", lambda df: O.latest_of_each(df, "user_id", "ts", "event_id", "event_type", "value", ["view", "click"])),
    ],
)
def test_stream_equals_batch(spark, folder, name, mode, f):
    assert rows(streamed(spark, folder, f, mode, name)) == rows(f(spark.read.parquet(folder)))


def test_repeats_in_a_stream(spark, folder):
    got = streamed(spark, folder, lambda df: O.first_of_each(df, ["user_id", "event_type"], "ts", "400 days"), "append", "firsts")
    want = spark.read.parquet(folder).select("user_id", "event_type").distinct()
    assert rows(got.select("user_id", "event_type")) == rows(want)


def test_ring_in_a_stream(spark, folder):
    got = {r.event_id: r.held for r in streamed(spark, folder, lambda df: O.ring_counts(df, "user_id", "ts", "event_id", 86400.0), "append", "ring").collect()}
    by, want = {}, {}
    for r in sorted(spark.read.parquet(folder).collect(), key=lambda r: (r.ts, r.event_id)):
        held = by.setdefault(r.user_id, [])
        held.append(r.ts)
        want[r.event_id] = sum((r.ts - x).total_seconds() <= 86400.0 for x in held)
    assert got == want


def test_folds_in_a_stream(spark, folder):
    for name, stream, batch in (
        ("bounced", lambda df: O.debounce_stream(df, "user_id", "ts", "event_id", 3600.0), lambda df: O.debounce_batch(df, "user_id", "ts", "event_id", 3600.0)),
        ("limited", lambda df: O.rate_limit_stream(df, "user_id", "ts", "event_id", 2, 86400.0), lambda df: O.rate_limit_batch(df, "user_id", "ts", "event_id", 2, 86400.0)),
    ):
        assert rows(streamed(spark, folder, stream, "append", name)) == rows(batch(spark.read.parquet(folder)))
