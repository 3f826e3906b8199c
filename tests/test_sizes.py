"""Steps that must grow no faster than their input, on made tables."""

import random
from collections import Counter, defaultdict
from datetime import date

import duckdb
import numpy as np
import pytest

from vakya.operators import aggregates as A
from vakya.operators import resolve as R
from vakya.plans import aggregates, more, records, registry, script, streams, values, whole
from vakya.plans import mentions as mentions_of
from vakya.streaming import correlate as C


class Made:
    """Tables given by name."""

    def __init__(self, **tables):
        self.__dict__.update(tables)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_percentiles_of_large_groups(spark):
    rng = random.Random(5)
    rows = [(g, None if rng.random() < 0.1 else round(rng.expovariate(0.3) - 2, 3), rng.randint(1, 3)) for g in ("a", None) for _ in range(700)] + [("one", 4.25, 1), ("none", None, 2)]
    df = spark.createDataFrame(rows, "g string, v double, times long")
    points = {"low": 0.0, "mid": 0.5, "most": 0.95, "top": 1.0}
    for weight in (None, "times"):
        got = {r.g: r for r in A.percentiles(df, ["g"], "v", points, 0.5, weight).collect()}
        assert set(got) == {"a", None, "one", "none"} and got["none"].n == 0 and got["none"].mid is None and got["none"].nulls == (2 if weight else 1)
        for g in ("a", None, "one"):
            values = [v for h, v, k in rows if h == g and v is not None for _ in range(k if weight else 1)]
            assert got[g].n == len(values) and got[g].nulls == sum(k if weight else 1 for h, v, k in rows if h == g and v is None)
            for name, q in points.items():
                assert got[g][name] == pytest.approx(np.percentile(values, 100 * q))


def test_lag_report_keeps_no_lags(spark):
    rows = [(i, "2024-01-01 00:00:00", kind, '{"k": 1}') for i, kind in enumerate(["click"] * 3 + ["view"] * 4)] + [(8, "2024-01-01 01:00:00", "view", '{"k": 1}'), (9, "2024-01-02 23:00:00", "click", '{"k": 1}')]
    events = spark.createDataFrame([(i, i, ts, kind, props) for i, ts, kind, props in rows], "event_id long, user_id long, ts string, event_type string, props string").selectExpr("event_id", "user_id", "cast(ts as timestamp_ntz) as ts", "event_type", "props")
    report = streams.answer_report(Made(events=events))
    assert "percentile(" not in plan(report)
    got = sorted((r.start.day, r.answered, r.lost, r.p50, r.p95) for r in report.collect())
    assert got == [(1, 15, 0, 0.0, 3600.0), (2, 0, 1, None, None)]
    pairs = C.answered(*streams.sides(Made(events=events), "click", "view"), ["k"], "ts", "6 hours", "1 hour")
    assert "percentile(" not in plan(C.lag_report(pairs, "ts", "1 day"))


def overlaps(parts):
    words = {k: (b, Counter(x.lower().split())) for k, b, x in parts}
    want = set()
    for k, (b, w) in words.items():
        scores = defaultdict(list)
        for o, (c, v) in words.items():
            if o != k and b == c and (n := sum(w[x] * v[x] for x in w)):
                scores[n].append(o)
        if scores and len(scores[max(scores)]) == 1:
            want.add((k, scores[max(scores)][0], max(scores)))
    return want


def test_unique_overlap(spark):
    rng = random.Random(3)
    named = lambda parts: Made(part=spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string"))
    parts = [(i, f"B{rng.randint(1, 12)}", " ".join(rng.choice("red blue old ring bolt".split()) for _ in range(rng.randint(1, 3)))) for i in range(90)]
    want = overlaps(parts)
    assert len(want) > 5 and {tuple(r) for r in more.unique_overlap(named(parts)).collect()} == want
    # 40,000 copies are one class; all their pairs would be 1.6 billion.
    copies = [(i, "B1", "old ring") for i in range(40000)] + [(-1, "B1", "old bolt ring ring"), (-2, "B1", "cold plate"), (-3, "B1", "plate")]
    assert {tuple(r) for r in more.unique_overlap(named(copies)).collect()} == {(i, -1, 3) for i in range(40000)} | {(-2, -3, 1), (-3, -2, 1)}


def test_unique_overlap_of_names_that_all_differ(spark):
    rng = random.Random(9)
    named = lambda parts: Made(part=spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string"))
    # Names within and beyond the number of words for which sets are made, with repeats and copies.
    some = "red blue old ring bolt hot cold rod gear new".split()
    parts = [(i, f"B{rng.randint(1, 6)}", " ".join(rng.choice(some) for _ in range(rng.choice((1, 2, 3, 9, 18))))) for i in range(80)]
    want = overlaps(parts)
    assert len(want) > 5 and {tuple(r) for r in more.unique_overlap(named(parts)).collect()} == want
    # 20,000 names of one brand that share a word: all their pairs would be 400 million.
    parts = [(i, "B1", f"old x{i // 2} y{i}") for i in range(20000)]
    assert {tuple(r) for r in more.unique_overlap(named(parts)).collect()} == {(i, i ^ 1, 2) for i in range(20000)}


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_latency_legs_hold_no_group(spark):
    rows = [(i, "FO"[i % 2], float(i % 7), 1000.0 * (i % 11)) for i in range(101)]
    orders = spark.createDataFrame([r[:2] for r in rows], "o_orderkey long, o_orderstatus string")
    lines = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows], "l_orderkey long, l_quantity double, l_extendedprice double")
    found = aggregates.latency_legs(Made(orders=orders, lineitem=lines))
    assert "percentile(" not in plan(found)
    for r in found.collect():
        a, b = (np.array([x[i] for x in rows if x[1] == r.o_orderstatus]) for i in (2, 3))
        assert (r.first_leg, r.second_leg) == (np.median(a), np.median(b / 1000)) and r.residual == pytest.approx(np.median(a + b / 1000) - np.median(a) - np.median(b / 1000))


def turns(spark, texts):
    return Made(conversations=spark.createDataFrame([(i, 0, "user", x) for i, x in enumerate(texts)], "conv_id long, turn long, role string, text string"))


def test_map_stays_in_its_row(spark):
    found = script.map_verified(turns(spark, ["a b\nc\té😀", "", None, " "]))
    assert shuffles(found) == 0
    assert [tuple(r) for r in found.collect()] == [(0, 0, True, 8, 2), (3, 0, True, 1, 1)]


def test_two_nearest_stay_in_their_row(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("die der x y z w the of".split()) for _ in range(rng.randint(1, 14))) for _ in range(60)] + ["", None, "the", "word"]
    found = records.two_nearest_labelled(turns(spark, texts))
    assert shuffles(found) == 0
    want = set()
    for i, text in enumerate(texts):
        w = (text or "").split()
        votes = [(j, 1 if x in ("die", "der") else -1) for j, x in enumerate(w) if x in ("die", "der", "the", "of")]
        free = [sum([v for k, v in votes if k < j][-2:] + [v for k, v in votes if k > j][:2]) for j, x in enumerate(w) if j not in dict(votes)]
        if free:
            want.add((i, 0, sum(v > 0 for v in free), sum(v < 0 for v in free)))
    assert {tuple(r) for r in found.collect()} == want


def test_resolve_reads_its_sides_once(spark):
    entities = spark.createDataFrame([(1, 5, "red ring", 1), (1, 6, "old bolt", 2), (2, 7, "red ring", 1)], "owner long, entity long, name string, at long")
    mentions = spark.createDataFrame([("a", 1, "the bolt"), ("b", 1, "my latest order"), ("c", 2, None)], "mention string, owner long, text string")
    found = R.resolve(mentions, entities)
    assert "LogicalRDD" not in plan(found)  # what they are made from is not made again for each rule
    assert {tuple(r) for r in found.collect()} == {("a", "words", 6), ("b", "role", 6), ("c", "only", 7)}


def test_gate_rounds_as_sql(spark):
    # A number whose digits end in a half at the seventh place, but which is less than that in millionths.
    v = next(x for x in ((20000000 + 10 * k + 5) / 1e7 for k in range(10000)) if (x * 1e6) % 1 < 0.5)
    frames = spark.createDataFrame([(1, i, f"2024-01-01 00:00:0{i}", v) for i in range(5)], "user_id long, event_id long, ts string, value double").selectExpr("user_id", "event_id", "cast(ts as timestamp_ntz) as ts", "value")
    last = {r.event_id: r for r in streams.gate_frames(Made(events=frames)).collect()}[4]
    assert last.noise == duckdb.sql(f"select round({v!r}::double, 6)").fetchall()[0][0]


def test_gate_frames_equal_sql(spark):
    rng = random.Random(6)
    # Values of five digits, whose noise differs in its last bit unless it is rounded once; then frames without level, time or user, and infinity (DuckDB fails on NaN).
    odd = [None, None, float("inf"), float("-inf"), 1e305, -5.0, 0.0]
    rows = [(i % 40, i, f"2024-01-01 00:{i // 60 % 60:02}:{i % 60:02}", round(rng.random() * 150, 5)) for i in range(1600)]
    rows += [(100 + i % 20 if rng.random() < 0.98 else None, i, f"2024-01-01 00:00:{i % 60:02}" if rng.random() < 0.95 else None, rng.choice(odd) if rng.random() < 0.4 else rng.random() * 150) for i in range(1600, 3200)]
    rows += [(200, i, "2024-01-01 00:00:00", None) for i in range(3200, 3225)]
    frames = spark.createDataFrame(rows, "user_id long, event_id long, ts string, value double").selectExpr("user_id", "event_id", "cast(ts as timestamp_ntz) as ts", "value")
    con = duckdb.connect()
    con.execute("create table events (user_id bigint, event_id bigint, ts timestamp, value double)")
    con.executemany("insert into events values (?, ?, ?, ?)", rows)
    want = con.execute(registry.ORACLE_SQL["str_gate_frames"]).fetchall()
    key = lambda r: tuple(map(repr, (r[0], *(x + 0.0 if isinstance(x, float) else x for x in r[1:3]), r[3])))
    assert sorted(map(key, streams.gate_frames(Made(events=frames)).collect())) == sorted(map(key, want))


def test_only_texts_of_pairs_are_split_again(spark):
    gold = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, "a b " + gold + " c"), (2, "w0 w1 w2 w3 w4 w5 w6 x"), (3, None), (4, gold), (5, "w1")], "doc_id long, text string")
    items = spark.createDataFrame([(7, gold), (8, "short")], "item_id long, text string")
    found = whole.passage_spans(Made(documents=docs, benchmark=items))
    assert "Generate" not in plan(found)
    assert {tuple(r) for r in found.collect()} == {(1, 7, 1.0, 2, 14), (4, 7, 1.0, 0, 12)}


def test_lines_stay_in_their_text(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc"), (2, None), (3, ""), (4, "x")], "doc_id long, text string")
    found = values.lines(Made(documents=docs))
    assert shuffles(found) == 0
    assert [tuple(r) for r in found.collect()] == [(1, 0, "a", "b"), (1, 1, "b", ""), (1, 2, "", "c"), (1, 3, "c", None), (3, 0, "", None), (4, 0, "x", None)]


def test_mentions_broadcast_nothing(spark):
    entities = spark.createDataFrame([(1, 51234, "red ring", 1), (1, 61234, "old bolt", 2)], "owner long, entity long, name string, at long")
    mentions = spark.createDataFrame([("a", 1, "the bolt"), ("b", 1, "order 51235"), ("c", 1, "the one ending in 234")], "mention string, owner long, text string")
    found = R.resolve(mentions, entities)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("a", "words", 61234), ("b", "misheard", 51234), ("c", "ask", None)}
    made = Made(
        orders=spark.createDataFrame([(9, 1, 5)], "o_orderkey long, o_custkey long, o_orderdate long"), part=spark.createDataFrame([(4, "red ring")], "p_partkey long, p_name string"), lineitem=spark.createDataFrame([(9, 4, 1)], "l_orderkey long, l_partkey long, l_linenumber int")
    )
    assert "Broadcast" not in mentions_of.owned_orders(made)._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in mentions_of.mentions(made).collect()] == [(9, "id", 9)]  # cancel order 00000009


def test_large_owners_broadcast_nothing(spark, monkeypatch):
    monkeypatch.setattr(R, "LARGE", 0)
    entities = spark.createDataFrame([(1, 51234, "red ring", 1), (1, 61234, "old bolt", 2)], "owner long, entity long, name string, at long")
    mentions = spark.createDataFrame([("a", 1, "the bolt"), ("b", 1, "order 51235"), ("c", None, "order 51234")], "mention string, owner long, text string")
    found = R.resolve(mentions, entities)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in found.collect()} == {("a", "words", 61234), ("b", "misheard", 51234), ("c", "ask", None)}


def test_call_arguments_compare_a_letter_once(spark):
    rng, some = random.Random(7), "red blue cold ring bolt the a of".split()
    words = lambda n: " ".join(rng.choice(some) for _ in range(rng.randint(0, n)))
    texts = [f"{words(9)}{rng.choice(['. ', chr(10), ' ', '! '])}{rng.choice(['', '(123) 456-7890 ', '+91 (555) 123-4567 '])}{words(4)} {rng.choice(['', 'a.b@site.com '])}{words(3)}{rng.choice(['', ' (999) 111-2222 x@y.org'])}" for _ in range(30)]
    texts += ["", " ", "my home. x", "no end " * 500]
    kinds = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    tables = {
        "documents": ("doc_id bigint, text string", list(enumerate(texts))),
        "nation": ("n_nationkey int, n_name string", [(0, "PERU"), (1, "CHINA")]),
        "customer": ("c_custkey bigint, c_nationkey int, c_acctbal double", [(i, i % 3, float(i % 4)) for i in range(50)]),
        "part": ("p_partkey bigint, p_name string", [(i, f"{rng.choice(some)} {rng.choice(some)}") for i in range(20)]),
        "orders": ("o_orderkey bigint, o_custkey bigint, o_orderdate date, o_orderpriority string", [(1000 + 7 * i, rng.choice([*range(50), None]), date(2024, 1, rng.randint(1, 28)), rng.choice(kinds)) for i in range(400)]),
        "lineitem": ("l_orderkey bigint, l_partkey bigint, l_linenumber int", [(1000 + 7 * i, rng.randint(0, 21), n) for i in range(400) for n in range(rng.randint(1, 3))]),
    }
    con, made = duckdb.connect(), {}
    for name, (columns, rows) in tables.items():
        con.execute(f"create table {name} ({columns})")
        con.executemany(f"insert into {name} values ({', '.join('?' * len(rows[0]))})", rows)
        made[name] = spark.createDataFrame(rows, columns)
    found = values.call_arguments(Made(spark=spark, **made))
    assert plan(found).count("Join ") <= 3  # homes, nations and counts of calls to letters; none by call
    want = con.execute(registry.ORACLE_SQL["ma_call_arguments"]).fetchall()
    assert {tuple(r) for r in found.collect()} == set(want) and len(want) == 7
    assert {tuple(map(str, r)) for r in mentions_of.mentions(Made(spark=spark, **made)).collect()} == {tuple(map(str, r)) for r in con.execute(registry.ORACLE_SQL["er_mentions"]).fetchall()}
