"""Values by kind, sources of numbers and resolved calls, on hand cases and against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from vakya.functions import text as X
from vakya.functions import values as V
from vakya.operators.calls import resolve_calls
from vakya.operators.provenance import MIXED, NUMBER, number_sources

ECHOES = [
    ("phone", "+1 (743) 555-3824", "so 1 743 555 3824 it is", True),
    ("phone", "+1 (743) 555-3824", "so 743 555 3825", False),
    ("id", "AB 1234", "it is ab1234, yes", True),
    ("id", "AB 1234", "it is ab124", False),
    ("mail", "a.green7@mail5.example.com", "green7 at mail5 dot example", True),
    ("mail", "a.green7@mail5.example.com", "green7 at mail6 dot example", False),
    ("text", "the green house by river 12", "green house 12 by the river", True),
    ("text", "the green house by river 12", "green house by the river", False),
    ("text", "green green blue", "green", True),
    ("text", None, "green", False),
    ("text", "green", None, False),
]
SAME = [
    ("reference", "12", "12", True),
    ("reference", "12", "012", False),
    ("phone", "+1 (743) 555-3824", "7435553824", True),
    ("phone", "555-3824", "5553824", False),
    ("mail", "A@b.org", "a at b dot org", True),
    ("text", "left green door", "the green door", True),
    ("text", "left green door", "a red house", False),
    ("id", "AB-12", "ab 12", True),
    ("id", "AB-12", " ", False),
    ("id", None, "x", False),
    ("text", "", "", False),
]
ADDRESSES = [("12 Elm Road", "Rome", "12 Elm Road", "new"), ("the same address", "Rome", "Rome", "registered"), ("Registered", None, None, "ask"), (None, "Rome", "Rome", "registered"), (" ", " ", None, "ask"), ("old town", None, "old town", "new")]


def test_echoed_and_same(spark):
    df = spark.createDataFrame(ECHOES, "kind string, value string, line string, want boolean")
    assert df.where(V.echoed(F.col("kind"), F.col("value"), F.col("line")) != F.col("want")).collect() == []
    df = spark.createDataFrame(SAME, "kind string, gold string, said string, want boolean")
    assert df.where(V.same(F.col("kind"), F.col("gold"), F.col("said")) != F.col("want")).collect() == []
    df = spark.createDataFrame(ADDRESSES, "said string, known string, value string, rule string")
    got = df.select("value", "rule", V.address(F.col("said"), F.col("known")).alias("a")).collect()
    assert all((r.a.value, r.a.rule) == (r.value, r.rule) for r in got)


def known_numbers(rows):
    out = []
    for doc, line, gives, text in rows:
        if gives or not text:
            continue
        given = set()
        for d, at, g, x in rows:
            if d == doc and g and at < line and x:
                for m in re.findall(NUMBER, x):
                    given |= {re.sub("[^0-9]", "", m), *re.split("[ :.,/-]", m)}
                given |= {re.sub("[^0-9]", "", m) for m in re.findall(MIXED, x)}
        for m in re.findall(NUMBER, text):
            d = re.sub("[^0-9]", "", m)
            known = d in given or d in ("1", "2") or all(p in given for p in re.split("[ :.,/-]", m)) or any(4 <= len(n) <= 24 and d in n for n in given)
            out.append((doc, line, m, known))
    return sorted(out)


def test_number_sources(spark):
    rng = random.Random(3)
    pieces = ["12", "345", "98765432", "12:30", "AB77c", "9876 5432", "and", "1", "2024-05-06", "5" * 30, "x", "6"]
    rows = [(d, i, rng.random() < 0.5, " ".join(rng.choices(pieces, k=rng.randint(0, 5)))) for d in range(12) for i in range(6)]
    rows += [(99, 0, True, None), (99, 1, False, None), (99, 2, False, ""), (99, 3, False, "7 7")]
    df = spark.createDataFrame(rows, "doc int, line int, gives boolean, text string").withColumn("number", F.lit("clash"))
    got = sorted(tuple(r) for r in number_sources(df).select("doc", "line", "number", "known").collect())
    assert got == known_numbers(rows)
    assert {k for *_, k in got} == {True, False}
    assert number_sources(df.limit(0)).count() == 0


def test_resolve_calls(spark):
    spec = [("cancel", "order", "reference"), ("cancel", "phone", "phone"), ("move", "order", "reference"), ("move", "address", "address"), ("move", "mail", "mail")]
    calls = [
        (1, "a", "cancel", {"order": "number 17", "phone": "+1 (743) 555-3824", "colour": "red"}),
        (2, "a", "move", {"order": "the latest", "address": "same", "mail": "x at y dot org"}),
        (3, "b", "move", None),
        (4, "b", "sing", {"order": "17"}),
        (5, "c", "cancel", {"order": "17", "phone": "555"}),
        (6, None, None, {}),
        (7, "b", "move", {"mail": "no mail"}),
    ]
    df = spark.createDataFrame(calls, "call int, owner string, tool string, args map<string,string>").withColumn("value", F.lit("clash"))
    entities = spark.createDataFrame([("a", 17, "blue lamp", 1), ("a", 23, "red lamp", 2), ("a", 23, "red lamp", 2), ("b", 5, "chair", 1)], "owner string, entity int, name string, at int")
    homes = spark.createDataFrame([("a", "Rome"), ("a", "Rome"), ("b", None)], "owner string, address string")
    got = {r.call: r for r in resolve_calls(df, spec, entities, homes).collect()}
    assert got.keys() == {1, 2, 3, 4, 5, 6, 7}
    assert got[1]["values"] == {"order": "17", "phone": "7435553824"} and got[1].dropped == ["colour"] and got[1].reasons == []
    assert got[2]["values"] == {"address": "Rome", "mail": "x@y.org", "order": "23"} and got[2].rules == {"address": "registered", "mail": "said", "order": "role"}
    assert got[3]["values"] == {"address": None, "mail": None, "order": "5"} and got[3].reasons == ["address:ask", "mail:missing"] and got[3].rules["order"] == "only"
    assert got[4].reasons == ["unknown tool"] and got[4]["values"] is None and got[4].dropped == []
    assert got[5].reasons == ["order:ask", "phone:digits 3"]
    assert got[6].reasons == ["unknown tool"]
    assert got[7].reasons == ["address:ask", "mail:malformed"]
    assert resolve_calls(df.limit(0), spec, entities, homes).count() == 0


def test_runs_of_sorted_values(spark):
    rows = [(["a", "a", "b"], 2, 2), (["a", "b", "b", "b"], 3, 2), (["a"], 1, 1), ([], 0, 0), (["a", "b", "c"], 1, 3)]
    got = spark.createDataFrame(rows, "v array<string>, most int, different int").select("most", "different", X.runs("v").alias("r")).collect()
    assert all((r.r.most, r.r.different) == (r.most, r.different) for r in got)


def test_letters_said_one_by_one_are_joined(spark):
    cases = {"E C 0 4, please": "ec04 please", "a bc d e": "a bc de", "": "", "x": "x", "ab cd": "ab cd", "1 2 34 5 6": "12 34 56"}
    rows = spark.createDataFrame(list(cases.items()), "x string, want string").select("want", X.spelled_joined(F.col("x")).alias("got")).collect()
    assert all(r.got == r.want for r in rows)


def test_alike(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice("a b c d a a e@f".split()) for _ in range(rng.randint(0, 8)))
    rows = [(text(), text()) for _ in range(300)] + [("", ""), ("A, b", "b a"), (None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "x string, y string").select("x", "y", V.alike(F.col("x"), F.col("y")).alias("v")).collect()
    for r in got:
        if r.x is None or r.y is None:
            assert not r.v
            continue
        a, b = Counter(re.findall("[a-z0-9@]+", r.x.lower())), Counter(re.findall("[a-z0-9@]+", r.y.lower()))
        assert r.v == (not a and not b or 2 * (a & b).total() / (a.total() + b.total()) >= 0.6), r
