"""Rules of mentions, one by one."""

import random

from pyspark.sql import functions as F

from vakya.operators import resolve as R

ENTITIES = [(1, 10234, "small red lamp", 3), (1, 10999, "small blue lamp", 1), (1, 55234, "green old desk", 2), (2, 777, "red lamp", 1), (None, 5, "lost", 1), (3, 41234, "big red box", 1), (3, 41235, "big red box", 2), (3, 91234, "tin box of nails for walls", 3)]
CASES = [
    (1, "Small RED lamp!", "exact", 10234), (1, "order 0010999", "id", 10999), (1, "one zero, 1 0 2 3 4", "id", 10234), (1, "ending in 999", "block", 10999), (1, "ending 234", "ask", None), (1, "it is 10998", "misheard", 10999), (1, "the latest", "role", 10234), (1, "my oldest order", "role", 10999),
    (1, "where is the green old desk now", "contains", 55234), (1, "the red one", "words", 10234), (1, "the lamp", "ask", None), (1, "the red or the blue one", "ask", None), (1, "the second", "ordinal", 55234), (1, "the fifth", "ask", None), (1, None, "ask", None), (2, "that thing", "only", 777), (2, "", "only", 777),
    (3, "41236", "ask", None), (3, "big red box", "ask", None), (3, "the one with nails", "words", 91234), (3, "41234", "id", 41234), (None, "lost", "ask", None), (9, "anything", "ask", None), (3, "box of nails for the second wall", "words", 91234), (1, "10234 and 10999", "ask", None),
]


def test_rules(spark):
    mentions = spark.createDataFrame([(i, o, t) for i, (o, t, _, _) in enumerate(CASES)], "mention long, owner long, text string").withColumn("entity", F.lit(0))
    entities = spark.createDataFrame([*ENTITIES, ENTITIES[0]], "owner long, entity long, name string, at long")
    got = {r.mention: (r.rule, r.entity) for r in R.resolve(mentions, entities).collect()}
    assert [got[i] for i in range(len(CASES))] == [(r, e) for _, _, r, e in CASES]


def test_empty(spark):
    none = spark.createDataFrame([], "owner long, entity long, name string, at long")
    assert R.resolve(spark.createDataFrame([(1, 1, "x")], "mention long, owner long, text string"), none).collect()[0].rule == "ask"
    assert R.resolve(spark.createDataFrame([], "mention long, owner long, text string"), none).count() == 0


def test_ways_agree(spark, monkeypatch):
    rng, some = random.Random(4), "red blue old ring bolt lamp box".split()
    name = lambda: None if rng.random() < 0.05 else " ".join(rng.choice(some) for _ in range(rng.randint(0, 5)))
    number = lambda: rng.choice([rng.randint(0, 30), rng.randint(100, 140), rng.randint(51200, 51260), 987651234])
    entities = [(o, number(), name(), rng.choice([1, 2, 3, 4, None])) for o in (*range(60), None) for _ in range(rng.randint(0, 9))]
    text = lambda: " ".join(rng.choice([*some, str(number()), f"00{number()}", "234", "the", "latest", "oldest", "second", "third"]) for _ in range(rng.randint(0, 4)))
    mentions = [(i, rng.choice([*range(62), None]), None if rng.random() < 0.02 else text()) for i in range(1500)]
    m, e = spark.createDataFrame(mentions, "mention long, owner long, text string"), spark.createDataFrame([*entities, *entities[:50]], "owner long, entity long, name string, at long")
    found = lambda: {r.mention: (r.rule, r.entity) for r in R.resolve(m, e).collect()}
    by_owner = found()
    assert len(by_owner) == 1500 and {r for r, _ in by_owner.values()} == {*R.RULES, "ask"}
    for large in (20, 0):  # some owners go by joins, then all
        monkeypatch.setattr(R, "LARGE", large)
        assert found() == by_owner


def test_very_long_numbers(spark):
    e = spark.createDataFrame([(1, 51234, "red ring", 1), (1, 61235, "old bolt", 2)], "owner long, entity long, name string, at long")
    m = spark.createDataFrame([(1, 1, "9" * 5000), (2, 1, "0" * 5000 + "51234"), (3, 1, "7" * 30 + " the bolt")], "mention long, owner long, text string")
    assert {tuple(r) for r in R.resolve(m, e).collect()} == {(1, "ask", None), (2, "id", 51234), (3, "words", 61235)}
