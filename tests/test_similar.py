"""The similarity join against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from vakya.operators import similar as S
from vakya.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


def all_pairs(texts, others, percent):
    texts, others = {x for x in texts if x}, None if others is None else {x for x in others if x}
    pairs = ((a, b) for a in texts for b in (texts if others is None else others) if (a < b if others is None else a != b))
    found = {(a, b, SequenceMatcher(None, a, b).ratio()) for a, b in pairs}
    return sorted(x for x in found if x[2] >= percent / 100)


def frame(spark, texts):
    return spark.createDataFrame([(x,) for x in texts], "text string")


def noisy(rng, n):
    found = ["", None]
    base = ["".join(rng.choices("abcdeé ", k=rng.randrange(1, 40))) for _ in range(n // 4)]
    for _ in range(n):
        text = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            if text:
                i = rng.randrange(len(text))
                text[i : i + rng.randrange(0, 3)] = rng.choices("abcx", k=rng.randrange(0, 3))
        found.append("".join(text))
    return found


@pytest.mark.parametrize(("percent", "crowd"), [(70, 2000), (80, 12), (85, 2000), (92, 1)])
def test_equal_to_all_pairs(spark, monkeypatch, percent, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    texts = noisy(random.Random(percent), 120)
    want = all_pairs(texts, None, percent)
    assert sorted(map(tuple, S.similar_texts(frame(spark, texts), percent=percent).collect())) == want and len(want) > 20


@pytest.mark.parametrize("crowd", [2000, 5])
def test_two_tables(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = random.Random(3)
    texts, others = noisy(rng, 60) + list("ab") + ["ab", "abc", "abcd", "ba"], noisy(rng, 60) + ["a", "abx", "abcde", "b"] + noisy(random.Random(3), 30)
    want = all_pairs(texts, others, 80)
    assert sorted(map(tuple, S.similar_texts(frame(spark, texts), frame(spark, others), 80).collect())) == want and len(want) > 10


def test_one_token_that_all_have(spark, monkeypatch):
    """Texts that share a beginning don't meet in one group: keys of more tokens are taken."""
    monkeypatch.setattr(S, "CROWD", 10)
    rng = random.Random(9)
    texts = ["small green " + "".join(rng.choices("abcdefghijklmnopqrstuvw", k=24)) for _ in range(300)]
    texts += [x[:-1] + "z" for x in texts[:40]]
    assert {(a, b) for a, b, _ in map(tuple, S.similar_texts(frame(spark, texts)).collect())} >= {tuple(sorted((x, x[:-1] + "z"))) for x in texts[:40] if x[-1] != "z"}
    tokens = S._tokens(frame(spark, texts).select("text", F.length("text").alias("n")), 2)
    least = S.shared_pairs(F.col("n") + S.least_partner(F.col("n"), 85), 85)
    most = lambda level: S._keys(tokens, least, 2, level).groupBy("key").count().agg(F.max("count")).first()[0]
    assert most(1) < 30 and S._level([tokens], least, 2) > 1 and most(S._level([tokens], least, 2)) < most(1)


def test_both_sides_have_one_order(spark):
    texts, others = ["ringbolt", "xqzwvuk", "ringbold"], ["ringbolts", "oldring"]
    tokens = S._placed([frame(spark, x).select("text", F.length("text").alias("n")) for x in (texts, others)], 2)
    here, there = ([tuple(r) for r in t.select("text", "token", "place").collect()] for t in tokens)
    # What the other side doesn't have comes first and makes no key, and shared tokens have the same order on both sides.
    assert {x for x, _, _ in here} == {"ringbolt", "ringbold"} and max(p for x, _, p in here if x == "ringbold") == 7
    order = lambda rows, text: [k for _, k in sorted((p, k) for x, k, p in rows if x == text)]
    common = set(order(here, "ringbolt"))
    assert order(here, "ringbolt") == [k for k in order(there, "ringbolts") if k in common]


def test_queries_equal_all_pairs(spark):
    rows = lambda name: [tuple(r) for r in QUERIES[name](spark, SF).collect()]
    parts = spark.read.parquet(f"{SF}/part.parquet").collect()
    clean = lambda x, keep: "".join(c for c in x.lower() if c in keep).strip()
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    titles = {clean(f"{r.p_name} {r.p_type}", letters + digits + " ") for r in parts}
    assert sorted(rows("jn_similar_titles")) == sorted((a, b, round(x, 6)) for a, b, x in all_pairs(titles, None, 85))

    alike = {}
    for a, b, _ in all_pairs(titles, None, 85):
        for x, y in ((a, b), (b, a)):
            alike[x] = min(alike.get(x, y), y)
    same = {}
    for r in parts:
        same.setdefault(clean(f"{r.p_name} {r.p_type}", letters + digits + " "), []).append(r.p_partkey)
    want = []
    for r in parts:
        title = clean(f"{r.p_name} {r.p_type}", letters + digits + " ")
        n = len(f"{r.p_name} {r.p_type}".split(" "))
        issues = [x for x in ("length" if not 3 <= n <= 4 else None, "banned" if "bolt" in title or "old" in title else None, "same title" if len(same[title]) > 1 else None, f"close to {alike[title]}" if title in alike else None) if x]
        want.append((r.p_partkey, "; ".join(issues)))
    assert sorted(rows("val_title_review")) == sorted(want)

    import re

    known = {w for r in parts for w in re.findall("[a-z]+", r.p_name.lower())}
    words = {w for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for w in re.findall("[a-z]{3,}", (r.text or "").lower())} - known
    best = {}
    for a, b, x in all_pairs(words, known, 80):
        best[a] = min(best.get(a, (0, "")), (-x, b))
    assert sorted(rows("tx_similar_words")) == sorted((w, b, round(-x, 6)) for w, (x, b) in best.items())

    forms = {clean(re.sub("[0-9]+", "0", f"{r.p_brand} {r.p_name} {r.p_size}"), letters + digits + "' ") for r in parts}
    templates = {clean(f"brand0 {r.p_name} 0", letters + digits + "' ") for r in parts if r.p_partkey % 10 == 0}
    found = {}
    for a in forms:
        for b in templates:
            x = SequenceMatcher(None, a, b).ratio()
            if x >= 0.8:
                found[a] = min(found.get(a, (0, "")), (-x, b))
    assert sorted(rows("ma_nearest_template")) == sorted((a, b, round(-x, 6)) for a, (x, b) in found.items())
