"""Functions without SQL, against hand-made cases and brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vakya.functions import distance, numbers, script
from vakya.streaming import operators


@pytest.mark.parametrize(
    ("said", "written"),
    [
        ("twenty five rupees", "25 rupees"),
        ("two lakh fifty thousand", "250000"),
        ("one hundred and five", "105"),
        ("dhai hazaar", "2500"),
        ("nine eight double seven", "9877"),
        ("do sau pachas", "250"),
        ("do teen din", "do teen din"),
        ("no numbers and words", "no numbers and words"),
        ("", ""),
    ],
)
def test_spoken_numbers(said, written):
    assert numbers.to_digits(said) == written
    assert numbers.to_digits(written) == written  # nothing left to convert


def test_numbers_in_text():
    assert numbers.numbers_in("Rs 1,25,000 for A12 on 5 or 9 8 7 6 5") == ["125000", "12", "5", "98765"]


def test_romanise(spark):
    rows = [
        ("नमस्ते", "namaste", "namaste", "namaste"), ("कमल", "kamal", "kamal", "kamal"), ("ज़रा", "zaraa", "zara", "zaraa"), ("abc", "abc", "abc", "abc"), ("१२ घर।", "12 ghar.", "12 ghar.", "12 ghar."), ("न", "na", "na", "na"),
        ("बिलकुल", "bilakul", "bilakul", "bilkul"), ("समझना", "samajhanaa", "samajhana", "samajhnaa"), ("कमरा", "kamaraa", "kamara", "kamraa"), ("लड़की", "larakee", "laraki", "larkee"), ("सड़क पर चलना", "sarak par chalanaa", "sarak par chalana", "sarak par chalnaa"),
        ("संपर्क", "sanpark", "sanpark", "sampark"), ("हाँ", "haan", "han", "haan"), ("दुःख", "duhkh", "duhkh", "duhkh"), ("बचपन", "bachapan", "bachapan", "bachpan"), ("अदरक", "adarak", "adarak", "adrak"), ("", "", "", ""), (None, None, None, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "w string").select("w", *[script.romanise(F.col("w"), p).alias(p) for p in ("plain", "short", "spoken")])
    assert [tuple(r) for r in df.collect()] == rows


def spoken(word):
    """Syllables as a list, judged from the last to the first."""
    units = []
    for c in word:
        if c in script.CONSONANTS or c in script.DOTTED:
            units.append([c, "a"])
        elif c in script.SIGNS:
            units[-1][1] = c
        elif c == script.VIRAMA:
            units[-1][1] = ""
        else:
            units.append(["", c])
    for k in range(len(units) - 1, -1, -1):
        consonant, vowel = units[k]
        if not consonant or vowel != "a":
            continue
        others = [u for i, u in enumerate(units) if i != k and u[1]]
        end = k == len(units) - 1 and others
        middle = 0 < k < len(units) - 1 and units[k - 1][1] and units[k + 1][0] and units[k + 1][1]
        if end or middle:
            units[k][1] = ""
    return "".join((script.CONSONANTS | script.DOTTED).get(c, "") + ("a" if v == "a" else (script.SIGNS | script.VOWELS).get(v, "")) for c, v in units)


def test_inherent_vowels_by_units(spark):
    rng = random.Random(4)
    consonants, signs, vowels = list(script.CONSONANTS) + list(script.DOTTED), list(script.SIGNS), list(script.VOWELS)
    words = ["".join(rng.choice(consonants) + rng.choice(["", "", "", rng.choice(signs), script.VIRAMA]) if rng.random() < 0.9 else rng.choice(vowels) for _ in range(rng.randrange(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", script.romanise(F.col("w"), "spoken").alias("s"))
    assert [(r.w, r.s) for r in df.collect()] == [(w, spoken(w)) for w in words]


def test_edit_counts():
    def brute(a, b):
        if not a or not b:
            return len(a) + len(b)
        return min(brute(a[1:], b[1:]) + (a[0] != b[0]), brute(a[1:], b) + 1, brute(a, b[1:]) + 1)

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(6))] for _ in range(2))
        d, s, gone, new = distance.edit_counts(a, b)
        assert d == brute(a, b) == s + gone + new
        assert len(b) - gone + new == len(a)


def test_folds_resume():
    rng = random.Random(4)
    times = sorted(rng.uniform(0, 1000) for _ in range(300))
    whole = operators.Debounce(10)
    want = [whole.step(x) for x in times]
    got, kept = [], []
    for i in range(0, 300, 37):
        part = operators.Debounce.resumed(10, kept)
        got += [part.step(x) for x in times[i : i + 37]]
        kept = part.state()[0]
    assert got == want
    limit = operators.RateLimit(3, 50)
    passed = [x for x in times if limit.step(x)]
    assert all(sum(a - 50 < y <= a for y in passed) <= 3 for a in passed)


def test_batch_equals_stream(spark, tmp_path):
    rows = pd.DataFrame({"k": [i % 3 for i in range(90)], "id": range(90), "ts": pd.to_datetime([1_700_000_000 + 7 * i for i in range(90)], unit="s")})
    schema = "k long, id long, ts timestamp"
    for i in range(3):
        spark.createDataFrame(rows.iloc[30 * i : 30 * i + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for batch, stream in ((operators.debounce_batch, operators.debounce_stream), (operators.rate_limit_batch, operators.rate_limit_stream)):
        args = ("k", "ts", "id", 30.0) if batch is operators.debounce_batch else ("k", "ts", "id", 2, 100.0)
        want = {tuple(r) for r in batch(spark.read.parquet(str(tmp_path / "in")), *args).collect()}
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = batch.__name__
        q = stream(source, *args).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert {tuple(r) for r in spark.table(name).collect()} == want


def test_leaks_in_whole_texts(spark, tmp_path):
    """Runs of an item's later lines, inside a line of a document, and items of less than 13 words."""
    from vakya.plans import registry

    item = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(item[:5]) + "\n" + " ".join(item[5:])), (2, "short item"), (3, None), (4, "  ")]
    texts = ["x " + " ".join(item[10:25]) + " y", "a short\nitem b", "xshort item", " ".join(item[10:22]), None, "", " ".join(item)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["val_leak_passages"](spark, str(tmp_path)).collect()
    assert sorted((r.item_id, r.doc_id, r.found, r.runs) for r in got) == [(1, 0, 3, 18), (1, 6, 18, 18), (2, 1, 1, 1)]
