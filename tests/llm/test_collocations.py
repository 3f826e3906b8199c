"""op12 against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vakya.llm import collocations as C
from vakya.llm import queries

DDL = "doc_id long, lang string, text string"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def plain(rows, support=10, longest=3, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        counts = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                counts.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    found = []
    for lang, counts in f.items():
        scored = []
        for w, a in counts.items():
            if len(w) < 2 or a < support:
                continue
            longer = [b for x, b in counts.items() if b >= support and len(x) > len(w) and any(x[i : i + len(w)] == w for i in range(len(x)))]
            if any(100 * b >= 50 * a for b in longer):
                continue
            score, _, l, r = min((1000000 * a * a // (counts[w[:k]] * counts[w[k:]]), k, counts[w[:k]], counts[w[k:]]) for k in range(1, len(w)))
            scored.append((-score, -a, " ".join(w).encode(), l, r))
        found += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(found)


def got(df):
    return sorted(map(tuple, df.collect()))


def made(rng, n, words):
    vocabulary = [f"{a}{b}" for a in "aäbcß日" for b in "xyzé"][:words]
    return "".join(rng.choice(vocabulary).upper() if rng.random() < 0.1 else rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\x0b", " "]) for _ in range(n))


@pytest.mark.parametrize("shard_bytes", [300, 5000, C.SHARD_BYTES])
def test_shards_don_t_change_the_result(spark, shard_bytes):
    rng = random.Random(4)
    rows = [(k, rng.choice(["en", "de", "und", None]), made(rng, rng.randrange(0, 400), 9)) for k in range(40)] + [(99, "en", None), (100, "xx", ""), (101, "fr", "a b . a b c"), (101, "fr", "a b . a b c")]
    want = plain([r[1:] for r in rows])
    assert len(want) > 50
    assert got(C.collocations(spark.createDataFrame(rows, DDL).withColumn("n", F.lit("x")).repartition(5), shard_bytes=shard_bytes)) == want


def test_buckets_and_longer_phrases(spark, monkeypatch):
    monkeypatch.setattr(C, "BUCKET_HASHES", 64)
    rng = random.Random(5)
    rows = [(k, "en", made(rng, 500, 5)) for k in range(8)]
    for bytes_ in (1000, 6000):
        assert got(C.collocations(spark.createDataFrame(rows, DDL), support=7, longest=4, top=50, shard_bytes=bytes_)) == plain([r[1:] for r in rows], 7, 4, 50)


def test_equal_hashes_only_add_candidates(spark, monkeypatch):
    monkeypatch.setattr(C, "mixed", lambda x: x & np.uint64(0xF00000000000000F))
    rng = random.Random(6)
    rows = [(k, "en", made(rng, 300, 8)) for k in range(8)]
    assert got(C.collocations(spark.createDataFrame(rows, DDL), shard_bytes=3000)) == plain([r[1:] for r in rows])


def test_ties_and_large_counts(spark):
    rows = [(k, "en", "x y. " * 2_000_000 if k == 0 else "b c, a b; c d. " * 12) for k in range(2)]
    want = [("en", 1, "x y", 2_000_000, 2_000_000, 2_000_000, 4_000_072, 1_000_000), ("en", 2, "a b", 12, 12, 24, 4_000_072, 500_000), ("en", 3, "c d", 12, 24, 12, 4_000_072, 500_000), ("en", 4, "b c", 12, 24, 24, 4_000_072, 250_000)]
    assert got(C.collocations(spark.createDataFrame(rows, DDL))) == want


def test_empty_table(spark):
    assert got(C.collocations(spark.createDataFrame([], DDL))) == []


def test_table_equals_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.01/documents.parquet'")
    want = sorted(con.sql(queries.ORACLE_SQL["op12_phrase_collocations"]).fetchall())
    assert got(queries.QUERIES["op12_phrase_collocations"](spark, "/root/testdata/sf0.01")) == want and len(want) > 500


def test_long_texts_are_cut_at_breaks():
    data = b"aa bb. cc dd ee ff gg. hh"
    assert list(C.cut_at_breaks(data, 8)) == [b"aa bb", b". cc dd ee ff gg", b". hh"]
    assert b"".join(C.cut_at_breaks(data * 50, 40)) == data * 50
