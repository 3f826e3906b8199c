"""Queries without SQL against plain Python on the smallest tables."""

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest

from vakya.functions import distance
from vakya.plans import registry

SF = "/root/testdata/sf0.001"
FOLD = str.maketrans("áàâäéèêëíïîóöôúüûñçÁÀÂÄÉÈÊËÍÏÎÓÖÔÚÜÛÑÇ", "aaaaeeeeiiiooouuuncAAAAEEEEIIIOOOUUUNC")


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def tokens(x):
    return [t for t in re.split("[^a-z0-9@]+", x.lower()) if t]


@pytest.fixture(scope="module")
def turns(spark):
    found = defaultdict(dict)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        found[r.conv_id][r.turn] = r
    return found


def beside(turns):
    for conv, rows in turns.items():
        order = sorted(rows)
        for a, b in zip(order, order[1:], strict=False):
            yield conv, b, rows[a], rows[b]


def plain_edits(hyp, ref):
    best = [[0] * (len(hyp) + 1) for _ in range(len(ref) + 1)]
    for i in range(len(ref) + 1):
        for j in range(len(hyp) + 1):
            best[i][j] = max(i, j) if not i or not j else min(best[i - 1][j - 1] + (ref[i - 1] != hyp[j - 1]), best[i - 1][j] + 1, best[i][j - 1] + 1)
    return best[-1][-1]


def fold(x):
    return re.sub("[^\x00-\x7f]", "", x.translate(FOLD))


def test_edits(spark, turns):
    got = {(r.conv_id, r.turn): r for r in run(spark, "ma_word_edits")}
    shares = defaultdict(Counter)
    for conv, turn, before, now in beside(turns):
        hyp, ref = tokens(fold(before.text)), tokens(fold(now.text))
        r = got.pop((conv, turn))
        if len(hyp) * len(ref) < 3000:
            assert r.distance == plain_edits(hyp, ref)
        assert r.substituted + r.deleted + r.inserted == r.distance and r.deleted - r.inserted == len(ref) - len(hyp)
        shares[now.role].update(s=r.substituted, d=r.deleted, i=r.inserted)
    assert not got
    for r in run(spark, "ag_edit_shares"):
        c = shares[r.role]
        assert (r.s, r.d, r.i) == (c["s"], c["d"], c["i"]) and abs(r.s_share - c["s"] / sum(c.values())) < 1e-6
    wer = {r.part: r for r in run(spark, "ma_corpus_wer")}
    assert wer["all"].edits == sum(sum(c.values()) for c in shares.values()) == wer["even"].edits + wer["odd"].edits


def test_edit_counts_of_small_lists():
    for hyp in ("", "a", "ab", "ba", "abc", "cab"):
        for ref in ("", "a", "b", "ab", "abcd", "bca"):
            d, s, deleted, inserted = distance.edit_counts(list(hyp), list(ref))
            assert d == plain_edits(hyp, ref) == s + deleted + inserted and deleted - inserted == len(ref) - len(hyp)


def test_matching_ratio(spark):
    parts = {(r.p_brand, r.p_type, r.p_name) for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    want = {}
    for brand, kind, name in parts:
        for b, k, other in parts:
            if (b, k) == (brand, kind) and name < other and set(name.split(" ")) & set(other.split(" ")):
                ratio = round(SequenceMatcher(None, name, other).ratio(), 6)
                if ratio >= 0.5:
                    want[name, other] = ratio
    assert {(r.p_name, r.other): r.ratio for r in run(spark, "ma_matching_ratio")} == want


def test_fact_spelled(spark, turns):
    got = {(r.conv_id, r.turn): (r.fact, r.spelled) for r in run(spark, "tx_fact_spelled")}
    for conv, turn, before, now in beside(turns):
        fact, w = "".join(tokens(before.text)[:2]), tokens(now.text)
        if fact:
            spans = any("".join(w[i:j]) == fact for i in range(len(w)) for j in range(i + 1, min(len(w), i + 15) + 1))
            assert got.pop((conv, turn)) == (fact, spans)
    assert not got


def test_spans_of_any_length(spark):
    from vakya.functions import text as X
    from pyspark.sql import functions as F

    rows = [(list("abcdefghijklmnopqrst"), "cdefghijklmnopqrs"), (["ab", "c", "abd"], "abcabd"), (["ab", "c"], "bc"), ([], "a"), (["a"], ""), (["aa", "a", "ab"], "aab"), (["a", "a", "b"], "ab")]
    df = spark.createDataFrame(rows, "t array<string>, fact string").select(X.spells(F.col("t"), F.col("fact")).alias("x"))
    assert [r.x for r in df.collect()] == [True, True, False, False, False, True, True]


def test_romanised(spark):
    """The query's function on text that has Devanagari, by the two ways of writing that this library has."""
    from pyspark.sql import functions as F

    from vakya.functions import script as SC

    words = ["kamal", "dil", "mota", "suno", "pani", "gol"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", SC.in_devanagari(F.col("w")).alias("deva"))
    rows = df.select("w", "deva", SC.in_latin(F.col("deva")).alias("back"), SC.romanise(F.col("deva"), "full").alias("full")).collect()
    assert all(r.back == r.w for r in rows)
    assert {r.w: r.full for r in rows}["dil"] == "dil"


def squeezed(x):
    return re.sub("(.)\\1+", "\\1", x)


def test_skeletons(spark):
    rows = run(spark, "tx_skeletons")
    assert rows
    for r in rows:
        low = re.sub("[^a-z]", "", r.word)
        assert r.skeleton == squeezed(low[:1] + re.sub("[aeiouyhw]", "", low[1:]))
        plain = re.sub("([b-df-gj-np-tv-z])h+", "\\1", r.word)
        assert r.sound == squeezed("".join({"q": "k", "z": "j", "w": "v"}.get(c, c) for c in plain if c not in "yaeiou"))


def test_smoother(spark):
    levels = defaultdict(float)
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda r: (r.user_id, r.ts, r.event_id)):
        key = r.user_id, r.ts.date()
        levels[key] += (r.value - levels[key]) * (0.5 if r.value > levels[key] else 0.1)
    got = {(r.user_id, r.day.date()): r.level for r in run(spark, "wn_smoother")}
    assert set(got) == set(levels) and all(abs(got[k] - v) < 1e-5 for k, v in levels.items())


def test_timeline(spark, turns):
    got = {(r.conv_id, r.turn): r.start for r in run(spark, "wn_timeline_overlap")}
    for conv, rows in turns.items():
        end = 0.0
        for turn in sorted(rows):
            size = len(rows[turn].text)
            start = max(0.0, end - 5) if size < 40 else end + 2
            end = max(end, start + size)
            assert got.pop((conv, turn)) == start
    assert not got
