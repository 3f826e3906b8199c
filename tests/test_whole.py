"""Queries on whole texts against plain Python."""

import random
import re
from collections import Counter

from vakya.functions import cuts as K
from vakya.functions import spans as P
from vakya.plans.registry import QUERIES

SF = "/root/testdata/sf0.01"


def all_spans(words, gold):
    n, m = len(gold), len(words)
    if not n or not m:
        return 0.0
    least, most = min(m, (n + 1) // 2), max(1, n + n // 2)
    f1 = lambda s: 2 * sum((Counter(s) & Counter(gold)).values()) / (len(s) + n)
    return max((f1(words[i:j]) for i in range(m) for j in range(i + least, min(m, i + most) + 1)), default=0.0)


def test_best_span_equals_all_spans():
    rng = random.Random(1)
    for _ in range(1500):
        words, gold = rng.choices("abcdefg", k=rng.randrange(0, 25)), rng.choices("abcx", k=rng.randrange(0, 9))
        f1, a, b = P.best_span(words, gold)
        assert abs(f1 - all_spans(words, gold)) < 1e-12
        if f1:
            assert abs(f1 - 2 * sum((Counter(words[a:b]) & Counter(gold)).values()) / (b - a + len(gold))) < 1e-12


def test_passages_are_found_in_whole_documents(spark):
    words = lambda t: [w for w in re.sub("[^a-z0-9]+", " ", (t or "").lower()).split(" ") if w]
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    grams = lambda w: {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    of_item = {k: grams(w) for k, w in items.items()}
    want = {(d, i): P.best_span(w, items[i]) for d, w in docs.items() for g in [grams(w)] for i in items if g & of_item[i]}
    rows = QUERIES["tx_passage_spans"](spark, SF).collect()
    assert {(r.doc_id, r.item_id): (r.f1, r.start, r.stop) for r in rows} == {k: (round(f, 6), a, b) for k, (f, a, b) in want.items()} and len(rows) > 3


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_chunks_of_whole_texts(spark):
    sf = "/root/testdata/sf0.001"
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    noisy = {(r.conv_id, r.turn): r.noisy for r in QUERIES["tx_noise_protected"](spark, sf).collect()}
    got = {(r.conv_id, r.turn): r for r in QUERIES["ma_chunk_report"](spark, sf).collect()}
    assert set(got) == set(texts)
    for k in sorted(texts)[:25]:
        a, b = texts[k].split(), noisy[k].split()
        cuts = K.best_cuts(a, K.Limits())[0]
        other = K.parallel_cuts(a, b, cuts)[0]
        chunks = [(a[x:y], b[u:v]) for x, y, u, v in zip([0, *cuts], [*cuts, len(a)], [0, *other], [*other, len(b)], strict=True)]
        letters = [("".join(x).lower(), "".join(y).lower()) for x, y in chunks]
        assert got[k].chunks == len(chunks)
        assert got[k].cer == round(sum(edits(x, y) for x, y in letters) / sum(len(x) for x, _ in letters), 6)
        assert got[k].wer == round(sum(edits(x, y) for x, y in chunks) / len(a), 6)
    assert sum(r.wer > 0 for r in got.values()) > len(got) / 2


def test_chunk_report_pairs_texts_within_their_rows(spark):
    """A text stands beside its noisy form without a join; the distance without equal ends is that of all words."""
    from vakya.functions import distance as D

    assert "Join" not in QUERIES["ma_chunk_report"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    rng = random.Random(4)
    for _ in range(1500):
        a, b = rng.choices("abcd", k=rng.randrange(12)), rng.choices("abcd", k=rng.randrange(12))
        assert D.edit_distance(a, b) == D.edit_counts(a, b)[0]
