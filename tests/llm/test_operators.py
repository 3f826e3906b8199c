"""The operators on small tables with nulls, empty and repeated rows, ties, clashing names, and no rows at all."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import tiktoken
import xxhash

import public_tokenizers as P
from vakya.llm import bpe, components, html_text, katz, license_scan, line_dedup, media, near_dup, packing, quality, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node string, h string, block string"


def prose(seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


LONG = prose(1, 30_000)
COPY = prose(2)
NEAR = COPY.replace("w", "W", 3) + " tail"
TEXTS = [None, "", "   ", "one", "one two", COPY, COPY, NEAR, "é漢😀 " * 3, LONG, "x\n\ny  z ", prose(3), "a b c d " * 40, "see <|endoftext|> and<|endoftext|>, so\n\nit. goes,\nOn!\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", ["hot", "hot", None, "b"][i % 4], 0, "x", "y", "z", "w") for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5]]  # repeated rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(rows):
    return sorted(r.doc_id for r in rows)


WANT_IDS = sorted([*range(len(TEXTS)), 5, 5])


def test_near_duplicates(docs, none):
    plan = near_dup.Plan(3, 85)
    got = near_dup.near_duplicates(docs, plan).collect()
    assert ids(got) == WANT_IDS
    by = {r.doc_id: r for r in got}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[3].n_shingles == by[4].n_shingles == 1
    assert {i: r.component_id for i, r in by.items() if r.component_id != i} == {6: 5, 7: 5}
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert near_dup.near_duplicates(none, plan).collect() == []
    kept = near_dup.drop_near_duplicates(docs, plan)
    assert kept.columns == docs.columns and ids(kept.collect()) == sorted({*range(len(TEXTS))} - {1, 2, 6, 7})  # of those without words the first stays
    assert near_dup.drop_near_duplicates(none, plan).collect() == []
    odd = docs.sparkSession.createDataFrame([(None, COPY), (None, prose(77)), (None, prose(77)), (3, COPY), (3, COPY), (None, None), (None, " ")], "doc_id long, text string")
    assert all(r.kept is not None for r in near_dup.near_duplicates(odd, plan).collect())
    assert sorted(((r.doc_id, r.text) for r in near_dup.drop_near_duplicates(odd, plan).collect()), key=str)[:2] == sorted([(3, COPY), (None, prose(77))], key=str)
    assert near_dup.drop_near_duplicates(odd, plan).count() == 3  # and one row without words


def test_chain_of_links(spark, monkeypatch):
    """Documents that are linked only through others, in blocks smaller than the group."""
    words = prose(9, 400).split()
    rows = [(i, " ".join(words[6 * i : 6 * i + 200])) for i in range(30)] + [(100 + i, prose(100 + i)) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dup, "BLOCK", 4)
    monkeypatch.setattr(near_dup, "CROWD", 3)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 700)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df, near_dup.Plan(3, 85)).collect()}
    sets = {i: {tuple(x.split()[k : k + 3]) for k in range(len(x.split()) - 2)} for i, x in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert got == {i: find(i) for i in sets}
    assert len(set(got.values())) < 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 70), (5, 5)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 60: 50, 70: 50}
    assert components.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_media(docs, none):
    found = media.sniff_media(media.store_payload(docs), ["doc_id", "n_bytes"]).collect()
    assert ids(found) == WANT_IDS
    for r in found:
        data = (TEXTS[r.doc_id] or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.media_type == "audio/wav" and r.media_bytes == len(payload) + 44
    assert media.sniff_media(media.store_payload(none), ["doc_id"]).collect() == []


def test_quality(docs, none):
    got = quality.quality_report(docs).collect()
    assert ids(got) == WANT_IDS
    by = {r.doc_id: r for r in got}
    assert by[5].kept and by[9].kept and not by[12].kept and by[0].base_failed
    kept = quality.keep_quality(docs)
    assert kept.columns == docs.columns and ids(kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.quality_report(none).collect() == [] and quality.keep_quality(none).collect() == []


def test_packing(docs, none):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)  # with its defaults
    rows = packing.pack(docs, path, window=4096, with_ids=True).collect()
    stream = collections.defaultdict(dict)
    tokens = collections.Counter()
    for r in rows:
        want = [*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(want)
        piece = np.array(want[r.start : r.start + r.length], "<u4").tobytes()
        assert bytes(r.ids) == piece and zlib.crc32(piece) == r.ids_crc32
        assert stream[r.sequence_id].setdefault(r.offset, r.length) == r.length
        tokens[r.doc_id] += r.length
    times = collections.Counter(WANT_IDS)
    assert all(tokens[i] == n * (len(library.encode(TEXTS[i] or "", add_special_tokens=False).ids) + 1) for i, n in times.items())
    for k, found in stream.items():
        at = 0
        for offset in sorted(found):
            assert offset == at
            at += found[offset]
        assert at == 2048 or k == max(stream)
    assert packing.pack(none, path).collect() == []


@pytest.mark.parametrize("most", [packing.QUEUES, 2])
def test_packing_targets(spark, monkeypatch, most):
    """Windows hold the target shares, also where sources without a target share queues."""
    monkeypatch.setattr(packing, "QUEUES", most)
    targets = {"a": 8, "b": 1, "c": 1}
    rows = [(i, prose(i, 60), s) for i, s in enumerate(["a"] * 60 + ["b"] * 20 + ["c"] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(df, P.path("byte_bpe_50k.json"), window=2048, targets=targets).collect()
    first = collections.Counter()
    for r in got:
        if r.sequence_id < 5:
            first[r.sequence_id, r.queue] += r.length
    for k in range(5):
        shares = [first[k, q] / 2048 for q in "abc"]
        assert all(abs(x - y) < 0.002 for x, y in zip(shares, (0.8, 0.1, 0.1), strict=True))
    others = packing.pack(df, P.path("byte_bpe_50k.json"), window=2048, targets={"a": 8})
    assert {r.queue for r in others.select("queue").distinct().collect()} >= {"a"}
    assert others.where("doc_tokens = 0").count() == 0 and others.select("doc_id").distinct().count() == 100


def test_bpe(docs, none):
    ranks = P.path("byte_bpe_multi_50k.tiktoken")
    with open(ranks, "rb") as f:
        library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(f.read()), special_tokens={})
    got = bpe.decode_corpus(bpe.encode_corpus(docs, ranks, P.PATTERN, part_bytes=1000), ranks).collect()
    assert ids(got) == WANT_IDS
    for r in got:
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text) and bytes(r.data) == text.encode()
    assert bpe.encode_corpus(none, ranks, P.PATTERN).collect() == []


def test_html(spark):
    boiler = "<div class=box>Same words on all pages</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{boiler}<div class=story><p>{prose(i, 30)}</p></div></body>") for i in range(20)]
    rows += [(90, None, None), (91, "x", ""), (92, "http://other.example/", f"<body>{boiler}<p>only</p></body>"), (92, "http://other.example/", f"<body>{boiler}<p>only</p></body>")]
    df = spark.createDataFrame([(*r, "t", "l") for r in rows], "page_id long, url string, html string, text string, low string")
    got = html_text.extract_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == prose(i, 30) for i in range(20))  # the branch that repeats on the host is gone
    assert by[90] == by[91] == "" and by[92] == "Same words on all pages\n\nonly"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract_text(df.limit(0)).collect() == []


def test_style_tree_against_brute_force(spark):
    rng = random.Random(4)
    pages = []
    for i in range(60):
        inner = "".join(f"<p>{rng.choice('abcdefgh')}</p>" for _ in range(rng.randrange(1, 4)))
        pages.append((rng.choice("st"), f"<body><div class=n>{rng.choice(['x', 'y', 'z<i>z</i>', 'z<br>z'])}</div><article>{inner} text {i % 40}</article></body>"))
    df = spark.createDataFrame(pages, "host string, html string").selectExpr("xxhash64(host) site", "xxhash64('d') domain", "html", "host")
    sites = {r.site: r.host for r in df.collect()}
    tree = html_text.StyleTree()
    got = {(sites[r.site], r.path): r for r in html_text.style_importance(df, tree).collect()}

    def importances(chosen):
        shapes, content, outside = (collections.defaultdict(set) for _ in range(3))
        for host, x in chosen:
            page = html_text.Page(x)
            mark = page.fingerprint()
            for path, is_content, feature, out in page.features():
                (content if is_content else shapes)[path].add((host, feature, mark))
                if out and not is_content:
                    outside[path].add((host, feature, mark))
        found = {}
        for path, seen in shapes.items():
            m, parts = len(seen), []
            for values in (seen, content[path]):
                k = collections.Counter(f for _, f, _ in values).values()
                parts.append(1 - sum(n * math.log(n) for n in k) / sum(k) / math.log(m) if m > 1 else 1.0)
            found[path] = m, max(0.0, parts[1]), (1 - tree.content_weight) * parts[0] + tree.content_weight * max(0.0, parts[1]), len(outside[path])
        return found

    whole = importances(pages)
    for host in "st":
        for path, (m, content, own, out) in importances([x for x in pages if x[0] == host]).items():
            dm = min(whole[path][0], tree.domain_pages)
            want = (m * own + dm * whole[path][2] + tree.prior_pages * (1 - tree.outside * out / m)) / (m + dm + tree.prior_pages)
            r = got.pop((host, path))
            assert r.n_pages == m and math.isclose(r.content, content, abs_tol=1e-9) and math.isclose(r.importance, want, abs_tol=1e-9)
    assert not got


def test_katz(docs, none, tmp_path):
    got = katz.score_corpus(docs).collect()
    assert ids(got) == WANT_IDS
    texts = [(i, TEXTS[i] or "") for i in WANT_IDS]
    words = lambda x: ["<s>", *x.encode().lower().split(), "</s>"]
    uni, bi, hist = collections.Counter(), collections.Counter(), collections.Counter()
    for i, x in texts:
        if katz.is_train(i):
            w = words(x)
            uni.update(w[1:])
            bi.update(zip(w, w[1:], strict=False))
            hist.update(w[:-1])
    n, size = sum(uni.values()), sum(uni.values()) + len(uni) + 1
    d = katz.discounts([sum(c == r for c in bi.values()) for r in range(1, katz.MOST + 2)])
    kept = lambda c: c - katz.ABOVE if c > katz.MOST else d[c] * c
    p1 = lambda w: (uni[w] + 1) / size
    alpha = {}
    for h in hist:
        seen = [(w, c) for (a, w), c in bi.items() if a == h] if hist[h] > 5 or len(bi) < 5000 else None
        if seen is not None:
            alpha[h] = (1 - sum(kept(c) for _, c in seen) / hist[h]) / (1 - sum(p1(w) for w, _ in seen))
            whole = sum(kept(c) / hist[h] for _, c in seen) + alpha[h] * (1 - sum(p1(w) for w, _ in seen))
            assert math.isclose(whole, 1, rel_tol=1e-9)  # exactly normalised
    for r in got:
        w = words(TEXTS[r.doc_id] or "")
        assert (r.held_out, r.n_tokens, r.train_tokens) == (not katz.is_train(r.doc_id), len(w) - 1, n)
        assert r.n_known == sum(uni[x] > 0 for x in w[1:])
        assert math.isclose(r.base_score, sum(math.log10(p1(x)) for x in w[1:]), rel_tol=1e-9)
        if all(bi[a, b] or a in alpha or not hist[a] for a, b in zip(w, w[1:], strict=False)):
            want = sum(math.log10(kept(bi[a, b]) / hist[a] if bi[a, b] else alpha.get(a, 1) * p1(b)) for a, b in zip(w, w[1:], strict=False))
            assert math.isclose(r.score, want, rel_tol=1e-9)
    stored = katz.count_tables(docs, str(tmp_path / "counts"))
    by_word = collections.Counter()
    for r in stored.collect():
        by_word[r.word & (1 << 64) - 1] += r.n
    names = {xxhash.xxh3_64_intdigest(x): x for x in uni if x != "</s>"} | {int(katz.END): "</s>"}
    assert {names[k]: v for k, v in by_word.items()} == dict(uni) and stored.count() == len(bi)
    assert katz.score_corpus(none).collect() == []
    odd = docs.sparkSession.createDataFrame([(None, "a b"), (-1, "a b"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in katz.score_corpus(odd).collect()) == [(False, -1, 3), (False, 3, 1), (True, 0, 3)]


def test_url_filter(spark):
    bad, good = [(i, f"http://a.example.com/spam/{i}") for i in range(30)], [(100 + i, f"http://a.example.com/news/{i}?q#f") for i in range(30)]
    rows = [*bad, *good, (900, None), (901, "no host"), (902, "HTTP://X.NET/a"), (903, "x://Example.NET/en/1"), (904, "x://b.example.com/de/"), (905, "x://c.org/fr/x"), (906, "x://net"), (907, ""), (0, bad[0][1])]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows], "page_id long, url string, host string, path string")
    labels = spark.createDataFrame([(i, 1) for i, _ in bad[:15]] + [(i, 0) for i, _ in good[:25]] + [(1, None), (1, 1)], "page_id long, bad int")
    got = url_filter.filter_urls(pages, labels).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[5] == ("a.example.com", "/spam/5", None, "block") and by[105] == ("a.example.com", "/news/5", None, "allow")
    assert by[29][3] == "block" and by[129][3] == "allow"  # not labelled themselves
    assert by[900] == by[901] == by[907] == ("", "", None, "allow")
    assert by[902] == ("x.net", "/a", "net/", "block") and by[903][2:] == ("example.net/en/", "allow") and by[904][2:] == ("example.com/de/", "block") and by[905][2:] == ("org/fr/", "allow")
    assert by[906][:3] == ("net", "", None)
    assert url_filter.filter_urls(pages.limit(0), labels.limit(0)).collect() == []


def test_url_tree_of_all_levels(spark):
    """Branches that differ below equal ones are told apart at any depth and width, and long paths keep their tails."""
    rows = [(i, f"x://h.example.com/a/b/{'bad' if i % 2 else 'good'}/word{chr(97 + i % 26)}{chr(97 + i // 26)}/") for i in range(200)]
    rows += [(500, "x://h.example.com/a/b/bad/other"), (501, "x://h.example.com/a/b/good/other"), (502, "x://h.example.com"), (503, "x://h.example.com/" + "p/" * 30)]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(i, i % 2) for i in range(120)], "page_id long, bad int")
    by = {r.page_id: (r.verdict, r.template) for r in url_filter.filter_urls(pages, labels).collect()}
    for i in range(200):
        kind = "bad" if i % 2 else "good"
        assert by[i][0] == ("block" if i % 2 else "allow") and by[i][1].endswith(f"/{kind}/*")
    assert by[500][0] == "block" and by[501][0] == "allow" and by[502] == ("allow", "h.example.com") and by[503][0] == "allow"


def test_line_dedup(docs, none, spark):
    passage = "\n".join(prose(50 + i, 20) for i in range(30))
    rows = [(1, passage), (2, "own line\n" + passage + "\nlast"), (3, None), (4, ""), (5, passage), (5, passage)]
    df = spark.createDataFrame([(*r, "d", 7) for r in rows], "doc_id long, text string, doc string, line int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append(r.text)
    assert by[1] == [passage] and by[3] == [None] and by[4] == [""]
    assert by[5] == ["", ""] or all(len(x) < len(passage) / 2 for x in by[5])
    assert "own line" in by[2][0] and "last" in by[2][0] and len(by[2][0]) < len(passage) / 2
    report = line_dedup.dedup_lines(docs, report=True).collect()
    assert ids(report) == WANT_IDS
    assert line_dedup.dedup_lines(none).collect() == []


def test_line_dedup_of_short_lines(spark):
    """Repeated passages of 51 to 70 words go whole, whatever their lines, and nothing else goes."""
    rng, rows, want = random.Random(8), [], {}
    line = lambda n: " ".join(str(rng.randrange(10**8)) for _ in range(n))
    for k in range(40):
        size, words = rng.randrange(51, 71), []
        while sum(words) < size:
            words.append(rng.randrange(7, 36))
        shared = [line(n) for n in words]
        for i in (2 * k, 2 * k + 1):
            head, tail = ([line(rng.randrange(7, 36)) for _ in range(rng.randrange(1, 6))] for _ in range(2))
            rows.append((i, "\n".join([*head, *shared, *tail])))
            want[i] = "\n".join([*head, *tail]) if i % 2 else rows[-1][1]
    again = [line(20) for _ in range(4)]  # within one document: the first stays, also where copies overlap
    rows.append((900, "\n".join(again * 3)))
    want[900] = "\n".join(again)
    rows.append((901, "\n".join(["w x y z a b c"] * 50)))
    want[901] = "\n".join(["w x y z a b c"] * 3)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), report=True).collect()}
    wrong = [i for i in want if got[i].text != want[i]]
    assert wrong == [] and all(r.n_removed_lines == r.n_lines - len(want[i].split("\n")) for i, r in got.items())


@pytest.mark.parametrize("broadcast", [True, False])
def test_line_dedup_recall(spark, monkeypatch, broadcast):
    """All lines of windows of three lines and eight words that occurred before go, and no line that occurs once."""
    if not broadcast:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(line_dedup, "BROADCAST_ITEMS", 1)
    rng = random.Random(11)
    line = lambda: " ".join(str(rng.randrange(10**7)) for _ in range(rng.randrange(1, 9)))
    pool = [line() for _ in range(60)]
    shared = [[rng.choice(pool) for _ in range(rng.randrange(3, 8))] for _ in range(30)]
    docs = []
    for i in range(120):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            lines += rng.choice(shared) if rng.random() < 0.5 else [line() for _ in range(rng.randrange(1, 4))]
        docs.append((i, "\n".join(lines)))
    times = collections.Counter(x for _, t in docs for x in t.split("\n"))
    seen, wanted = set(), collections.defaultdict(set)
    for i, t in docs:
        lines, first = t.split("\n"), set()
        windows = [(k, tuple(lines[k : k + 3])) for k in range(len(lines) - 2) if sum(len(x.split()) for x in lines[k : k + 3]) >= 8]
        for k, w in windows:
            if w in seen:
                wanted[i] |= {k, k + 1, k + 2}
            else:
                first |= {k, k + 1, k + 2}
                seen.add(w)
        if len({w for _, w in windows}) < len(windows):
            wanted[i] -= first  # repeats within a document: what the first one has stays
    got = {r.doc_id: collections.Counter(r.text.split("\n") if r.text else []) for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    total = missed = 0
    for i, t in docs:
        lines = t.split("\n")
        left = collections.Counter(x for k, x in enumerate(lines) if k not in wanted[i])
        total += len(wanted[i])
        missed += sum((got[i] - left).values())
        assert all(got[i][x] for x in lines if times[x] == 1)
    assert total > 300 and missed <= 0.02 * total


def test_licenses(spark):
    rows = [
        (1, "a/b/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", prose(1)), (3, "a/y.txt", prose(2)), (4, "a/b/own.txt", prose(3) + "\nLicensed under the Apache License, Version 2.0.\n" + prose(4)),
        (5, None, None), (6, "top.txt", ""), (7, "a/b/c/d/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (8, "a/b/c/d/e/f.txt", prose(5)), (2, "a/b/c/x.txt", prose(1)),
    ]
    df = spark.createDataFrame([(*r, "m", "d") for r in rows], "doc_id long, path string, text string, license string, dir string")
    got = license_scan.scan_licenses(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in got}
    assert by[1] == ("MIT", "MIT", None) and by[2] == (None, "MIT", "a/b") and by[3] == (None, None, None) and by[4] == ("Apache-2.0", "Apache-2.0", None)
    assert by[5] == by[6] == (None, None, None) and by[8] == (None, "GPL-3.0", "a/b/c/d")
    assert license_scan.scan_licenses(df.limit(0)).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [(i, prose(500 + i, 120), "en", "s", 0) for i in range(6)]
    near = [(20, good[0][1].replace("w", "v", 1), "en", "s", 0)]
    rows = [*good, *near, good[1], good[1], (30, "spam " * 300, "en", "s", 0), (31, None, "en", "s", 0), (32, "", None, None, None), (40, prose(900, 20_000), "en", "s", 0)]
    rows = [(*r, "x", 5) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, band string, salt int").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        names.append({r.doc_id for r in docs.collect()})
    assert names == [{*range(6), 20, 40}, {*range(6), 20, 40}, {*range(6), 40}]
    assert sorted(r.doc_id for r in docs.collect()) == [*range(6), 40]  # repeated rows of one id are one document
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {*range(6), 40}
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []
    assert corpus_pipeline.ORACLE_SQL is None
