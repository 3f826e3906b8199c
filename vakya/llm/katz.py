"""Katz back-off language model over a corpus, trained and evaluated with the counts dealt out by word.

No task holds the model, and no occurrence is shuffled as a row. Each task turns its documents into blocks: the
distinct (history, word) pairs of some documents with their places, packed as arrays and dealt out by word. What meets
for a word gives its unigram count, its bigram counts, and each document's part of the score that depends on them.
The rest, the back-off weight of a history, needs sums over all words after it; these and the requests for it are dealt
out by history. The frequent words, which are few by their share, are dealt out by pair.

Model, for a token w after h (N training tokens, V distinct ones, c counts):

    P1(w)   = (c(w) + 1) / (N + V + 1)
    P(w|h)  = d(c(h,w)) c(h,w) / c(h)                                  if c(h,w) > 0
            = alpha(h) P1(w)                                           if c(h) > 0
            = P1(w)                                                    otherwise
    alpha(h) = (1 - sum of the first line over seen w) / (1 - sum of P1 over seen w)

so that P(.|h) sums to one over the V words and one unknown word. d is Good-Turing's discount up to a count of 5, with
Katz's correction; where counts of counts don't allow it, and above, a fixed part of a count is taken off instead, so
that some mass is always left. The history of the first token is the start of a text; the last token is its end.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

MOST = 5
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Tokens of a block; its documents are fewer than 65536.
BLOCK_TOKENS = 1_500_000
WORDS_REMEMBERED = 400_000
FOLDS, HELD_OUT = 7, 2
#: Bytes of text for each bucket of words.
BUCKET_BYTES = 16 << 20
#: Histories of this share of the tokens, and the start, have their requests dealt out in so many parts.
HOT_HISTORY, SALTS = 1 / 64, 16
#: Stands for a null id in packed arrays.
NO_ID = -(1 << 63)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def is_train(doc: int | None) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % FOLDS != HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def frequent(docs: DataFrame, share: float) -> tuple[dict[int, int], int, int]:
    """Words that may have twice this share or more, with their training counts, and the numbers of training tokens and documents. At most 1 / share words."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        n = 0
        for batch in batches:
            for text in batch.column(1).to_pylist():
                words = tokens(text)
                n += len(words) + 1
                found.update(words)
            found[b"\n"] += batch.num_rows
            if len(found) > 4 * WORDS_REMEMBERED:  # what is rare so far is forgotten: the limit is half of what is asked for
                rare = [w for w, c in found.items() if c < share * n / 4]
                for w in rare:
                    del found[w]
        rows = [(w, c) for w, c in found.items() if c >= share * n] + [(None, n)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.int64())], ["word", "n"])

    pairs = docs.mapInArrow(local, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = pairs.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    hot = [bytes(r.word) for r in pairs.where("word is not null").where(F.col("n") >= total.select(F.col("n") * share).scalar()).collect()]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = set(hot)
        found: Counter = Counter()
        n = n_docs = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if is_train(doc):
                    words = tokens(text)
                    n, n_docs = n + len(words) + 1, n_docs + 1
                    found.update(w for w in words if w in wanted)
        rows = [*found.items(), (b"\n", n), (b"\n\n", n_docs)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.int64())], ["word", "n"])

    counts = {bytes(r.word): r.n for r in docs.mapInArrow(exact, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}  # at most 1 / share + 2 rows
    n, n_docs = counts.pop(b"\n", 0), counts.pop(b"\n\n", 0)
    found = {xxhash.xxh3_64_intdigest(w): counts.get(w, 0) for w in hot if w != b"\n"}
    if n_docs or hot:
        found[int(END)] = n_docs
    return found, n, n_docs


BLOCK_FIELDS = "bucket int, block long, w binary, nb binary, h binary, nd binary, d binary, c binary, train binary, ids binary, lengths binary"
BLOCK_NAMES = [x.split()[0] for x in BLOCK_FIELDS.split(", ")]


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def balanced_keys(spark: SparkSession, n: int) -> list[int]:
    """n keys of which Spark's hash partitioning deals one to each of n partitions."""
    tries = int(n * (math.log(n + 1) + 16))
    place = F.pmod(F.hash("key"), F.lit(n))
    found = spark.range(tries).select(F.col("id").cast("int").alias("key")).groupBy(place.alias("place")).agg(F.min("key").alias("key")).orderBy("place").collect()  # n rows
    keys = [r.key for r in found]
    return keys if len(keys) == n else [*keys, *range(tries, tries + n - len(keys))]


def block_rows(block: int, ids: list, texts: list[np.ndarray], hot: np.ndarray, keys: list[int]) -> pa.RecordBatch:
    """One row for each bucket: the pairs of a block of documents, sorted by word, history and document."""
    buckets = len(keys)
    lengths = np.array([len(x) + 1 for x in texts], np.int64)
    w = np.concatenate([y for x in texts for y in (x, [END])]).astype(np.uint64)
    h = np.concatenate([y for x in texts for y in ([START], x)]).astype(np.uint64)
    d = np.repeat(np.arange(len(texts)), lengths).astype("<u2")
    by_pair = np.isin(w, hot)
    bucket = (mixed(np.where(by_pair, mixed(w) + h, w)) % np.uint64(buckets)).astype(np.uint32)
    order = np.lexsort((h, w, bucket))  # stable, so documents stay in order
    w, h, d, bucket = w[order], h[order], d[order], bucket[order]
    entry = starts_of(bucket, w, h, d)
    count = np.diff(np.r_[entry, len(w)])
    w, h, d, bucket = w[entry], h[entry], d[entry], bucket[entry]
    train = np.packbits(np.array([is_train(x) for x in ids], bool)).tobytes()
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows: list[tuple] = []
    for b in range(buckets):
        home = b == block % buckets
        lo, hi = cuts[b], cuts[b + 1]
        if lo == hi and not home:
            continue
        ww, hh = w[lo:hi], h[lo:hi]
        pair, word = starts_of(ww, hh), starts_of(ww)
        rows.append((
            keys[b], block, ww[word].tobytes(), pack(np.diff(np.r_[np.searchsorted(pair, word), len(pair)]).astype("<u4")), hh[pair].tobytes(), pack(np.diff(np.r_[pair, hi - lo]).astype("<u4")),
            d[lo:hi].tobytes(), pack(count[lo:hi].astype("<u4")), train, np.array([NO_ID if x is None else x for x in ids], "<i8").tobytes() if home else None, lengths.astype("<i8").tobytes() if home else None,
        ))
    kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 9]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], BLOCK_NAMES)


def blocks(docs: DataFrame, hot: dict[int, int], keys: list[int]) -> DataFrame:
    hot_words = np.array(sorted(hot), np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens(text)
                if len(known) > WORDS_REMEMBERED:
                    known.clear()
                for x in set(words).difference(known):
                    known[x] = xxhash.xxh3_64_intdigest(x)
                ids.append(doc)
                texts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
                size += len(words)
                if size >= BLOCK_TOKENS or len(ids) == 60_000:
                    yield block_rows(number, ids, texts, hot_words, keys)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block_rows(number, ids, texts, hot_words, keys)

    return docs.mapInArrow(run, BLOCK_FIELDS)


class Bucket:
    """What all blocks have for the words of a bucket."""

    def __init__(self, table: pa.Table, hot: dict[int, int]) -> None:
        self.rows = [dict(zip(table.column_names, x, strict=True)) for x in zip(*(table.column(n).to_pylist() for n in table.column_names), strict=True)]
        w, h, train, self.pairs = [], [], [], []
        for r in self.rows:
            nb, nd = unpack(r["nb"], "<u4"), unpack(r["nd"], "<u4")
            d, c = np.frombuffer(r["d"], "<u2"), unpack(r["c"], "<u4")
            bits = np.unpackbits(np.frombuffer(r["train"], np.uint8)).astype(bool)
            w.append(np.repeat(np.frombuffer(r["w"], "<u8"), nb))
            h.append(np.frombuffer(r["h"], "<u8"))
            upto = np.r_[0, np.cumsum(np.where(bits[d], c, 0), dtype=np.int64)] if len(d) else np.zeros(1, np.int64)
            ends = np.cumsum(nd, dtype=np.int64)
            train.append(upto[ends] - upto[ends - nd])
            self.pairs.append(len(nd))
        w, h, train = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in (w, h, train))
        order = np.lexsort((h, w))
        pair = starts_of(w[order], h[order])
        self.w, self.h = w[order][pair], h[order][pair]  # distinct pairs
        self.count = np.add.reduceat(train[order], pair).astype(np.int64) if len(pair) else np.empty(0, np.int64)
        number = np.zeros(len(w), np.int32)
        number[pair[1:]] = 1
        self.of = np.empty(len(w), np.int32)  # distinct pair of each pair of each block
        self.of[order] = np.cumsum(number, dtype=np.int32)
        word = starts_of(self.w)
        sums = np.add.reduceat(self.count, word) if len(word) else np.empty(0, np.int64)
        names = self.w[word]
        self.is_hot = np.isin(names, np.array(sorted(hot), np.uint64))
        if self.is_hot.any():
            sums[self.is_hot] = [hot[int(x)] for x in names[self.is_hot]]
        self.word_counts = sums
        self.word_count = np.repeat(sums, np.diff(np.r_[word, len(self.w)]))


def discounts(n: list[int]) -> np.ndarray:
    """d(c) for c = 0 ... MOST, from the numbers of pairs that occur 1 ... MOST + 1 times."""
    d = np.ones(MOST + 1)
    last = (MOST + 1) * n[MOST] / n[0] if n[0] else 1.0
    for r in range(1, MOST + 1):
        turing = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
        found = (turing - last) / (1 - last) if last < 1 else 0.0
        d[r] = found if 0 < found < 1 else (r - 0.5) / r
    return d


ABOVE = 0.05  # of a count is taken off where counts are above MOST


def kept_counts(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c for counts above 0."""
    return np.where(count > MOST, count - ABOVE, d[np.minimum(count, MOST)] * count)


PART_FIELDS = "key int, kind int, block long, a binary, b binary, c binary, d binary, e binary, train binary, ids binary, lengths binary"
PART_NAMES = [x.split()[0] for x in PART_FIELDS.split(", ")]


def part_table(rows: list[dict]) -> pa.Table:
    kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 8]
    return pa.table([pa.array([r.get(n) for r in rows], k) for n, k in zip(PART_NAMES, kinds, strict=True)], PART_NAMES)


def salted(h: np.ndarray, salt: np.ndarray | int, widely_used: np.ndarray) -> np.ndarray:
    """What deals out requests by history: those for widely used histories in parts."""
    salt = np.asarray(salt, np.uint64)
    return np.where(np.isin(h, widely_used), mixed(h + (salt + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), mixed(h))


def scored_parts(bucket: Bucket, d: np.ndarray, n_train: int, size: int, n_docs: int, keys: list[int], widely_used: np.ndarray) -> pa.Table:
    """For each block the parts of its documents' scores (kind 0); sums by history (1); requests for back-off weights (2)."""
    rows: list[dict] = []
    buckets = len(keys)
    low = np.log10((bucket.word_count + 1) / size)
    seen = bucket.count > 0
    high = np.where(seen, np.log10(kept_counts(np.maximum(bucket.count, 1), d)), low)
    history = np.where(bucket.word_count > 0, np.log10(np.maximum(bucket.word_count, 1)), 0.0)
    history = np.where(bucket.w == END, np.log10(n_docs) if n_docs else 0.0, history)
    value, known = high - history, bucket.word_count > 0
    at = 0
    asked: list[tuple] = []
    for i, (r, n_pairs) in enumerate(zip(bucket.rows, bucket.pairs, strict=True)):
        of = bucket.of[at : at + n_pairs]
        at += n_pairs
        nd, doc, c = unpack(r["nd"], "<u4"), np.frombuffer(r["d"], "<u2"), unpack(r["c"], "<u4").astype(np.int64)
        entry = np.repeat(of, nd)
        n = len(r["train"]) * 8
        sums = [np.bincount(doc, weights=x[entry] * c, minlength=n)[:n] if len(doc) else np.zeros(n) for x in (low, value, known)]
        rows.append({"key": keys[int(mixed(np.array([r["block"]], np.uint64))[0] % np.uint64(buckets))], "kind": 0, "block": r["block"], "a": sums[0].tobytes(), "b": sums[1].tobytes(), "c": pack(sums[2].astype("<u4")), "train": r["train"] if r["ids"] is not None else None, "ids": r["ids"], "lengths": r["lengths"]})
        new = ~seen[entry]
        if new.any():
            asked.append((bucket.h[entry[new]], np.full(new.sum(), i, "<u4"), doc[new], c[new].astype("<u4")))
    order = np.argsort(bucket.h[seen], kind="stable")
    h, count = bucket.h[seen][order], bucket.count[seen][order]
    first = starts_of(h)
    if len(first):
        mass = np.add.reduceat(bucket.word_count[seen][order] + 1, first)
        gone = np.add.reduceat(count - kept_counts(count, d), first)
        h = h[first]
        wide = np.repeat(np.flatnonzero(np.isin(h, widely_used)), SALTS)  # one for each part of their requests
        at = np.r_[np.flatnonzero(~np.isin(h, widely_used)), wide]
        salt = np.r_[np.zeros(len(at) - len(wide), np.int64), np.tile(np.arange(SALTS), len(wide) // SALTS)]
        to = salted(h[at], salt, widely_used) % np.uint64(buckets)
        _, once = np.unique(np.stack([at.astype(np.uint64), to]), axis=1, return_index=True)  # parts can meet in one key
        at, to = at[once], to[once]
        h, mass, gone = h[at], mass[at], gone[at]
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[k] : cuts[k + 1]]
            rows.append({"key": keys[k], "kind": 1, "a": h[part].tobytes(), "b": pack(mass[part].astype("<i8")), "c": pack(gone[part])})
    if asked:
        h, i, doc, c = (np.concatenate(x) for x in zip(*asked, strict=True))
        blocks_of = np.array([r["block"] for r in bucket.rows], np.int64)[i]
        to = salted(h, mixed(blocks_of.astype(np.uint64)) % np.uint64(SALTS), widely_used) % np.uint64(buckets)
        order = np.lexsort((h, to))
        cuts = np.searchsorted(to[order], np.arange(buckets + 1))
        names = np.array([r["block"] for r in bucket.rows], "<i8").tobytes()
        for k in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[k] : cuts[k + 1]]
            first = starts_of(h[part])
            rows.append({"key": keys[k], "kind": 2, "a": h[part][first].tobytes(), "b": pack(np.diff(np.r_[first, len(part)]).astype("<u4")), "c": pack(i[part]), "d": pack(doc[part]), "e": pack(c[part]), "ids": names})
    return part_table(rows)


def backed_off(table: pa.Table, size: int) -> pa.Table:
    """Adds up the parts of each block (kind 0), and answers the requests from the sums by history (kind 0, without ids)."""
    rows = [dict(zip(table.column_names, x, strict=True)) for x in zip(*(table.column(n).to_pylist() for n in table.column_names), strict=True)]
    out: list[dict] = []
    own: dict[int, dict] = {}
    for r in (r for r in rows if r["kind"] == 0):
        mine = own.setdefault(r["block"], {"key": 0, "kind": 0, "block": r["block"], "sums": [0, 0, 0]})
        for k, x in enumerate((np.frombuffer(r["a"]), np.frombuffer(r["b"]), unpack(r["c"], "<u4").astype(np.int64))):
            mine["sums"][k] = mine["sums"][k] + x
        if r["ids"] is not None:
            mine |= {"ids": r["ids"], "train": r["train"], "lengths": r["lengths"]}
    out += [r | {"a": r["sums"][0].tobytes(), "b": r["sums"][1].tobytes(), "c": pack(r["sums"][2].astype("<u4"))} for r in own.values()]
    sums = [r for r in rows if r["kind"] == 1]
    asked = [r for r in rows if r["kind"] == 2]
    if sums and asked:
        h = np.concatenate([np.frombuffer(r["a"], "<u8") for r in sums])
        mass, gone = np.concatenate([unpack(r["b"], "<i8") for r in sums]), np.concatenate([unpack(r["c"], "<f8") for r in sums])
        order = np.argsort(h, kind="stable")
        first = starts_of(h[order])
        h, mass, gone = h[order][first], np.add.reduceat(mass[order], first), np.add.reduceat(gone[order], first)
        weight = np.log10(gone * size / (size - mass))  # c(h) alpha(h)
        fixed: dict[int, np.ndarray] = {}
        for r in asked:
            names, blocks_ = np.frombuffer(r["a"], "<u8"), np.frombuffer(r["ids"], "<i8")
            place = np.minimum(np.searchsorted(h, names), len(h) - 1)
            value = np.repeat(np.where(h[place] == names, weight[place], 0.0), unpack(r["b"], "<u4"))
            i, doc, c = unpack(r["c"], "<u4"), unpack(r["d"], "<u2"), unpack(r["e"], "<u4")
            order = np.argsort(i, kind="stable")
            cuts = np.searchsorted(i[order], np.arange(len(blocks_) + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                part = order[cuts[k] : cuts[k + 1]]
                one = np.bincount(doc[part], weights=value[part] * c[part])
                had = fixed.get(int(blocks_[k]))
                if had is not None:
                    one, had = (one, had) if len(one) >= len(had) else (had, one)
                    one = one.copy()
                    one[: len(had)] += had
                fixed[int(blocks_[k])] = one
        out += [{"key": 0, "kind": 1, "block": b, "b": x.tobytes()} for b, x in fixed.items()]
    return part_table(out)


@dataclass(frozen=True)
class Prepared:
    """The corpus dealt out by word, and what bounds it."""

    dealt: DataFrame
    hot: dict[int, int]
    keys: list[int]
    widely_used: np.ndarray
    n_train: int
    n_docs: int


def prepared(docs: DataFrame, id_col: str, text_col: str) -> Prepared:
    spark = docs.sparkSession
    small_batches(spark, 500)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size_of = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size_of // BUCKET_BYTES))
    keys = balanced_keys(spark, buckets)
    hot, n_train, n_docs = frequent(rows, 1 / (4 * buckets))
    widely_used = np.array([int(START), *(w for w, c in hot.items() if c >= HOT_HISTORY * n_train and w != int(END))], np.uint64)
    return Prepared(blocks(rows, hot, keys).repartition(buckets, "bucket"), hot, keys, widely_used, n_train, n_docs)


def count_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the training counts of the model to tables at ``path``, partitioned by bucket: (bucket, history, word, n), words as 64-bit hashes.

    A word's unigram count is the sum over its histories. ``score_corpus`` doesn't need the tables: it makes these counts
    where it uses them, as storing them would cost as much disk again.
    """
    m = prepared(docs, id_col, text_col)
    hot = m.hot

    def pairs(table: pa.Table) -> pa.Table:
        b = Bucket(table, hot)
        seen = b.count > 0
        n = int(seen.sum())
        key = table.column("bucket")[0].as_py()
        return pa.table([pa.array(np.full(n, key, np.int32)), pa.array(b.h[seen].view(np.int64)), pa.array(b.w[seen].view(np.int64)), pa.array(b.count[seen])], ["bucket", "history", "word", "n"])

    counts = m.dealt.groupBy("bucket").applyInArrow(pairs, "bucket int, history long, word long, n long")
    counts.write.partitionBy("bucket").mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema("bucket int, history long, word long, n long").parquet(path)


def score_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Training texts are those whose crc32 of the id as text, mod 7, isn't 2. A null text is the empty text, which has
    one token, its end; a null id counts as the empty text in the remainder; repeated rows count and score as often as
    they occur; an empty table gives an empty result; other columns are ignored. Without training texts every token is
    unknown.
    """
    m = prepared(docs, id_col, text_col)
    dealt, hot, keys, widely_used, n_train, n_docs, buckets = m.dealt, m.hot, m.keys, m.widely_used, m.n_train, m.n_docs, len(m.keys)
    v_hot = sum(c > 0 for c in hot.values())
    numbers = ", ".join(f"n{i} long" for i in range(1, MOST + 2))

    def count(table: pa.Table) -> pa.Table:
        b = Bucket(table, hot)
        found = [int(np.count_nonzero(b.count == r)) for r in range(1, MOST + 2)]
        v = int(np.count_nonzero(b.word_counts[~b.is_hot]))
        return pa.table([pa.array([x], pa.int64()) for x in (v, *found)], ["v", *(f"n{i}" for i in range(1, MOST + 2))])

    # The dealt-out blocks are the same exchange here and below, so they are made once.
    totals = dealt.groupBy("bucket").applyInArrow(count, f"v long, {numbers}").agg(F.array(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("v", *(f"n{i}" for i in range(1, MOST + 2)))]).alias("totals"))

    def score(table: pa.Table) -> pa.Table:
        v, *n = table.column("totals")[0].as_py()
        size = n_train + v + v_hot + 1
        parts = scored_parts(Bucket(table.drop_columns(["totals"]), hot), discounts(n), n_train, size, n_docs, keys, widely_used)
        return parts.append_column("size", pa.array([size] * len(parts), pa.int64()))

    parts = dealt.withColumn("totals", totals.scalar()).groupBy("bucket").applyInArrow(score, f"{PART_FIELDS}, size long")

    def back_off(table: pa.Table) -> pa.Table:
        return backed_off(table.drop_columns(["size"]), table.column("size")[0].as_py())

    answers = parts.repartition(buckets, "key").groupBy("key").applyInArrow(back_off, PART_FIELDS)

    def finish(table: pa.Table) -> pa.Table:
        base, total, known, home = 0, 0, 0, None
        for r in zip(*(table.column(n).to_pylist() for n in ("kind", "a", "b", "c", "train", "ids", "lengths")), strict=True):
            if r[0] == 0:
                base, total, known = np.frombuffer(r[1]), total + np.frombuffer(r[2]), unpack(r[3], "<u4")
                home = r[4:] if r[5] is not None else home
        ids, lengths = np.frombuffer(home[1], "<i8"), np.frombuffer(home[2], "<i8")
        n = len(ids)
        total = np.array(total[:n])
        for kind, x in zip(table.column("kind").to_pylist(), table.column("b").to_pylist(), strict=True):
            if kind == 1:
                x = np.frombuffer(x)[:n]
                total[: len(x)] += x
        train = np.unpackbits(np.frombuffer(home[0], np.uint8))[:n].astype(bool)
        return pa.table([pa.array(ids, mask=ids == NO_ID), pa.array(~train), pa.array(lengths), pa.array(known[:n].astype(np.int64)), pa.array(np.full(n, n_train)), pa.array(base[:n]), pa.array(total)], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    found = answers.groupBy("block").applyInArrow(finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return found.withColumnRenamed("id", id_col)
