"""Phrase collocations by SON partitioning.

The texts of a language are packed into shards of at most 8 MB. Pass one mines each shard completely: all phrases of up
to ``longest`` words that reach the local support, which is the support times the shard's share of the language's words
(a phrase that is frequent must reach it in some shard). Locally frequent phrases travel as 48-bit hashes with their counts, once a
shard, dealt out by hash and packed as differences; their union, less what cannot reach the support even if every other
shard had just missed its own, gives the candidates. Phrases of three and more words are mined after those of two, and
only where all their pairs may be candidates, which a bitmap of fixed size tells (full, it would only let more pass).
Pass two sends each shard its candidates and counts their texts
there exactly; the sums of texts over shards are exact, as equal hashes of different phrases only make a candidate too
many.

No step holds more than a shard or a bucket of hashes, a phrase is sent at most once by each shard, however common it
is, and rows between shards and buckets exist only where a shard has something for a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, written

SHARD_BYTES = 8 << 20
#: Hashes of a bucket, about.
BUCKET_HASHES = 1 << 20
HASH_BITS = 48
#: Bits of the filter of pairs (16 MB), and of one of its pages.
FILTER_BITS, PAGE_BITS = 27, 19
ALL = -1
#: Parts of a language of which the best phrases are taken before those of all.
TOP_PARTS = 32
BREAK, BLANK = ord("."), ord(" ")

#: Lower case for A-Z, one break for all characters that end a piece, one blank.
NORMAL = bytearray(range(256))
for _c in b".,;:!?\n\x0b\x0c\r":
    NORMAL[_c] = BREAK
for _c in b" \t":
    NORMAL[_c] = BLANK
for _c in range(ord("A"), ord("Z") + 1):
    NORMAL[_c] = _c + 32
NORMAL = bytes(NORMAL)


def cut_at_breaks(data: bytes, most: int) -> Iterator[bytes]:
    """Parts of about ``most`` bytes at most, cut at ends of pieces; a piece itself is never cut."""
    while len(data) > most:
        at = data.rfind(b".", 1, most)
        at = data.find(b".", most) if at < 0 else at
        if at < 0:
            break
        yield data[:at]
        data = data[at:]
    yield data


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, in as many bytes as the largest needs, the lowest bytes of all first."""
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    width, n = data[0], (len(data) - 1) // data[0]
    found = np.zeros((n, 8), np.uint8)
    found[:, :width] = np.frombuffer(data, np.uint8, offset=1).reshape(width, n).T
    return found.view("<u8").ravel()


def packed_hashes(x: np.ndarray) -> bytes:
    """Sorted hashes as the first one and the differences."""
    return x[:1].astype("<u8").tobytes() + planes(np.diff(x)) if len(x) else b""


def unpacked_hashes(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    first = np.frombuffer(data, "<u8", 1)
    return np.concatenate([first, first + np.cumsum(from_planes(data[8:]), dtype=np.uint64)])


class Words:
    """The words of a shard as numbers: ``ids`` into ``names``, and ``piece``, which tells where pieces end."""

    def __init__(self, data: bytes) -> None:
        chars = np.frombuffer(data, np.uint8)
        breaks = chars == BREAK
        inside = np.concatenate([[False], ~(breaks | (chars == BLANK)), [False]])
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        letters = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data.translate(None, b" ."))])
        coded = letters.dictionary_encode()
        self.ids, self.names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.piece = np.cumsum(breaks, dtype=np.int32)[starts]

    def __len__(self) -> int:
        return len(self.ids)

    def starts(self, n: int) -> np.ndarray:
        """Where a phrase of n words begins."""
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1]) if len(self) >= n else np.zeros(0, np.int64)

    def hashes(self, longest: int) -> list[np.ndarray]:
        """For each length the hashes of its phrases, in the order of ``starts``."""
        of_name = np.array([xxhash.xxh64_intdigest(x) for x in self.names.to_pylist()], np.uint64)
        word = of_name[self.ids] if len(self) else np.zeros(0, np.uint64)
        found, whole = [], mixed(word)
        for n in range(1, longest + 1):
            if n > 1:
                whole = mixed(whole[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[n - 1 :]) if len(whole) else whole
            found.append(whole[self.starts(n)] >> np.uint64(64 - HASH_BITS))
        return found

    def phrases(self, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct phrases of n words that begin at these places, as texts, with their counts and the number of a place of each."""
        code = self.ids[at]
        for k in range(1, n):
            code = np.unique(code, return_inverse=True)[1] * len(self.names) + self.ids[at + k]
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        one = at[first]
        parts = [self.names.take(pa.array(self.ids[one + k])) for k in range(n)]
        texts = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary()))
        return texts, counts, first


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shards(docs: DataFrame, lang_col: str, text_col: str, shard_bytes: int) -> DataFrame:
    """A written table (shard, lang, n, data): normalised texts of one language each, compressed, and their number of words."""
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        press = zstandard.ZstdCompressor(level=3)

        def packed(lang: str) -> pa.RecordBatch:
            data = b".".join(held.pop(lang))
            size.pop(lang)
            chars = np.frombuffer(data, np.uint8)
            inside = np.concatenate([[False], (chars != BREAK) & (chars != BLANK)])
            n = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
            return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n], pa.int64()), pa.array([press.compress(data)], pa.binary())], ["lang", "n", "data"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in cut_at_breaks(text.encode("utf-8", "replace").translate(NORMAL), shard_bytes):
                    if size.get(lang, 0) + len(part) > shard_bytes and lang in held:
                        yield packed(lang)
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part) + 1
                    if sum(size.values()) > 4 * shard_bytes:
                        yield packed(max(size, key=size.get))
        for lang in sorted(held):
            yield packed(lang)

    return written(source.mapInArrow(run, "lang string, n long, data binary").withColumn("shard", F.monotonically_increasing_id()))


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(HASH_BITS - bits)


def mine(parts: DataFrame, lengths: range, pairs: Broadcast | None = None) -> DataFrame:
    """(lang, bucket, shard, local, slack, hashes, counts): the phrases of these lengths that each shard finds at its local support, by ranges of hashes. With ``pairs``, a bitmap, a phrase counts only if all its pairs are in it."""

    def phrases(words: Words) -> np.ndarray:
        every = words.hashes(lengths[-1])
        if pairs is None:
            return np.concatenate([every[n - 1] for n in lengths])
        good = np.zeros(len(words), bool)  # whether the pair that begins at a word may be a candidate
        starts, place = words.starts(2), every[1] >> np.uint64(HASH_BITS - FILTER_BITS)
        good[starts] = np.frombuffer(pairs.value, np.uint8)[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1
        found = []
        for n in lengths:
            at = words.starts(n)
            keep = np.ones(len(at), bool)
            for k in range(n - 1):
                keep &= good[at + k]
            found.append(every[n - 1][keep])
        return np.concatenate(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, local, slack, bits, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found, counts = np.unique(phrases(Words(zstandard.decompress(data))), return_counts=True)
                keep = counts >= local
                found, counts = found[keep], counts[keep]
                buckets = bucket_of(found, bits)
                named = np.arange(1 << bits, dtype=np.uint64) if local > 1 else np.unique(buckets)  # with a local support above one, what a shard lacks says nothing
                first, last = np.searchsorted(buckets, named), np.searchsorted(buckets, named, "right")
                for k in range(0, len(named), 1000):
                    at = list(zip(first[k : k + 1000], last[k : k + 1000], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(at)),
                            pa.array(named[k : k + 1000].astype(np.int64)),
                            *(pa.array([x] * len(at), pa.int64()) for x in (shard, local, slack)),
                            pa.array([packed_hashes(found[i:j]) for i, j in at], pa.binary()),
                            pa.array([planes(counts[i:j]) for i, j in at], pa.binary()),
                        ],
                        ["lang", "bucket", "shard", "local", "slack", "hashes", "counts"],
                    )

    return parts.select("shard", "lang", "local", "slack", "bits", "data").mapInArrow(run, "lang string, bucket long, shard long, local long, slack long, hashes binary, counts binary")


def candidates(mined: DataFrame, support: int) -> DataFrame:
    """(shard, hashes): for each shard, the candidates that it must count; once with the shard -1, all of a bucket."""

    def run(group: pa.Table) -> pa.Table:
        shard, local, slack = (group[c].to_pylist() for c in ("shard", "local", "slack"))
        lists = [unpacked_hashes(x) for x in group["hashes"].to_pylist()]
        every = np.concatenate(lists)
        # a shard that has not sent a phrase holds it local - 1 times at most
        counts = np.concatenate([from_planes(x).astype(np.int64) - (t - 1) for x, t in zip(group["counts"].to_pylist(), local, strict=True)])
        order = np.argsort(every, kind="stable")
        every, counts = every[order], counts[order]
        heads = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts, heads) if len(heads) else np.zeros(0, np.int64)
        named = every[heads][sums + slack[0] >= support]
        replies = [named if t > 1 else x[np.isin(x, named, assume_unique=True)] for x, t in zip(lists, local, strict=True)]
        full = [(s, packed_hashes(x)) for s, x in [(ALL, named), *zip(shard, replies, strict=True)] if len(x)]
        return pa.table({"shard": pa.array([s for s, _ in full], pa.int64()), "hashes": pa.array([x for _, x in full], pa.binary())})

    return written(mined.groupBy("lang", "bucket").applyInArrow(run, "shard long, hashes binary"))


def bitmap(found: DataFrame) -> Broadcast:
    """The candidates as a bitmap of 2 ** FILTER_BITS bits, whatever their number: pages are joined by ``or`` in tasks, the driver sets them side by side."""
    size = 1 << (FILTER_BITS - PAGE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                place = np.unique(unpacked_hashes(data) >> np.uint64(HASH_BITS - FILTER_BITS)).astype(np.int64)
                page = place >> PAGE_BITS
                for p in np.unique(page).tolist():
                    bits = np.zeros(1 << PAGE_BITS, np.uint8)
                    bits[place[page == p] & ((1 << PAGE_BITS) - 1)] = 1
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["page", "bits"])

    def joined(group: pa.Table) -> pa.Table:
        every = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in group["bits"].to_pylist()])
        return pa.table({"page": pa.array([group["page"][0].as_py()], pa.int64()), "bits": pa.array([every.tobytes()], pa.binary())})

    pages = found.where(F.col("shard") == ALL).select("hashes").mapInArrow(run, "page long, bits binary").groupBy("page").applyInArrow(joined, "page long, bits binary")
    by_page = {r.page: bytes(r.bits) for r in pages.collect()}  # size pages at most
    empty = bytes(1 << (PAGE_BITS - 3))
    return found.sparkSession.sparkContext.broadcast(b"".join(by_page.get(p, empty) for p in range(size)))


def count_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: int = 10, longest: int = 3, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Exact counts of all phrases of one to ``longest`` words that occur ``support`` times in a language: a written table (lang, words, phrase, a), and (lang, n) with the number of words of each language.

    Null languages are ``und``, null texts are empty. Repeated rows count again. An empty table gives no rows.
    """
    parts = shards(docs, lang_col, text_col, shard_bytes)
    sizes = parts.groupBy("lang").agg(F.sum("n").alias("total"))
    local = F.greatest(F.expr(f"cast(ceil({support} * cast(n as decimal(20, 0)) / greatest(total, 1)) as bigint)"), F.lit(1))
    shared = parts.select("shard", "lang", "n").join(broadcast_if_small(sizes, 100_000), "lang").withColumn("local", local)
    slack = shared.groupBy("lang").agg(F.sum(F.col("local") - 1).alias("slack"), F.first("total").alias("total"))
    bits = F.ceil(F.log2(F.greatest(F.col("total") * longest / F.lit(BUCKET_HASHES), F.lit(1.0)))).cast("long")
    plan = written(slack.withColumn("bits", bits))
    known = parts.join(broadcast_if_small(plan, 100_000), "lang").withColumn("local", local)
    short = candidates(mine(known, range(1, min(longest, 2) + 1)), support)
    every = short.unionByName(candidates(mine(known, range(3, longest + 1), bitmap(short)), support)) if longest > 2 else short
    wanted = every.where(F.col("shard") != ALL).groupBy("shard").agg(F.collect_list("hashes").alias("lists"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for lang, bits, data, lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, named = Words(zstandard.decompress(data)), np.sort(np.concatenate([unpacked_hashes(x) for x in lists]))
                every: list[list] = [[], [], []]
                for n, hashes in enumerate(words.hashes(longest), 1):
                    at = np.searchsorted(named, hashes)
                    at[at == len(named)] = 0
                    taken = named[at] == hashes
                    texts, counts, first = words.phrases(words.starts(n)[taken], n)
                    for x, y in zip(every, (texts.cast(pa.large_binary()), counts, bucket_of(hashes[taken][first], bits)), strict=True):
                        x.append(y)
                texts, counts, buckets = pa.chunked_array(every[0]).combine_chunks(), np.concatenate(every[1]), np.concatenate(every[2])
                order = pc.sort_indices(pa.table({"b": buckets, "t": texts}), [("b", "ascending"), ("t", "ascending")]).to_numpy()
                texts, counts, buckets = texts.take(pa.array(order)).to_pylist(), counts[order], buckets[order]
                named_buckets = np.unique(buckets)
                ends = list(zip(np.searchsorted(buckets, named_buckets), np.searchsorted(buckets, named_buckets, "right"), strict=True))
                for k in range(0, len(ends), 1000):
                    part = ends[k : k + 1000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(part)),
                            pa.array(named_buckets[k : k + 1000].astype(np.int64)),
                            pa.array([press.compress(b"\n".join(texts[i:j])) for i, j in part], pa.binary()),  # no phrase has a line feed
                            pa.array([planes(counts[i:j]) for i, j in part], pa.binary()),
                        ],
                        ["lang", "bucket", "texts", "counts"],
                    )

    def total(group: pa.Table) -> pa.Table:
        texts = [x for part in group["texts"].to_pylist() for x in zstandard.decompress(part).split(b"\n")]
        counts = np.concatenate([from_planes(x) for x in group["counts"].to_pylist()]).astype(np.int64)
        sums = pa.table({"phrase": pa.array(texts, pa.binary()), "a": counts}).group_by("phrase", use_threads=False).aggregate([("a", "sum")])
        sums = sums.filter(pc.greater_equal(sums["a_sum"], support))
        phrase = sums["phrase"].cast(pa.string())
        words = pc.add(pc.count_substring(phrase, " "), 1).cast(pa.int32())
        return pa.table({"lang": pa.array([group["lang"][0].as_py()] * len(phrase), pa.string()), "words": words, "phrase": phrase, "a": sums["a_sum"]})

    counted = parts.join(wanted, "shard").join(broadcast_if_small(plan.select("lang", "bits"), 100_000), "lang").select("lang", "bits", "data", "lists").mapInArrow(run, "lang string, bucket long, texts binary, counts binary")
    return written(counted.groupBy("lang", "bucket").applyInArrow(total, "lang string, words int, phrase string, a long")), plan.select("lang", F.col("total").alias("n"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", support: int = 10, longest: int = 3, top: int = 2000, covered: int = 50, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The ``top`` phrases of two to ``longest`` words of each language: lang, rank, phrase, a, l, r, n, score.

    The score is ``a * a / (l * r)`` in millionths, floored, at the cut where it is lowest (the first of equal ones). A
    phrase goes where a longer one that holds its words has ``covered`` percent of its count. Ties are ordered by
    count, then by the bytes of the phrase.
    """
    counts, sizes = count_phrases(docs, lang_col, text_col, support, longest, shard_bytes)
    split = F.split("phrase", " ")
    several = counts.where("words > 1").select("lang", "words", "phrase", "a", split.alias("w"))
    part = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    cuts = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), part(1, k).alias("left"), part(k + 1, longest).alias("right")) for k in range(1, longest)]), lambda x: x["k"] < F.col("words"))
    known = counts.select("lang", "phrase", "a")
    cut = several.select("lang", "words", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "words", "phrase", "a", "c.*")
    side = lambda phrase, f: known.select("lang", F.col("phrase").alias(phrase), F.col("a").alias(f))
    score = F.expr("(cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0))) div (cast(l as decimal(15, 0)) * cast(r as decimal(15, 0)))")
    scored = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).withColumn("score", score)
    lowest = scored.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    inner = [F.when(F.col("words") >= s + m, part(s + 1, m)) for m in range(2, longest) for s in range(longest - m + 1)]
    within = several.select("lang", "words", F.col("a").alias("longer"), F.explode(F.array_distinct(F.array_compact(F.array(*inner)))).alias("phrase")) if inner else None
    if within is not None:
        within = within.where(F.size(F.split("phrase", " ")) < F.col("words")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        lowest = lowest.join(within, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    order = [F.desc("m.score"), F.desc("a"), F.col("phrase")]
    parted = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(TOP_PARTS))).orderBy(*order)  # first the best of each part
    first = lowest.withColumn("rank", F.row_number().over(parted)).where(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(broadcast_if_small(sizes, 100_000), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "m.l", "m.r", "n", "m.score")
