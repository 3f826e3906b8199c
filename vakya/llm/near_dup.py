"""Near-duplicate groups by min-max hashing.

Each document is the set of its distinct word shingles. Under each of some permutations both the minimum and the
maximum of the set are kept, so half as many hashes are evaluated as for minima alone. Runs of signature values
(bands) that agree make documents candidates; candidates are confirmed on their full sets.

Documents with equal sets form a class, which one document stands for. No bucket is expanded into pairs:

1. Each class of a bucket is compared with the bucket's leader only (the class with the most documents).
2. What is confirmed is joined into components.
3. Where a bucket still holds several components, blocks of its classes are compared by signature, and only pairs
   from different components whose estimated similarity is within four standard errors of the threshold come out.
4. Those pairs are confirmed, and the components are completed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, written
from .components import components

#: Rows up to which keys are broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 400_000
#: Classes of a bucket that one task compares with one another; larger buckets are compared block by block.
BLOCK = 1024
#: Shingles of the sets of a block: what one task holds follows from them, and not from the length of texts.
BLOCK_SHINGLES = 2_000_000
#: Classes of a bucket that are joined with its leader in one group; larger buckets are dealt out in several.
CROWD = 512
#: Pairs of one leader that meet in one group of the join that confirms them.
FAN = 256
WORDS_REMEMBERED = 500_000
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Shingle length, threshold in per cent, and the bands that follow from it."""

    words: int = 5
    percent: int = 80
    #: Chance that the bands miss a pair just at the threshold.
    miss: float = 1e-6
    rows: int = field(init=False)
    bands: int = field(init=False)

    def __post_init__(self) -> None:
        t = self.percent / 100
        rows = max(1, round(math.log(0.42) / math.log(t)))
        object.__setattr__(self, "rows", rows)
        object.__setattr__(self, "bands", math.ceil(math.log(self.miss) / math.log(1 - t**rows)))

    @property
    def values(self) -> int:
        return self.rows * self.bands

    @property
    def least_estimate(self) -> float:
        t = self.percent / 100
        return t - 4 * math.sqrt(t * (1 - t) / self.values)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of texts."""

    def __init__(self, words: int) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > WORDS_REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(h))
        n = len(h) - k + 1
        acc = np.full(n, k, np.uint64)
        for i in range(k):
            acc = mixed(acc * MIX + h[i : i + n])
        return np.unique(acc)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray, values: int) -> bytes:
    """The low 16 bits of the minimum and maximum under each permutation, in turn."""
    x = (found >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(len(a), 0xFFFFFFFF, np.uint32), np.zeros(len(a), np.uint32)
    for i in range(0, len(x), 1 << 16):
        v = a[:, None] * x[None, i : i + (1 << 16)] + b[:, None]
        low, high = np.minimum(low, v.min(1)), np.maximum(high, v.max(1))
    # Extremes share their leading bits, so they are hashed before they are cut to 16 bits.
    both = np.stack([low, high], 1).ravel()[:values]
    return ((both * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype("<u2").tobytes()


def permutations(values: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = (values + 1) // 2
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def signatures(docs: DataFrame, plan: Plan, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, digest, sig); documents without words have neither digest nor signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, (a, b) = Shingler(plan.words), permutations(plan.values)
        for batch in batches:
            sets = [shingle(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([signature(s, a, b, plan.values) if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc", "n_shingles", "digest", "sig"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col)).mapInArrow(run, "doc long, n_shingles long, digest binary, sig binary")


def full_sets(docs: DataFrame, plan: Plan) -> DataFrame:
    """(node, shingles) of ``docs(doc, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(plan.words)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle(x).tobytes() for x in batch.column(1).to_pylist()], pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary")


def band_keys(plan: Plan) -> Column:
    size = 2 * plan.rows
    return F.array(*[F.xxhash64(F.substring("sig", 1 + i * size, size), F.lit(i)) for i in range(plan.bands)])


def likely(pairs: DataFrame, sigs: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (a, b) whose signatures agree often enough."""
    side = lambda x: sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))
    wide = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sig_a", "sig_b")
    least = plan.least_estimate * plan.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array((x == y).sum(1) >= least))

    return wide.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs (u, v) of ``pairs(a, b)`` that reach the threshold on full sets.

    Each set is sent once to each group it is needed in: a leader's to the groups of its pairs, of which there are as
    many as keep a group small, a member's to the group of its pair. A task streams its groups, leader first.
    """
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("long").alias("groups"))
    fans = written(fans)
    wide = broadcast_if_small(fans.where("groups > 1"), BROADCAST_ROWS)  # leaders of more than FAN pairs
    members = pairs.join(wide, "a", "left").select(F.col("b").alias("node"), "a", F.pmod(F.xxhash64("b"), F.coalesce("groups", F.lit(1).cast("long"))).alias("salt"), F.lit(1).alias("role"))
    leaders = fans.select(F.col("a").alias("node"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = written(leaders.unionByName(members))
    dealt = sets.join(broadcast_if_small(wanted, BROADCAST_ROWS), "node").select("a", "salt", "role", "node", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, lead = None, []
        for batch in batches:
            u, v = [], []
            for a, salt, role, node, data in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                found = np.frombuffer(data.as_buffer(), "<u8").copy()
                if group != (a, salt):
                    group, lead = (a, salt), []
                if role == 0:
                    lead.append(found)
                    continue
                for x in lead:
                    both = len(np.intersect1d(x, found, assume_unique=True))
                    if 100 * both >= plan.percent * (len(x) + len(found) - both):
                        u.append(a)
                        v.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return dealt.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(run, "u long, v long")


def side_arrays(column: pa.Array, values: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, nodes, components, signatures) of a list column of (node, comp, sig)."""
    inner = column.flatten()
    offsets = np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]
    sig = np.frombuffer(b"".join(inner.field("sig").to_pylist()), "<u2").reshape(-1, values)
    return offsets, inner.field("node").to_numpy(), inner.field("comp").to_numpy(), sig


def cross_pairs(rows: DataFrame, plan: Plan) -> DataFrame:
    """(band, i, j, nodes, a, b): pairs of ``left`` and ``right`` classes of a row of blocks that are in different components and look alike.

    ``a`` and ``b`` are places in ``nodes``. A pair is taken in the first band that both share, so in one row only.
    """
    least = plan.least_estimate * plan.values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left_at, left, left_comp, left_sig = side_arrays(batch.column(4), plan.values)
            right_at, right, right_comp, right_sig = side_arrays(batch.column(5), plan.values)
            numbers = batch.column(3).to_pylist()
            keep, nodes, firsts, seconds = [], [], [], []
            for i in range(batch.num_rows):
                there = slice(right_at[i], right_at[i + 1])
                a, b = [], []
                for k in range(left_at[i], left_at[i + 1]):
                    apart = np.flatnonzero(right_comp[there] != left_comp[k])
                    same = right_sig[there][apart] == left_sig[k]
                    near = same.sum(1) >= least
                    shared = same[near].reshape(-1, plan.bands, plan.rows).all(2)
                    found = apart[near][shared.argmax(1) == numbers[i]]
                    a.append(np.full(len(found), left[k]))
                    b.append(right[there][found])
                a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
                if len(a):
                    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                    known, place = np.unique(pairs, return_inverse=True)
                    place = place.reshape(-1, 2).astype("<u2")
                    keep.append(i)
                    nodes.append(known.tolist())
                    firsts.append(place[:, 0].tobytes())
                    seconds.append(place[:, 1].tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(at) for i in range(3)), pa.array(nodes, pa.list_(pa.int64())), pa.array(firsts, pa.binary()), pa.array(seconds, pa.binary())], ["band", "i", "j", "nodes", "a", "b"]
            )

    return rows.select("band", "i", "j", "number", "left", "right").mapInArrow(run, "band long, i int, j int, nodes array<long>, a binary, b binary")


def confirmed_blocks(work: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """Links (u, v) among the pairs of ``cross_pairs`` on full sets: enough of them to join all that are linked.

    Each set is sent once to each row of blocks that needs it. Pairs that links found before have joined are skipped.
    """
    on = ["band", "i", "j"]
    places = written(work.select(*on, F.posexplode("nodes").alias("place", "node")))
    parts = sets.join(broadcast_if_small(places, BROADCAST_ROWS), "node").select(*on, "place", F.col("shingles").alias("data"), F.lit(None).cast("binary").alias("b"), F.lit(None).cast("array<long>").alias("nodes"))
    heads = work.select(*on, F.lit(-1).alias("place"), F.col("a").alias("data"), "b", "nodes")

    def links(pairs: np.ndarray, nodes: list[int], found: dict[int, np.ndarray]) -> Iterator[tuple[int, int]]:
        root = list(range(len(nodes)))

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in pairs.tolist():
            u, v = top(a), top(b)
            if u != v and a in found and b in found:
                x, y = found[a], found[b]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= plan.percent * (len(x) + len(y) - both):
                    root[u] = v
                    yield nodes[a], nodes[b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, found = None, None, {}
        out: list[tuple[int, int]] = []

        def close() -> None:
            if head is not None:
                out.extend(links(head[0], head[1], found))

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], ["u", "v"])
            out.clear()
            return batch

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for k, (band, i, j, place) in enumerate(zip(*columns, strict=True)):
                if key != (band, i, j):
                    close()
                    key, head, found = (band, i, j), None, {}
                data = batch.column(4)[k].as_buffer()
                if place < 0:
                    head = np.stack([np.frombuffer(data, "<u2"), np.frombuffer(batch.column(5)[k].as_buffer(), "<u2")], 1), batch.column(6)[k].as_py()
                else:
                    found[place] = np.frombuffer(data, "<u8").copy()
            yield taken()
        close()
        yield taken()

    return parts.unionByName(heads).select(*on, "place", "data", "b", "nodes").repartition(*on).sortWithinPartitions(*on, "place").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row: the least id reachable over links of at least the threshold.

    A text of fewer words than a shingle is one shingle; a null or empty text, or one of white space, has none and is
    linked with nothing. Rows with one id count as one document: a link of any of them is a link of all of that text's
    rows. A row without an id has the component of the documents with its text and isn't kept if there are any; else
    its component is null and it is kept. Ids are whole numbers. Sets are of 64-bit hashes of shingles, ``n_shingles``
    counts these. Ties need no rule, as components don't depend on an order. An empty table gives an empty result;
    other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    sig = written(signatures(docs, plan, id_col, text_col))
    classes = written(sig.where("n_shingles > 0 and doc is not null").groupBy("digest").agg(F.min("doc").alias("node"), F.count(F.lit(1)).alias("n_docs"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")))
    sigs = classes.select("node", "sig")
    members = classes.select("node", "n_docs", "n_shingles", F.posexplode(band_keys(plan)).alias("number", "band"))
    leaders = members.groupBy("band").agg(F.max(F.struct(F.col("n_docs"), (-F.col("node")).alias("minus"))).alias("top"), F.count(F.lit(1)).alias("size")).where("size > 1")
    leaders = written(leaders.select("band", (-F.col("top.minus")).alias("leader"), "size", F.ceil(F.col("size") / CROWD).cast("int").alias("groups")))
    hot = broadcast_if_small(leaders.where("groups > 1").select("band", "groups"), BROADCAST_ROWS)
    dealt = members.join(hot, "band", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("groups", F.lit(1))).cast("int")).drop("groups")
    crowded = written(dealt.join(in_groups(leaders), ["band", "salt"]).select("band", "salt", "groups", "number", "node", "n_shingles", "leader", "size"))
    wanted = crowded.select(F.col("node").alias("doc")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    sets = written(full_sets(texts.join(broadcast_if_small(written(wanted), BROADCAST_ROWS), "doc").where("text is not null").select("doc", "text"), plan).where("octet_length(shingles) > 0"))

    stars = crowded.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = written(confirmed(written(likely(stars, sigs, plan)), sets, plan))
    comp = components(first)
    named = crowded.where("size > 2").join(comp.select("node", F.col("component").alias("found")), "node", "left").withColumn("comp", F.coalesce("found", "node")).drop("found")
    main = named.where("node = leader").select("band", "groups", F.col("comp").alias("main"))
    open_ = named.drop("groups").join(in_groups(main), ["band", "salt"]).withColumn("left_over", F.col("comp") != F.col("main"))
    left_shingles = F.sum(F.when(F.col("left_over"), F.col("n_shingles")))
    spread = open_.groupBy("band").agg(F.first("groups").alias("groups"), F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"), F.count_if("left_over").alias("n_left"), left_shingles.alias("s_left")).where("n_left > 0")
    in_blocks = lambda n, shingles: F.ceil(F.greatest(F.col(n) / BLOCK, F.col(shingles) / BLOCK_SHINGLES)).cast("int")
    blocks = spread.select("band", "groups", in_blocks("n", "s").alias("of_right"), in_blocks("n_left", "s_left").alias("of_left"))
    rows = open_.drop("groups").join(in_groups(blocks), ["band", "salt"]).join(sigs, "node")
    entry = F.struct("node", "comp", "sig").alias("entry")
    place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    all_blocks = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    left = rows.where("left_over").select("band", "number", place("of_left").alias("i"), all_blocks("of_right").alias("j"), entry).groupBy("band", "number", "i", "j").agg(F.collect_list("entry").alias("left"))
    right = rows.select("band", place("of_right").alias("j"), all_blocks("of_left").alias("i"), entry).groupBy("band", "i", "j").agg(F.collect_list("entry").alias("right"))
    small_batches(spark, 16)  # a row has up to two blocks
    work = written(cross_pairs(left.join(right, ["band", "i", "j"]), plan))
    small_batches(spark, 500)
    links = first.union(confirmed_blocks(work, sets, plan))
    final = components(links)
    named_class = classes.select("digest", "node").join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    found = sig.join(named_class, "digest", "left").select("doc", "n_shingles", F.coalesce("component", "doc").alias("component_id"))
    return found.select(F.col("doc").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("component_id") == F.col("doc"), F.col("component_id").isNull()).alias("kept"))


def in_groups(df: DataFrame) -> DataFrame:
    """A row of ``df`` for each of its ``groups``, numbered by ``salt``."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))


def drop_near_duplicates(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one of the least id.

    Documents without words (also those whose lines an earlier stage has cut out whole) are copies of one another. Of
    repeated rows of one id one stays, whichever Spark takes. Of rows without an id, those whose text another row has
    go, but for one where none of these has an id. An empty table gives an empty result; all columns stay.
    """
    found = written(near_duplicates(docs, plan, id_col, text_col).where(F.col(id_col).isNotNull()).select(id_col, "n_shingles", "kept"))
    first = found.where("n_shingles = 0").agg(F.min(id_col)).first()[0]
    gone = written(found.where(~F.col("kept") | ((F.col("n_shingles") == 0) & (F.col(id_col) > F.lit(first)))).select(id_col).distinct())
    left = docs.join(broadcast_if_small(gone, BROADCAST_ROWS), id_col, "left_anti").select(*docs.columns)
    again = written(docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).where(F.col(id_col).isNull() | (F.col("__n") > 1)).select(id_col))
    if again.limit(1).count() == 0:
        return left
    named = again.where(F.col(id_col).isNotNull())
    once = left.join(broadcast_if_small(named, BROADCAST_ROWS), id_col, "left_anti").where(F.col(id_col).isNotNull())
    repeated = left.join(broadcast_if_small(named, BROADCAST_ROWS), id_col, "left_semi").dropDuplicates([id_col])
    digest = F.when(F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.sha2(F.col(text_col), 256)).otherwise("")
    nameless = left.where(F.col(id_col).isNull()).withColumn("__digest", digest)
    with_id = docs.where(F.col(id_col).isNotNull()).select(digest.alias("__digest")).distinct()
    single = nameless.dropDuplicates(["__digest"]).join(with_id, "__digest", "left_anti")
    return reduce(DataFrame.unionByName, [x.select(*docs.columns) for x in (once, repeated, single)])
