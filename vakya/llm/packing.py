"""Mixture-controlled packing of token ids into sequences of one length.

Each source is a queue of documents in storage order. A window gives every queue a quantum of tokens in proportion to
its target; what a queue may not send yet, whole or in part, waits as a deficit for the next window, so the served
total of each queue stays within one token of its target until it runs dry, and the others go on (deficit round-robin
with free cuts). As quanta are rational numbers, the window and the place of any token follow from its place in its
queue by whole-number arithmetic: each task places its own documents, and the deficits carry over the bounds of tasks
and partitions without a sequential pass. The served tokens form one stream that is cut at the sequence length, so
only the last sequence is padded.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from .common import broadcast_if_small, small_batches, written
from .pieces import spread

#: Distinct pieces that a Python worker remembers.
CACHE = 600_000
#: Pieces that are encoded in one call.
TOGETHER = 64
#: How this kind of vocabulary writes a space and a line feed.
SPACE, LINE_FEED = "Ġ", "Ċ"
#: Stands before marks that were cut from a word; a text that has it is encoded whole.
MARK = "\x01"
BEFORE_LINE_FEEDS = r"\n(\S)", " \n\\1"
BEFORE_MARKS = r"(\pL)([.,;:!?)\]#$%&*]+)( |$)", rf"\1 {MARK}\2\3"
#: A piece that starts with white space (but for one line feed before something else), or is empty.
UNSAFE = r"^(?:$|[^\S\n]|[\x0b\x1c-\x1f\x{85}\pZ]|\n(?:$|[\s\x0b\x1c-\x1f\x{85}\pZ]))"
#: Rows of (block, queue) up to which they are broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 200_000
#: Sources beyond this number share queues by hash, so that the plan of queues is bounded; those with a target never do.
QUEUES = 65_536
TARGETS = 65_536


@dataclass(frozen=True)
class Queue:
    name: str
    tokens: int
    weight: int


class Schedule:
    """Where a token of a queue goes; all queues, in order of their names."""

    def __init__(self, queues: list[Queue], window: int) -> None:
        self.queues, self.window = queues, window
        self.number = {q.name: i for i, q in enumerate(queues)}
        self.total = sum(q.weight for q in queues) or 1
        self.near: dict[int, tuple[list[int], list[int]]] = {}

    def sent(self, queue: Queue, windows: int) -> int:
        """Tokens that a queue has sent when so many windows are full."""
        return min(queue.tokens, windows * self.window * queue.weight // self.total)

    def window_of(self, i: int, place: int) -> int:
        share = self.window * self.queues[i].weight
        return -(-(place + 1) * self.total // share) - 1

    def bounds(self, window: int) -> tuple[list[int], list[int]]:
        """For each queue: the place in the stream where its part of the window starts, and what it had sent before."""
        if window not in self.near:
            if len(self.near) > 64:
                self.near.clear()
            before = [self.sent(q, window) for q in self.queues]
            after = [self.sent(q, window + 1) for q in self.queues]
            at, starts = sum(before), []
            for a, b in zip(before, after, strict=True):
                starts.append(at)
                at += b - a
            self.near[window] = starts, before
        return self.near[window]

    def runs(self, i: int, place: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(offset in the document, place in the stream, length) of a document's parts, window by window."""
        done = 0
        while done < length:
            window = self.window_of(i, place + done)
            starts, before = self.bounds(window)
            n = min(length - done, self.sent(self.queues[i], window + 1) - place - done)
            yield done, starts[i] + place + done - before[i], n
            done += n


class PieceCache:
    """Encodes texts by their pieces, each distinct piece of a batch once, and as long as it is remembered only once.

    Texts are cut before each space, before each line feed that no white space follows, and before the marks that end a
    word, as such a tokenizer never joins these with what stands before. New pieces are encoded many in one call, as one
    text: each starts with a space (or a line feed) and has no other, so the tokens that do so show where one ends.
    """

    def __init__(self, tokenizer: Tokenizer, kind: str) -> None:
        self.tokenizer, self.kind = tokenizer, kind
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.opens = {x: np.zeros(tokenizer.get_vocab_size(), bool) for x in (SPACE, LINE_FEED)}
        for token, i in tokenizer.get_vocab().items():
            for x in self.opens:
                self.opens[x][i] = token.startswith(x)
        #: The pieces, and where the ids of each are.
        self.known, self.starts, self.sizes, self.ids = pa.array([], pa.large_string()), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, pieces: list[str], lead: str) -> Iterator[np.ndarray]:
        """The ids of pieces that all start with a line feed, or that all follow a space."""
        joiner = " " if lead == SPACE else ""
        joined = [joiner + joiner.join(pieces[i : i + TOGETHER]) for i in range(0, len(pieces), TOGETHER)]
        ids = np.fromiter(chain.from_iterable(self._ids(joined)), self.kind)
        for a, b in pairwise([*np.flatnonzero(self.opens[lead][ids]).tolist(), len(ids)]):
            yield ids[a:b]

    def _learn(self, pieces: list[str]) -> None:
        kinds: dict[str, list[str]] = {SPACE: [], LINE_FEED: [], "": []}
        for x in pieces:
            kinds["" if x[0] == MARK or (x[0] == "\n" and "\n" in x[1:]) else LINE_FEED if x[0] == "\n" else SPACE].append(x)
        alone = kinds.pop("")
        found = [y for lead, part in kinds.items() for y in self._encoded(part, lead)] + [np.array(x, self.kind) for x in self._ids([x.removeprefix(MARK) for x in alone])]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.ids = np.concatenate([self.ids, *found])
        self.known = pa.concat_arrays([self.known, pa.array([*kinds[SPACE], *kinds[LINE_FEED], *alone], pa.large_string())])

    def _keep(self, places: np.ndarray) -> None:
        self.ids = self.ids[spread(self.starts[places], self.sizes[places])]
        self.sizes = self.sizes[places]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known = self.known.take(pa.array(places))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, without special tokens being added; null counts as the empty text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for x in (MARK, *self.special):
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        cut = pc.replace_substring_regex(pc.replace_substring_regex(texts, *BEFORE_LINE_FEEDS), *BEFORE_MARKS)
        split = pc.split_pattern(cut, " ")
        parts = split.flatten().dictionary_encode()
        pieces, numbers = parts.dictionary, parts.indices.to_numpy()
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False)).astype(np.int64)
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        # A text is encoded whole if a space stands before white space or its end, or if it names a special token.
        unsafe = pc.match_substring_regex(pieces, UNSAFE).to_numpy(zero_copy_only=False)
        odd = np.r_[0, np.cumsum(unsafe[numbers])]
        whole |= odd[ends] > odd[np.minimum(starts + 1, ends)]
        tail = np.repeat(~whole, ends - starts)
        tail[starts] = False
        used = np.zeros(len(pieces), bool)
        used[numbers[tail]] = True
        wanted = pieces.filter(pa.array(used))
        place = pc.fill_null(pc.index_in(wanted, value_set=self.known), -1).to_numpy()
        if len(self.known) + np.count_nonzero(place < 0) > CACHE:
            self._keep(place[place >= 0])
        if (place < 0).any():
            self._learn(wanted.filter(pa.array(place < 0)).to_pylist())
            place = pc.index_in(wanted, value_set=self.known).to_numpy()
        at = np.zeros(len(pieces), np.int64)
        at[used] = place
        flat = at[numbers[tail]]
        sizes = np.zeros(len(numbers), np.int64)
        sizes[tail] = self.sizes[flat]
        ids = self.ids[spread(self.starts[flat], self.sizes[flat])]
        upto = np.r_[0, np.cumsum(sizes)]
        whole_texts, heads = texts.filter(pa.array(whole)).to_pylist(), pieces.take(pa.array(numbers[starts[~whole]])).to_pylist()
        others, first = iter(self._ids(whole_texts)), iter(self._ids(heads))
        return [np.array(next(others), self.kind).tobytes() if w else np.array(next(first), self.kind).tobytes() + ids[a:b].tobytes() for w, a, b in zip(whole.tolist(), upto[starts].tolist(), upto[ends].tolist(), strict=True)]


def queue_column(docs: DataFrame, source_col: str, targets: dict[str, int]) -> Column:
    """The queue of a row: its source (null: the empty name). Beyond ``QUEUES`` sources, those without a target share queues by hash."""
    if source_col not in docs.columns:
        return F.lit("")
    queue = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if docs.select(source_col).distinct().limit(QUEUES + 1).count() <= QUEUES:
        return queue
    if len(targets) > TARGETS or any(x.startswith("\0") for x in targets):
        raise ValueError("too many targets, or one whose name starts with a zero character")
    shared = F.concat(F.lit("\0"), F.pmod(F.xxhash64(queue), F.lit(QUEUES)).cast("string"))
    return F.when(queue.isin(list(targets)), queue).otherwise(shared) if targets else shared


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str, int] | None = None) -> DataFrame:
    """(id, queue, block, place, doc_tokens, ids): ids of whole texts and the end id; ``place`` counts the tokens of the queue before the document in its block (what one task read)."""
    spark = docs.sparkSession
    small_batches(spark, 2000)
    with open(tokenizer_path, "rb") as f:  # a vocabulary: its size doesn't depend on the data
        data = spark.sparkContext.broadcast(f.read())
    kind = "<u2" if Tokenizer.from_buffer(data.value).get_vocab_size() <= 1 << 16 > end_id else "<u4"
    queue = queue_column(docs, source_col, targets or {})
    names = [id_col, "queue", "block", "place", "doc_tokens", "ids"]
    id_kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache(data.value, kind)
        end = np.array([end_id], kind).tobytes()
        block = TaskContext.get().partitionId()
        sent: dict[str, int] = {}
        for batch in batches:
            queues, places, counts, ids = batch.column(1).to_pylist(), [], [], []
            for name, found in zip(queues, cache.encode(batch.column(2)), strict=True):
                n = len(found) // len(end) + 1
                places.append(sent.get(name, 0))
                sent[name] = places[-1] + n
                counts.append(n)
                ids.append(found + end)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([block] * len(ids), pa.int64()), pa.array(places, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())], names)

    return docs.select(F.col(id_col), queue.alias("queue"), F.col(text_col)).mapInArrow(run, f"`{id_col}` {id_kind}, queue string, block long, place long, doc_tokens long, ids binary")


_CACHES: dict[tuple[int, str], PieceCache] = {}


def worker_cache(data: bytes, kind: str) -> PieceCache:
    """The cache of this Python worker, which outlives its tasks."""
    key = (zlib.crc32(data), kind)
    if key not in _CACHES:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker for each core
        _CACHES.clear()
        _CACHES[key] = PieceCache(Tokenizer.from_buffer(data), kind)
    return _CACHES[key]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 1,
    length: int = 2048,
    window: int = 64 * 2048,
    targets: dict[str, int] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents and their places in sequences of ``length`` tokens.

    Returns for each piece the id, ``start`` (tokens of the document before it), ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` and ``queue``; with ``with_ids`` also ``ids`` (little-endian unsigned 32
    bits). ``targets`` are whole-number weights of the sources (one not named, and by default each: its token count).
    Ids are the library's with its defaults, so the name of a special token in a text is that token.
    A null text is the empty text, which leaves its end id; a null source is the queue of the empty name; repeated rows
    are packed as often as they occur; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    tokens = written(tokenize(docs, tokenizer_path, end_id, id_col, text_col, source_col, targets))
    blocks = written(tokens.groupBy("queue", "block").agg(F.sum("doc_tokens").alias("n")))
    totals = blocks.groupBy("queue").agg(F.sum("n").alias("n")).collect()
    # At most QUEUES hashed ones and TARGETS others.
    queues = [Queue(r.queue, r.n, (targets or {}).get(r.queue, r.n)) for r in sorted(totals, key=lambda r: r.queue)]
    if any(q.weight <= 0 for q in queues):
        raise ValueError("targets must be positive")
    ahead = W.partitionBy("queue").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("queue", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    placed = tokens.join(broadcast_if_small(starts, BROADCAST_ROWS), ["queue", "block"])
    plan = spark.sparkContext.broadcast([(q.name, q.tokens, q.weight) for q in queues])
    id_kind = dict(docs.dtypes)[id_col]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"]
    fields = f"`{id_col}` {id_kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule([Queue(*x) for x in plan.value], window)
        for batch in batches:
            found: list[list] = [[] for _ in range(7 + with_ids)]
            rows, n_rows = [], batch.num_rows
            for k, (name, place, n, raw) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                for start, stream, size in schedule.runs(schedule.number[name], place, n):
                    while size:
                        offset = stream % length
                        m = min(size, length - offset)
                        piece = ids[start : start + m].tobytes()
                        rows.append(k)
                        for column, value in zip(found, (start, m, zlib.crc32(piece), n, stream // length, offset, name, piece), strict=False):
                            column.append(value)
                        start, stream, size = start + m, stream + m, size - m
            if n_rows:
                kinds = [pa.int64()] * 6 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, t) for x, t in zip(found, kinds, strict=False))], [*names, "ids"][: 8 + with_ids])

    return placed.select(F.col(id_col), "queue", (F.col("place") + F.col("ahead")).alias("place"), "doc_tokens", "ids").mapInArrow(run, fields)
