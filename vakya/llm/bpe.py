"""Byte-level BPE over a corpus: merges replayed in rank order over all distinct words at once.

``MergeTable.encode`` holds the distinct words of a part of the corpus as one array of symbols with links to their
neighbours, and an inverted index from each mergeable token pair to its positions in the words. Merges are taken in
rank order; each is applied to all its positions together, and only the pairs of the touched neighbours are looked up
again and entered in the index. A part of the corpus is what one task has read, so no word is shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, strings
from .pieces import PieceIndex, spread

#: Text bytes that are encoded together; a longer text is encoded whole.
PART_BYTES = 6 << 20
#: Up to so many positions are merged one by one.
FEW = 12


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token -> rank, from lines of a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class MergeTable:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.none = max(ranks.values()) + 1
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs: dict[int, int] = {}
        #: Tokens that can form a pair of a lower rank than their own: their merges are taken one for each word at a time.
        self.early: set[int] = set()
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
                    self.early.update(x for x in (a, b) if x > rank)
        keys = np.array(sorted(pairs), np.int64)
        self.pairs = pairs
        # An open-addressed table: a pair is found in few probes, for many pairs at once.
        self.bits = max(4, int(4 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, self.none, np.int64)
        left, self.probes = keys, 0
        place = self._place(keys)
        while len(left):
            self.probes += 1
            free = self.slots[place] < 0
            at, first = np.unique(np.where(free, place, -1), return_index=True)
            at, first = at[at >= 0], first[at >= 0]
            self.slots[at] = left[first]
            self.values[at] = [pairs[k] for k in left[first].tolist()]
            rest = self.slots[place] != left
            left, place = left[rest], (place[rest] + 1) & ((1 << self.bits) - 1)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) << 32 | b
        place = self._place(keys)
        found = np.full(len(keys), self.none, np.int64)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            slot = self.slots[place]
            hit = slot == keys
            found[todo[hit]] = self.values[place[hit]]
            go = ~hit & (slot >= 0)
            if not go.any():
                break
            todo, keys, place = todo[go], keys[go], (place[go] + 1) & ((1 << self.bits) - 1)
        return found

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words one after another, their number for each word)."""
        whole = [self.ranks.get(w) for w in words]
        open_words = [i for i, w in enumerate(whole) if w is None and words[i]]
        counts = np.array([int(w is not None) for w in whole], np.int64)
        ids, lengths = self._replay([words[i] for i in open_words])
        counts[open_words] = lengths
        out = np.empty(int(counts.sum()), np.int64)
        known = np.repeat(np.array([w is not None for w in whole], bool), counts)
        out[known] = [w for w in whole if w is not None]
        out[~known] = ids
        return out, counts

    def _replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(w) for w in words], np.int64)
        n = int(sizes.sum())
        if not n:
            return np.empty(0, np.int64), sizes
        token = self.byte_id[np.frombuffer(b"".join(words), np.uint8)].astype(np.int32)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        last = np.cumsum(sizes) - 1
        after[last] = -1
        before[last[:-1] + 1] = -1
        rank = np.full(n, self.none, np.int32)
        inner = np.flatnonzero(after >= 0)
        rank[inner] = self.pair_ranks(token[inner], token[inner + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(ranks: np.ndarray, places: np.ndarray) -> None:
            good = ranks < self.none
            ranks, places = ranks[good], places[good]
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, p in zip(ranks[np.r_[0, cuts]].tolist() if len(ranks) else [], np.split(places, cuts), strict=False):
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(p)

        def enter_one(r: int, place: int) -> None:
            if r < self.none:
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(np.array([place]))

        enter(rank, np.arange(n, dtype=np.int32))
        none, pairs = self.none, self.pairs
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            places = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            places = places[rank[places] == r]
            if len(places) == 0:
                continue
            if len(places) <= FEW and r not in self.early:
                for p in places.tolist():
                    if rank[p] != r:  # its first half went into the merge before
                        continue
                    j = int(after[p])
                    k = int(after[j])
                    token[p], after[p], rank[j], token[j] = r, k, none, -1
                    rank[p] = none
                    if k >= 0:
                        before[k] = p
                        rank[p] = x = pairs.get(r << 32 | int(token[k]), none)
                        enter_one(x, p)
                    q = int(before[p])
                    if q >= 0:
                        rank[q] = x = pairs.get(int(token[q]) << 32 | r, none)
                        enter_one(x, q)
                continue
            if r in self.early:
                first = np.r_[True, word[places[1:]] != word[places[:-1]]]
                if not first.all():
                    enter(rank[places[~first]], places[~first])
                places = places[first]
            else:  # of pairs that overlap, every second one is merged, from the left
                chained = np.r_[False, after[places[:-1]] == places[1:]]
                if chained.any():
                    at = np.arange(len(places))
                    start = np.maximum.accumulate(np.where(chained, 0, at))
                    places = places[(at - start) % 2 == 0]
            gone = after[places]
            then = after[gone]
            token[places], after[places], rank[gone], token[gone] = r, then, none, -1
            there = then >= 0
            before[then[there]] = places[there]
            left = before[places]
            touched = np.unique(np.concatenate([places, left[left >= 0]]))
            right = after[touched]
            fresh = np.full(len(touched), none, np.int64)
            has = right >= 0
            fresh[has] = self.pair_ranks(token[touched[has]], token[right[has]])
            rank[touched] = fresh
            enter(fresh, touched)
        alive = token >= 0
        return token[alive], np.bincount(word[alive], minlength=len(words))


class TokenBytes:
    """The bytes of each token."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.start, self.length = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.data = np.frombuffer(b"".join(ranks), np.uint8)
        at = 0
        for token, rank in ranks.items():
            self.start[rank], self.length[rank] = at, len(token)
            at += len(token)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.data[spread(self.start[ids], self.length[ids])].tobytes()


def encode_texts(texts: list[str], merges: MergeTable, pattern: regex.Pattern) -> Iterator[np.ndarray]:
    """The ids of each text; the distinct words of all of them are merged together."""
    index = PieceIndex()
    numbers = [np.array(index.number(x), np.int32) for x in texts]
    words: dict[str, int] = {}
    word_of: list[int] = []
    in_piece = []
    for piece in index.strings():
        found = pattern.findall(piece)
        in_piece.append(len(found))
        word_of += [words.setdefault(w, len(words)) for w in found]
    ids, counts = merges.encode([w.encode("utf-8", "replace") for w in words])
    starts = np.cumsum(counts) - counts
    word_of_, in_piece_ = np.array(word_of, np.int64), np.array(in_piece, np.int64)
    flat = ids[spread(starts[word_of_], counts[word_of_])]
    upto = np.r_[0, np.cumsum(counts[word_of_])]
    piece_end = np.cumsum(in_piece_)
    piece_start = upto[piece_end - in_piece_] if len(piece_end) else piece_end
    piece_count = upto[piece_end] - piece_start if len(piece_end) else piece_end
    for number in numbers:
        yield flat[spread(piece_start[number], piece_count[number])].astype("<u4")


def encode_corpus(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(id, ids): for each row the token ids of its whole text, as little-endian unsigned 32-bit numbers in a binary.

    A null text is the empty text and has no ids; equal texts have equal ids; repeated rows each get a row; an empty
    table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    with open(ranks_path, "rb") as f:  # a vocabulary: its size doesn't depend on the data
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, split = MergeTable(read_ranks(data.value)), regex.compile(pattern)

        def encoded(part: list[tuple[pa.Array, list[str]]]) -> Iterator[pa.RecordBatch]:
            ids = encode_texts([x for _, texts in part for x in texts], merges, split)
            for keys, texts in part:
                yield pa.RecordBatch.from_arrays([keys, pa.array([next(ids).tobytes() for _ in texts], pa.binary())], [id_col, "ids"])

        part, size = [], 0
        for batch in batches:
            part.append((batch.column(0), strings(batch.column(1))))
            size += batch.column(1).nbytes
            if size >= part_bytes:
                yield from encoded(part)
                part, size = [], 0
        yield from encoded(part)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids binary")


def decode_corpus(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, data): adds the bytes that the ids stand for; null ids stand for none."""
    with open(ranks_path, "rb") as f:
        data = encoded.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = TokenBytes(read_ranks(data.value))
        for batch in batches:
            found = [tokens.decode(np.frombuffer(x or b"", "<u4")) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], [id_col, "ids", "data"])

    return encoded.select(F.col(id_col), F.col("ids")).mapInArrow(run, f"`{id_col}` {kind}, ids binary, data binary")
