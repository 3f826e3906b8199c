"""Removing passages of several lines that repeat across the corpus.

Lines are hashed, and a rolling hash over neighbouring line hashes chooses where chunks end, so the same passage falls
into the same chunks wherever it stands in a document. As a passage of three lines need not hold a whole chunk, chunks
also overlap: from each line on and up to each line, the fewest lines that are three of some words, or that exceed 50
words, are a chunk too (a window). Every repeated run of at least three lines, or of more than 50 words, is a union of
windows that repeat, so it goes as a whole wherever boundaries fall. Of the chunks that occur earlier too, the fewest
that cover a document's repeated lines are fetched and compared byte by byte with the first one (by document id, then
place); those that are equal to it are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, small_batches, strings, written

#: Rows up to which keys are broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 400_000
#: The same for lists of chunks, by their elements of less than 80 bytes.
BROADCAST_ITEMS = 1_000_000
#: Chunks that meet in one group when their bytes are compared.
FAN = 256
MASK = (1 << 64) - 1


@dataclass(frozen=True)
class Chunking:
    #: A chunk ends after a line where the rolling hash over this many lines ...
    lines: int = 2
    #: ... is a multiple of this number, so chunks have about so many lines.
    divisor: int = 2
    #: A line of so many words is a chunk of its own.
    long_line: int = 40
    #: Chunks of several lines, and of one line, are compared from so many words on.
    least_words: int = 8
    least_words_alone: int = 40
    #: A repeated run of so many lines with the least words, or of any lines with more words than this, goes as a whole.
    window_lines: int = 3
    passage_words: int = 50


def chunk_spans(lines: list[bytes], rule: Chunking) -> list[tuple[int, int, int]]:
    """(first line, number of lines, words) of each chunk that is long enough to be compared."""
    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    words = [len(x.split()) for x in lines]
    found, start, total, roll = [], 0, 0, 0

    def close(stop: int) -> None:
        nonlocal start, total
        n = stop - start
        if total >= (rule.least_words if n > 1 else rule.least_words_alone):
            found.append((start, n, total))
        start, total = stop, 0

    base = 0x9E3779B97F4A7C15
    top = pow(base, rule.lines, 1 << 64)
    for i, h in enumerate(hashes):
        if words[i] >= rule.long_line and i > start:
            close(i)
        total += words[i]
        roll = (roll * base + h) & MASK
        if i >= rule.lines:
            roll = (roll - hashes[i - rule.lines] * top) & MASK
        if words[i] >= rule.long_line or (i + 1 >= rule.lines and (roll >> 24) % rule.divisor == 0):
            close(i + 1)
    if start < len(lines):
        close(len(lines))
    return found


def window_spans(lines: list[bytes], rule: Chunking) -> set[tuple[int, int]]:
    """(first line, number of lines) of the fewest lines that make a window from each line on, and up to each line.

    A window has at least ``window_lines`` lines and ``least_words`` words, or more than ``passage_words`` words. Of a
    longer run, those from its lines on cover all up to the end of the last that fits, and the one up to its end the
    rest. Lines without words neither start nor end a window, and don't count.
    """
    words = [(i, n) for i, n in enumerate(len(x.split()) for x in lines) if n]
    sums = [0, *accumulate(n for _, n in words)]

    def enough(a: int, b: int) -> bool:
        total = sums[b] - sums[a]
        return total > rule.passage_words or (b - a >= rule.window_lines and total >= rule.least_words)

    found, start, stop = set(), 0, 0
    for k in range(len(words)):
        while stop < len(words) and not enough(k, stop):
            stop += 1
        if not enough(k, stop):
            break
        found.add((words[k][0], words[stop - 1][0] + 1 - words[k][0]))
    for k in range(1, len(sums)):
        while enough(start + 1, k):
            start += 1
        if enough(start, k):
            found.add((words[start][0], words[k - 1][0] + 1 - words[start][0]))
    return found


def fewest(spans: list[tuple[int, int]]) -> list[int]:
    """The places in ``spans``, as (first line, line after the last), of the fewest that cover the same lines."""
    taken, best, reach = [], None, 0  # line ``reach`` is the first that ``taken`` doesn't cover
    for k in sorted(range(len(spans)), key=lambda k: spans[k]):
        start, stop = spans[k]
        if start > reach:
            if best is not None:
                taken.append(best)
                reach, best = spans[best][1], None
            reach = max(reach, start)
        if stop > (reach if best is None else spans[best][1]):
            best = k
    return taken if best is None else [*taken, best]


def find_chunks(docs: DataFrame, rule: Chunking, id_col: str, text_col: str) -> DataFrame:
    """(doc, line, n_lines, hash): the windows, and the chunks that are long enough; ``hash`` has 128 bits, of those of the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, first, count, digest = [], [], [], []
            for k, text in enumerate(strings(batch.column(1))):
                lines = text.encode("utf-8", "replace").split(b"\n")
                each = b"".join(map(xxhash.xxh3_128_digest, lines))
                for start, n in window_spans(lines, rule).union(x[:2] for x in chunk_spans(lines, rule)):
                    rows.append(k)
                    first.append(start)
                    count.append(n)
                    digest.append(xxhash.xxh3_128_digest(each[16 * start : 16 * (start + n)]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(digest, pa.binary())], ["doc", "line", "n_lines", "hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col)).where("doc is not null").mapInArrow(run, "doc long, line int, n_lines int, hash binary")


def fetch(docs: DataFrame, id_col: str, text_col: str, asked: DataFrame) -> DataFrame:
    """(doc, line, n_lines, cut, hash, groups, first, data): the bytes of the chunks in ``asked(doc, line, n_lines, cut, hash, groups, first)``."""
    lists = written(asked.groupBy("doc").agg(F.collect_list(F.struct("line", "n_lines", "cut", "hash", "groups", "first")).alias("chunks")))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    wide = texts.join(broadcast_if_small(lists, BROADCAST_ITEMS, "chunks"), "doc").select("doc", "text", "chunks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chunks, data = [], [], []
            for k, (text, asked_) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                lines = text.encode("utf-8", "replace").split(b"\n")
                for c in asked_:
                    if c["line"] + c["n_lines"] <= len(lines):
                        rows.append(k)
                        chunks.append(c)
                        data.append(b"\n".join(lines[c["line"] : c["line"] + c["n_lines"]]))
            column = lambda name, kind: pa.array([c[name] for c in chunks], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), column("line", pa.int32()), column("n_lines", pa.int32()), column("cut", pa.int32()), column("hash", pa.binary()), column("groups", pa.int32()), column("first", pa.bool_()), pa.array(data, pa.binary())],
                ["doc", "line", "n_lines", "cut", "hash", "groups", "first", "data"],
            )

    return wide.mapInArrow(run, "doc long, line int, n_lines int, cut int, hash binary, groups int, first boolean, data binary")


def cover(later: DataFrame) -> DataFrame:
    """(doc, line, n_lines, hash, head, cut): of ``later(doc, line, n_lines, hash, head)`` the fewest that cover a document's repeated lines.

    ``cut`` is the first line that may go: lines which the first occurrence in the same document has as well stay.
    """
    cut = F.when(F.col("head.doc") == F.col("doc"), F.greatest("line", F.col("head.line") + F.col("head.n_lines"))).otherwise(F.col("line"))
    lists = later.groupBy("doc").agg(F.collect_list(F.struct(cut.alias("cut"), (F.col("line") + F.col("n_lines")).alias("stop"), F.struct("line", "n_lines", "hash", "head").alias("chunk"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            inner, rows, taken, at = column.flatten(), [], [], 0
            spans = list(zip(inner.field("cut").to_pylist(), inner.field("stop").to_pylist(), strict=True))
            for k, n in enumerate(pc.list_value_length(column).to_pylist()):
                found = fewest(spans[at : at + n])
                rows += [k] * len(found)
                taken += [at + i for i in found]
                at += n
            inner = inner.take(pa.array(taken, pa.int64()))
            chunk = inner.field("chunk")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(chunk.field(c) for c in ("line", "n_lines", "hash", "head")), inner.field("cut")], ["doc", "line", "n_lines", "hash", "head", "cut"])

    return lists.mapInArrow(run, "doc long, line int, n_lines int, hash binary, head struct<doc:long,line:int,n_lines:int>, cut int")


def repeated_chunks(docs: DataFrame, rule: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, line, n_lines): runs of lines whose bytes occur earlier in the corpus. Rows with one id count as one document."""
    small_batches(docs.sparkSession)
    chunks = written(find_chunks(docs, rule, id_col, text_col))
    # The counts are pre-aggregated before the shuffle, so a chunk with very many copies is no hot key here.
    groups = chunks.groupBy("hash").agg(F.min(F.struct("doc", "line", "n_lines")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = chunks.join(broadcast_if_small(written(groups.select("hash", "head")), BROADCAST_ROWS), "hash")
    picks = written(cover(keyed.where((F.col("doc") != F.col("head.doc")) | (F.col("line") != F.col("head.line")))))
    used = written(picks.groupBy("hash").agg(F.min("head").alias("head"), F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("groups")))
    mine = picks.join(broadcast_if_small(used.select("hash", "groups"), BROADCAST_ROWS), "hash").select("doc", "line", "n_lines", "cut", "hash", "groups", F.lit(False).alias("first"))
    asked = mine.unionByName(used.select("head.doc", "head.line", "head.n_lines", F.col("head.line").alias("cut"), "hash", "groups", F.lit(True).alias("first")))
    got = written(fetch(docs, id_col, text_col, asked))
    heads = got.where("first").dropDuplicates(["hash"]).select("hash", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.col("data").alias("head_data"))
    later = got.where("not first").withColumn("salt", F.pmod(F.xxhash64("doc", "line"), F.col("groups")).cast("int"))
    equal = later.join(heads, ["hash", "salt"]).where("data = head_data").select("doc", "line", "n_lines", "cut")
    return equal.select("doc", F.col("cut").alias("line"), (F.col("line") + F.col("n_lines") - F.col("cut")).alias("n_lines")).distinct()


def dedup_lines(docs: DataFrame, rule: Chunking = Chunking(), id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with the repeated chunks cut out of the text; all other columns stay, and so does the order of the lines.

    The first occurrence of a chunk stays. With ``report``, returns (id, n_lines, n_removed_lines, text) instead. A
    null text stays null and counts no lines; a text whose lines all repeat becomes empty; repeated rows of one id are
    one document and are cut alike; ids are whole numbers; rows without an id are neither cut nor compared; an empty
    table gives an empty result.
    """
    gone = repeated_chunks(docs, rule, id_col, text_col).groupBy("doc").agg(F.collect_list(F.struct("line", "n_lines")).alias("spans"))
    mark, spans = "__removed_doc", "__removed_spans"
    wide = docs.join(broadcast_if_small(written(gone.select(F.col("doc").alias(mark), F.col("spans").alias(spans))), BROADCAST_ITEMS, spans), F.col(id_col).cast("long") == F.col(mark), "left").drop(mark)
    numbers = F.array_distinct(F.flatten(F.transform(F.coalesce(F.col(spans), F.expr("cast(array() as array<struct<line:int,n_lines:int>>)")), lambda s: F.sequence(s["line"], s["line"] + s["n_lines"] - 1))))  # spans can overlap
    lines = F.split(F.col(text_col), "\n", -1)
    kept = F.when(F.col(spans).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(numbers, i)), "\n"))
    if report:
        return wide.select(F.col(id_col), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(numbers)).cast("long").alias("n_removed_lines"), kept.alias(text_col))
    return wide.select(*[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns])
