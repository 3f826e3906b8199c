"""Quality rules with compression bands.

A document is measured once, in one pass without a shuffle: word and symbol counts, repeated lines and word windows,
and the zstandard ratio (raw bytes over compressed bytes) of the whole text and of each fixed chunk of it. Text that
compresses far better than prose of its length is repetitive, text that hardly compresses is noise; the limits depend
on the length, as a short text has less to refer back to.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SYMBOLS = b"#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, zstd_ratio double, n_chunks long, n_bad_chunks long"


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio: ``limits`` has (bytes below, least ratio, greatest ratio) in order of length."""

    limits: tuple[tuple[float, float, float], ...] = (
        (256, 0.9, 3.0),
        (1024, 1.1, 3.2),
        (4096, 1.15, 3.6),
        (16384, 1.2, 4.2),
        (float("inf"), 1.25, 5.0),
    )
    chunk_bytes: int = 4096
    #: A last chunk that is shorter is judged with the one before it.
    least_chunk: int = 1024
    #: More than this share of bad chunks rejects a document.
    bad_chunk_share: float = 0.5
    level: int = 3

    def inside(self, n_bytes: int, ratio: float) -> bool:
        for below, least, most in self.limits:
            if n_bytes < below:
                return least <= ratio <= most
        return True


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    marks = bytearray(len(words))
    for i, window in enumerate(windows):
        if found[window] > 1:
            marks[i : i + 3] = b"\1\1\1"
    return sum(marks)


def chunks(data: bytes, size: int, least: int) -> list[bytes]:
    cut = [data[i : i + size] for i in range(0, len(data), size)]
    if len(cut) > 1 and len(cut[-1]) < least:
        cut[-2:] = [cut[-2] + cut[-1]]
    return cut


def measure(text: str | None, bands: Bands, pack: zstandard.ZstdCompressor) -> tuple:
    """The values of FIELDS for one text; null counts as the empty text."""
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    in_words = sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = repeat_words(words)
    failed = len(words) < 50 or 100 * repeated > 50 * len(words)
    ratio, cut, bad = 0.0, [], 0
    if data:
        ratio = len(data) / len(pack.compress(data))
        cut = chunks(data, bands.chunk_bytes, bands.least_chunk)
        bad = (
            sum(not bands.inside(len(x), len(x) / len(pack.compress(x))) for x in cut)
            if len(cut) > 1
            else int(not bands.inside(len(data), ratio))
        )
    kept = not failed and bands.inside(len(data), ratio) and bad <= bands.bad_chunk_share * len(cut)
    return (
        len(words),
        len(text) - (len(data) - in_words),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        failed,
        kept,
        ratio,
        len(cut),
        bad,
    )


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row for each input row: the id, the counts, ``base_failed`` and ``kept``.

    Null and empty texts have no words, so they fail the base rule; repeated rows each get a row; an empty table gives
    an empty result; columns other than the two named are ignored.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = [measure(x, bands, pack) for x in batch.column(1).to_pylist()]
            columns = [pa.array(list(x)) for x in zip(*rows, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    names = [id_col, *(x.split()[0] for x in FIELDS.split(", "))]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, {FIELDS}")


def keep_quality(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, in one pass."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            yield batch.filter(pa.array([measure(x, bands, pack)[6] for x in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
