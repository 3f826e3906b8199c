"""Media columns: storing payloads as audio samples, and signature sniffing of stored blobs.

``store_payload`` wraps bytes losslessly as 8-bit mono samples with Spark's own functions. ``sniff_media`` reads blobs
back: an Aho-Corasick automaton finds the magic bytes of all known formats in one scan, a validator for each format
walks its structure and lengths, and what passes corrects the declared type and is carved out of the blob.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches

UNIT = 192
RATE = 8000

# Fixed values: (magic bytes, media type, offset of the magic in the object).
MAGIC = (
    (b"RIFF", "audio/wav", 0),
    (b"\x89PNG\r\n\x1a\n", "image/png", 0),
    (b"GIF87a", "image/gif", 0),
    (b"GIF89a", "image/gif", 0),
    (b"\xff\xd8\xff", "image/jpeg", 0),
    (b"BM", "image/bmp", 0),
    (b"fLaC", "audio/flac", 0),
    (b"OggS", "audio/ogg", 0),
    (b"%PDF-", "application/pdf", 0),
    (b"PK\x03\x04", "application/zip", 0),
    (b"ftyp", "video/mp4", 4),
)


class Blob(bytes):
    """Bytes that find marks by a list of their places, made in one pass, so many starts cost no more than one."""

    def _places(self, mark: bytes) -> list[int]:
        known = self.__dict__.setdefault("known", {})
        if mark not in known:
            found, at = [], self.find(mark)
            while at >= 0:
                found.append(at)
                at = self.find(mark, at + 1)
            known[mark] = found
        return known[mark]

    def following(self, mark: bytes, at: int) -> int:
        """The first place of a mark from ``at`` on, or -1."""
        places = self._places(mark)
        i = bisect_left(places, at)
        return places[i] if i < len(places) else -1

    def between(self, mark: bytes, at: int, end: int) -> bool:
        """Whether a mark lies between two places."""
        place = self.following(mark, at)
        return 0 <= place <= end - len(mark)


def riff_end(b: bytes, at: int) -> int | None:
    """WAVE: the chunk lengths must add up to the RIFF length, with one fmt and one data chunk."""
    if len(b) < at + 44 or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if end > len(b):
        return None
    place, seen = at + 12, set()
    while place + 8 <= end:
        kind, size = b[place : place + 4], int.from_bytes(b[place + 4 : place + 8], "little")
        if place + 8 + size > end:
            return None
        seen.add(kind)
        place += 8 + size + size % 2
    return end if place >= end and {b"fmt ", b"data"} <= seen else None


def png_end(b: bytes, at: int) -> int | None:
    """PNG: chunk checksums must hold from IHDR to IEND."""
    place = at + 8
    if b[place + 4 : place + 8] != b"IHDR":
        return None
    while place + 12 <= len(b):
        size = int.from_bytes(b[place : place + 4], "big")
        stop = place + 12 + size
        if stop > len(b) or zlib.crc32(b[place + 4 : stop - 4]) != int.from_bytes(b[stop - 4 : stop], "big"):
            return None
        if b[place + 4 : place + 8] == b"IEND":
            return stop
        place = stop
    return None


def gif_end(b: bytes, at: int) -> int | None:
    """GIF: blocks and sub-blocks must lead to the trailer."""
    if len(b) < at + 13:
        return None
    place = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)
    images = 0
    while place < len(b):
        if b[place] == 0x3B:
            return place + 1 if images else None
        if b[place] == 0x2C and place + 10 < len(b):
            flags = b[place + 9]
            place += 11 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
            images += 1
        elif b[place] == 0x21:
            place += 2
        else:
            return None
        while place < len(b) and b[place]:
            place += b[place] + 1
        place += 1
    return None


def jpeg_end(b: Blob, at: int) -> int | None:
    """JPEG: segment lengths must lead to a scan that ends in EOI."""
    place = at + 2
    while place + 4 <= len(b) and b[place] == 0xFF:
        mark = b[place + 1]
        if mark == 0xD9:
            return None
        size = int.from_bytes(b[place + 2 : place + 4], "big")
        if size < 2:
            return None
        place += 2 + size
        if mark == 0xDA:
            end = b.following(b"\xff\xd9", place)
            return end + 2 if end >= 0 else None
    return None


def bmp_end(b: bytes, at: int) -> int | None:
    """BMP: file size, pixel offset, header size and image size must agree."""
    if len(b) < at + 54:
        return None
    size, _, offset, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or header not in (40, 52, 56, 108, 124) or width <= 0 or not height:
        return None
    row = (width * bits + 31) // 32 * 4
    return at + size if 14 + header <= offset and offset + row * abs(height) <= size <= len(b) - at else None


def flac_end(b: bytes, at: int) -> int | None:
    """FLAC: metadata blocks from STREAMINFO to the last one, then a frame; the stream reaches to the end."""
    place = at + 4
    if len(b) < at + 8 or b[place] & 0x7F or int.from_bytes(b[place + 1 : place + 4], "big") != 34:
        return None
    while place + 4 <= len(b):
        last, size = b[place] & 0x80, int.from_bytes(b[place + 1 : place + 4], "big")
        place += 4 + size
        if last:
            return len(b) if b[place : place + 1] == b"\xff" and b[place + 1 : place + 2] and b[place + 1] & 0xFC == 0xF8 else None
    return None


def ogg_end(b: bytes, at: int) -> int | None:
    """Ogg: pages follow one another by their segment tables, up to one that ends the stream."""
    place = at
    while b[place : place + 4] == b"OggS" and place + 27 <= len(b) and b[place + 4] == 0:
        n = b[place + 26]
        stop = place + 27 + n + sum(b[place + 27 : place + 27 + n])
        if stop > len(b):
            return None
        if b[place + 5] & 4:
            return stop
        place = stop
    return None


def pdf_end(b: Blob, at: int) -> int | None:
    """PDF: a version number and a later end mark after a cross-reference pointer."""
    if not b[at + 5 : at + 6].isdigit():
        return None
    end = b.following(b"%%EOF", at)
    return end + 5 if end >= 0 and b.between(b"startxref", at, end) else None


def zip_end(b: Blob, at: int) -> int | None:
    """ZIP: the end record's directory must lie just before it and start with a directory entry."""
    end = b.following(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return None
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    stop = end + 22 + note
    return stop if at + start + size == end and b[at + start : at + start + 4] == b"PK\x01\x02" and stop <= len(b) else None


def mp4_end(b: bytes, at: int) -> int | None:
    """MP4: top-level boxes from ftyp on, with moov or moof among them."""
    place, seen = at, set()
    while place + 8 <= len(b):
        size, kind = int.from_bytes(b[place : place + 4], "big"), b[place + 4 : place + 8]
        if size < 8 or place + size > len(b) or not kind.isalnum():
            break
        seen.add(kind)
        place += size
    return place if {b"moov", b"moof"} & seen else None


VALIDATORS: dict[str, Callable[[Blob, int], int | None]] = {
    "audio/wav": riff_end, "image/png": png_end, "image/gif": gif_end, "image/jpeg": jpeg_end, "image/bmp": bmp_end, "audio/flac": flac_end,
    "audio/ogg": ogg_end, "application/pdf": pdf_end, "application/zip": zip_end, "video/mp4": mp4_end,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for magic, kind, shift in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), kind, shift))
    found.make_automaton()
    return found


def carve(blob: bytes, magics: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, type) of each object whose structure holds: the one that starts the blob, then those inside or after it."""
    found, inner_from, marked = [], 0, Blob(blob)
    for last, (size, kind, shift) in magics.iter(blob.decode("latin-1")):
        start = last - size + 1 - shift
        if start < 0 or (start < inner_from and found):
            continue
        end = VALIDATORS[kind](marked, start)
        if end is not None:
            found.append((start, end, kind))
            inner_from = end if start else 1
    return found


def wav_samples(blob: bytes, start: int, end: int) -> tuple[int, int]:
    """Start and length of the data chunk of a sound WAVE object."""
    place = start + 12
    while place + 8 <= end:
        size = int.from_bytes(blob[place + 4 : place + 8], "little")
        if blob[place : place + 4] == b"data":
            return place + 8, size
        place += 8 + size + size % 2
    return end, 0


def little_endian(value: Column, n_bytes: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * n_bytes, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i - 1, 2) for i in range(n_bytes, 0, -1)]))


def store_payload(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """Adds ``out``: the UTF-8 bytes of the text (null: none), filled up with spaces to a positive multiple of 192, as 8-bit mono samples.

    ``n_bytes`` is the length before filling. An ``out`` or ``n_bytes`` column that exists is replaced.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    n = F.octet_length(data)
    padded = F.greatest(F.lit(1), F.ceil(n / UNIT)).cast("int") * UNIT
    head = F.concat(
        F.lit(bytearray(b"RIFF")), little_endian(padded + 36, 4), F.lit(bytearray(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data")), little_endian(padded, 4)
    )
    filled = F.call_function("rpad", data, padded, F.lit(bytearray(b" ")))
    return df.withColumns({"n_bytes": n.cast("long"), out: F.concat(head, filled)})


REPORT = "media_type string, declared_ok boolean, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, embedded array<struct<start:long,length:long,type:string>>, feature string"


def wav_rate(blob: bytes, start: int, end: int) -> int:
    """The sample rate that the format chunk of a sound WAVE object gives."""
    place = start + 12
    while place + 8 <= end and blob[place : place + 4] != b"fmt ":
        size = int.from_bytes(blob[place + 4 : place + 8], "little")
        place += 8 + size + size % 2
    return int.from_bytes(blob[place + 12 : place + 16], "little")


def feature(kind: str, rate: int, payload: bytes, embedded: int) -> str:
    """Whole-number features of the samples, so that equal payloads have equal values on any machine."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    rises = int(np.count_nonzero(np.diff(x) > 0)) if len(x) else 0
    return f"{kind};rate={rate};n={len(x)};sum={int(x.sum())};sumsq={int((x * x).sum())};peak={int(x.max(initial=0))};rises={rises};embedded={embedded}"


def inspect(blob: bytes | None, declared: str | None, magics: ahocorasick.Automaton) -> tuple:
    blob = blob or b""
    found = carve(blob, magics)
    top = next((x for x in found if x[0] == 0), None)
    kind = top[2] if top else "application/octet-stream"
    inside = [{"start": a, "length": z - a, "type": t} for a, z, t in found if a]
    start, size = wav_samples(blob, 0, top[1]) if kind == "audio/wav" else (0, top[1] if top else len(blob))
    payload = blob[start : start + size]
    return (
        kind,
        declared == kind,
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-16:]),
        len(blob),
        hashlib.sha256(blob).hexdigest(),
        inside,
        feature(kind, wav_rate(blob, 0, top[1]) if kind == "audio/wav" else 0, payload, len(inside)),
    )


def sniff_media(df: DataFrame, keep: list[str], media_col: str = "media", declared_col: str | None = None) -> DataFrame:
    """One row for each input row: the columns ``keep``, then REPORT, from the stored bytes alone.

    A null or empty blob is of type application/octet-stream with an empty payload; a blob whose magic bytes lead to
    no sound structure too, and its payload is the blob. Equal blobs give equal reports; repeated rows each get one.
    """
    small_batches(df.sparkSession, 500)
    declared = F.col(declared_col) if declared_col else F.lit(None).cast("string")
    schema = StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(REPORT)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        magics = automaton()
        types = [pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("type", pa.string())])), pa.string()]
        n = len(keep)
        for batch in batches:
            rows = [inspect(b, d, magics) for b, d in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *columns], names)

    return df.select(*[F.col(c) for c in keep], F.col(media_col).alias("__media"), declared.alias("__declared")).mapInArrow(run, schema)
