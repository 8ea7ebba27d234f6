"""Signature sniffing of media columns: magic bytes by Aho-Corasick, then format validators.

One automaton over all magic strings runs through the bytes; at each hit the format's validator
walks the structure (chunks, boxes, pages, markers) within the bytes at hand and returns the length, or
nothing if the structure does not hold, so a magic string in running text is not taken for a file. The
first valid format at offset 0 corrects the declared type; valid formats further on are embedded media,
which are carved by their lengths.

`store` keeps any payload losslessly as 8-bit samples: a mono PCM WAV file of one byte a sample.
`read_back` finds the samples again through the file's own chunks. Null text is empty; every row
gives one row, and equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.plans.storage import small_batches

UNIT = 576
RATE = 8000

#: Media types and the magic bytes at the start of their files.
MAGIC: dict[str, tuple[bytes, ...]] = {
    "image/png": (b"\x89PNG\r\n\x1a\n",),
    "image/jpeg": (b"\xff\xd8\xff",),
    "image/gif": (b"GIF87a", b"GIF89a"),
    "image/bmp": (b"BM",),
    "riff": (b"RIFF",),
    "application/pdf": (b"%PDF-",),
    "application/zip": (b"PK\x03\x04",),
    "application/gzip": (b"\x1f\x8b\x08",),
    "audio/ogg": (b"OggS",),
    "audio/flac": (b"fLaC",),
    "video/mp4": (b"ftyp",),
}


def automaton():
    """The Aho-Corasick automaton over all magic strings, for bytes read as Latin-1."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, magics in MAGIC.items():
        for magic in magics:
            found.add_word(magic.decode("latin-1"), (kind, len(magic)))
    found.make_automaton()
    return found


def _png(b: bytes, at: int) -> int | None:
    i = at + 8
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        end = i + 12 + n
        if end > len(b) or zlib.crc32(b[i + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0] or (i == at + 8) != (kind == b"IHDR"):
            return None
        i = end
        if kind == b"IEND":
            return i - at
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    i, scanned = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        m = b[i + 1]
        if m == 0xFF:
            i += 1
            continue
        if m == 0xD9:
            return i + 2 - at if scanned else None
        if m == 0 or m == 0xD8:
            return None
        if m == 1 or 0xD0 <= m <= 0xD7:
            i += 2
            continue
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or i + 2 + n > len(b):
            return None
        i += 2 + n
        if m == 0xDA:
            scanned = True
            while True:
                i = b.find(b"\xff", i)
                if i < 0 or i + 1 >= len(b):
                    return None
                if b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7:
                    i += 2
                    continue
                break
    return i + 2 - at if scanned and b[i : i + 2] == b"\xff\xd9" else None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    i = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(i: int) -> int | None:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1 if i < len(b) else None

    while i is not None and i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 < len(b):
            i = blocks(i + 11 + (3 << ((b[i + 9] & 7) + 1) if b[i + 9] & 0x80 else 0))
        else:
            return None
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 30 > len(b):
        return None
    n, _, start, head, w, h, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if head not in (40, 52, 56, 64, 108, 124) or planes != 1 or depth not in (1, 4, 8, 16, 24, 32) or w <= 0 or not h:
        return None
    return n if 14 + head <= start <= n <= len(b) - at else None


def _riff(b: bytes, at: int) -> int | None:
    if at + 12 > len(b):
        return None
    n, kind = struct.unpack_from("<I4s", b, at + 4)
    end = at + 8 + n
    if kind not in (b"WAVE", b"WEBP", b"AVI ") or end > len(b) or n < 12:
        return None
    i = at + 12
    while i + 8 <= end:
        i += 8 + struct.unpack_from("<I", b, i + 4)[0]
        i += (i - at) & 1
    return end + (n & 1 if end < len(b) else 0) - at if i in (end, end + 1) else None


def _pdf(b: bytes, at: int) -> int | None:
    if not b[at + 5 : at + 6].isdigit():
        return None
    nxt = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, nxt if nxt > 0 else len(b))
    return end + 5 - at if end > 0 and b.find(b"startxref", at, end) > 0 else None


def zip_ends(b: bytes) -> dict[int, int]:
    """Where zip archives begin and where they end, by their end records: each of them names the one place it belongs to."""
    found, i = {}, b.find(b"PK\x05\x06")
    while i >= 0 and i + 22 <= len(b):
        entries, size, start, note = struct.unpack_from("<HIIH", b, i + 10)
        at = i - size - start
        if entries and at >= 0 and b[at + start : at + start + 4] == b"PK\x01\x02" and i + 22 + note <= len(b):
            found.setdefault(at, i + 22 + note)
        i = b.find(b"PK\x05\x06", i + 4)
    return found


def _gzip(b: bytes, at: int) -> int | None:
    inflate, i = zlib.decompressobj(31), at
    try:
        while not inflate.eof and i < len(b):
            piece = b[i : i + 65536]
            inflate.decompress(piece)
            i += len(piece)
    except zlib.error:
        return None
    return i - len(inflate.unused_data) - at if inflate.eof else None


def _ogg(b: bytes, at: int) -> int | None:
    i = at
    while i + 27 <= len(b) and b[i : i + 4] == b"OggS" and b[i + 4] == 0:
        if i + 27 + b[i + 26] > len(b):
            return None
        end = i + 27 + b[i + 26] + sum(b[i + 27 : i + 27 + b[i + 26]])
        if end > len(b):
            return None
        last, i = b[i + 5] & 4, end
        if last:
            return i - at
    return None


def _flac(b: bytes, at: int) -> int | None:
    """The stream has no length of its own: it reaches to the end of the bytes."""
    return len(b) - at if at + 42 <= len(b) and b[at + 4] & 0x7F == 0 and b[at + 5 : at + 8] == b"\x00\x00\x22" else None


def _mp4(b: bytes, at: int) -> int | None:
    i, kinds = at, set()
    while i + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if n == 1 and i + 16 <= len(b):
            n = struct.unpack_from(">Q", b, i + 8)[0]
        if n < 8 or i + n > len(b) or not kind.isalnum() or (i > at and kind == b"ftyp"):
            break
        kinds.add(kind)
        i += n
    return i - at if kinds & {b"moov", b"moof"} and b"ftyp" in kinds else None


VALIDATORS = {
    "image/png": _png,
    "image/jpeg": _jpeg,
    "image/gif": _gif,
    "image/bmp": _bmp,
    "riff": _riff,
    "application/pdf": _pdf,
    "application/gzip": _gzip,
    "audio/ogg": _ogg,
    "audio/flac": _flac,
    "video/mp4": _mp4,
}
_RIFF_TYPES = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


def locate(data: bytes, machine=None) -> list[tuple[int, int, str]]:
    """(offset, length, type) of all media in the bytes; what lies within a found file is searched too."""
    found, zips = [], None
    for end, (kind, n) in (machine or automaton()).iter(data.decode("latin-1")):
        at = end - n + 1 - (4 if kind == "video/mp4" else 0)
        if kind == "application/zip":
            zips = zip_ends(data) if zips is None else zips  # once for all local headers
            size = zips.get(at, at) - at
        else:
            size = VALIDATORS[kind](data, at) if at >= 0 else None
        if size:
            found.append((at, size, _RIFF_TYPES[data[at + 8 : at + 12]] if kind == "riff" else kind))
    return sorted(found, key=lambda x: (x[0], -x[1], x[2]))


def sniff(data: bytes, declared: str, machine=None) -> tuple[str, list[tuple[int, int, str]]]:
    """The true type (the declared one if nothing valid starts at offset 0) and the embedded media."""
    found = locate(data, machine)
    at0 = next((x for x in found if x[0] == 0), None)
    return (at0[2] if at0 else declared), [x for x in found if x[0]]


def pad(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode()
    return data + b"\xff" * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)), len(data)


def store(payload: bytes) -> bytes:
    """A WAV file whose 8-bit mono samples are the payload."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def read_back(media: bytes) -> bytes:
    """The samples of a mono 8-bit WAV file, found through its chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    i = 12
    while i + 8 <= len(media):
        kind, n = struct.unpack_from("<4sI", media, i)
        if kind == b"fmt " and struct.unpack_from("<HHIIHH", media, i + 8) != (1, 1, RATE, RATE, 1, 8):
            raise ValueError("not mono 8-bit samples")
        if kind == b"data":
            return media[i + 8 : i + 8 + n]
        i += 8 + n + (n & 1)
    raise ValueError("no samples")


def media_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stored file) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            padded = [pad(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in padded], pa.int64()), pa.array([store(p) for p, _ in padded], pa.binary())], names=["doc_id", "n_bytes", "media"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame, declared: str = "application/octet-stream") -> DataFrame:
    """What sniffing and reading back give for each stored file: types, carved media and digests of the payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            rows = []
            for data in batch.column(2).to_pylist():
                kind, inner = sniff(data, declared, machine)
                payload = read_back(data)
                carved = ";".join(f"{t}@{at}+{n}#{zlib.crc32(data[at : at + n]):08x}" for at, n, t in inner)
                feature = f"declared={declared}|type={kind}|corrected={int(kind != declared)}|samples={len(payload)}|carved={carved}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", *names])

    small_batches(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def sniff_column(df: DataFrame, data: str, declared: str, key: str) -> DataFrame:
    """For any binary column: key, declared, true type, and carved media as (offset, length, type, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton()
        shape = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("bytes", pa.binary())]))
        for batch in batches:
            kinds, carved = [], []
            for blob, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                kind, inner = sniff(blob or b"", said, machine)
                kinds.append(kind)
                carved.append([{"offset": at, "length": n, "type": t, "bytes": blob[at : at + n]} for at, n, t in inner])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(kinds, pa.string()), pa.array(carved, shape)], names=["key", "declared", "type", "carved"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(data).cast("binary").alias("data"), F.col(declared).cast("string").alias("declared")).mapInArrow(run, f"key {kind}, declared string, type string, carved array<struct<offset:long,length:long,type:string,bytes:binary>>").withColumnRenamed("key", key)
