"""Media columns: bytes with a declared type, and signature sniffing over them.

An Aho-Corasick automaton finds the magic bytes of all known formats in one pass over each value. A validator of the
format then confirms structure and length from that place on: chunk sizes, checksums, markers. What it confirms at the
start corrects the declared type; what it confirms elsewhere is carved as embedded media (offset, length, type), not
looked for again inside what it spans. A magic that fails its validator is dropped.

A null value gives nulls and no carvings; an empty one has no type. Repeated values give equal results. Very long values are
read whole, one batch of few bytes at a time. An empty table gives an empty result. Other columns are kept.
"""

from __future__ import annotations

import bisect
import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.llm.common import in_arrow, table, written
from tonelake.sources import containers, decoders

RATE = 8000
UNIT = 64


def padded(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of UNIT."""
    return payload + bytes(max(UNIT, -(-len(payload) // UNIT) * UNIT) - len(payload))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """Unsigned 8-bit mono PCM; an odd length gets RIFF's pad byte."""
    pad = len(samples) & 1
    return b"RIFF" + struct.pack("<I", 36 + len(samples) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(samples)) + samples + bytes(pad)


def from_wav(media: bytes) -> bytes:
    """The samples of the first data chunk."""
    at = 12
    while at + 8 <= len(media):
        n = int.from_bytes(media[at + 4 : at + 8], "little")
        if media[at : at + 4] == b"data":
            return media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


# Validators: the length of a sound item at ``at``, else 0.


def _riff(b: bytes, at: int) -> int:
    size = int.from_bytes(b[at + 4 : at + 8], "little") + 8
    if b[at + 8 : at + 12] not in (b"WAVE", b"AVI ", b"WEBP") or at + size > len(b) or size < 20:
        return 0
    p, kinds = at + 12, set()
    while p + 8 <= at + size:
        kinds.add(b[p : p + 4])
        p += 8 + (n := int.from_bytes(b[p + 4 : p + 8], "little")) + (n & 1)
    return size if p == at + size and (b[at + 8 : at + 12] != b"WAVE" or {b"fmt ", b"data"} <= kinds) else 0


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        n, kind = int.from_bytes(b[p : p + 4], "big"), b[p + 4 : p + 8]
        if p + 12 + n > len(b) or (p == at + 8 and kind != b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _gif(b: bytes, at: int) -> int:
    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    if at + 13 > len(b):
        return 0
    p = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    while p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0))
        else:
            return 0
    return 0


def _jpeg(b: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return 0
        mark = b[p + 1]
        p += 2 + int.from_bytes(b[p + 2 : p + 4], "big")
        if mark == 0xDA:  # entropy-coded data up to a marker that is no stuffing or restart
            while (p := b.find(b"\xff", p)) >= 0 and p + 1 < len(b):
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] and not 0xD0 <= b[p + 1] <= 0xD7:
                    break
                p += 2
            if p < 0:
                return 0
    return 0


_PDF_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF")


def _pdf(b: bytes, at: int) -> int:
    """To the last end marker, before any other PDF, whose cross-references lie where it says: updated files have several."""
    after = b.find(b"%PDF-", at + 5)
    stop, end = after if after > 0 else len(b), 0
    for m in _PDF_END.finditer(b, at, stop):
        place = at + int(m[1]) if len(m[1]) < 12 else stop
        if place < m.start() and (b[place : place + 4] == b"xref" or re.match(rb"\d+\s+\d+\s+obj", b[place : place + 40])):
            end = m.end()
    return end - at if end else 0


def _zip(b: bytes, at: int, chains: dict) -> int:
    """To the end record whose directory lies where it says, counted from here; the search stays within the entry chain.

    ``chains`` remembers where entries and directories of this value lead, so that no stretch is walked twice.
    """
    start, walked = at, []
    while start not in chains and b[start : start + 4] == b"PK\x03\x04" and start + 30 <= len(b):
        walked.append(start)
        flags, (size, name, extra) = b[start + 6], struct.unpack("<I4xHH", b[start + 18 : start + 30])
        start += 30 + name + extra + size
        if flags & 8:  # sizes follow the data: the next signature ends the entry
            start = _next_entry(b, start, chains)
    start = chains.get(start, start)
    chains.update(dict.fromkeys(walked, start))
    if b[start : start + 4] not in (b"PK\x01\x02", b"PK\x05\x06"):
        return 0
    p = chains.get(("directory", start), start)
    while b[p : p + 4] == b"PK\x01\x02" and p + 46 <= len(b):
        p += 46 + sum(struct.unpack("<HHH", b[p + 28 : p + 34]))
    chains["directory", start] = p
    if b[p : p + 4] != b"PK\x05\x06" or p + 22 > len(b):
        return 0
    size, offset, comment = struct.unpack("<IIH", b[p + 12 : p + 22])
    return p + 22 + comment - at if offset == start - at and size == p - start and p + 22 + comment <= len(b) else 0


def _next_entry(b: bytes, at: int, chains: dict) -> int:
    """The first record that follows a data descriptor from ``at`` on; all of them are looked for once."""
    if "next" not in chains:
        chains["next"] = [m.start() for m in _ZIP_NEXT.finditer(b)]
    i = bisect.bisect_left(chains["next"], at)
    return chains["next"][i] + 16 if i < len(chains["next"]) else len(b)


#: A data descriptor and the record after it.
_ZIP_NEXT = re.compile(rb"(?=PK\x07\x08.{12}PK(?:\x03\x04|\x01\x02))", re.S)


def _gzip(b: bytes, at: int) -> int:
    d = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not d.eof:
            d.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return 0
    return min(p, len(b)) - len(d.unused_data) - at if d.eof else 0


def _flac(b: bytes, at: int) -> int:
    """Metadata blocks, then at least one frame, each decoded to find its end and checked by its CRC-16."""
    if b[at + 4 : at + 8] not in (b"\x00\x00\x00\x22", b"\x80\x00\x00\x22") or at + 42 > len(b):
        return 0
    bits = (int.from_bytes(b[at + 20 : at + 22], "big") >> 4 & 31) + 1
    p, last = at + 4, False
    while not last and p + 4 <= len(b):
        last, p = bool(b[p] & 0x80), p + 4 + int.from_bytes(b[p + 1 : p + 4], "big")
    if not last or p > len(b):
        return 0
    start = p
    while head := decoders.frame_header(b, p):
        most = head[0] + 2 + 5 * (head[2] + 8) * (2 if head[4] > 7 else head[4] + 1)  # samples take 33 bits at most
        if not (n := decoders.frame_length(b[p : p + most], bits)):
            break
        p += n
    return p - at if p > start else 0


def _ogg(b: bytes, at: int) -> int:
    """Pages, each with its checksum: to the last one of the stream, or as far as they are sound where it breaks off.

    Inside other bytes a stream begins with a page marked as its first.
    """
    p = at
    if at and not (at + 5 < len(b) and b[at + 5] & 2):
        return 0
    while b[p : p + 5] == b"OggS\x00" and p + 27 <= len(b):
        n = b[p + 26]
        size = 27 + n + sum(b[p + 27 : p + 27 + n])
        if p + size > len(b) or containers.page_crc(b[p : p + 22] + bytes(4) + b[p + 26 : p + size]) != int.from_bytes(b[p + 22 : p + 26], "little"):
            break
        last, p = b[p + 5] & 4, p + size
        if last:
            break
    return p - at


def _midi(b: bytes, at: int) -> int:
    if b[at + 4 : at + 8] != b"\x00\x00\x00\x06":
        return 0
    p = at + 14
    for _ in range(int.from_bytes(b[at + 10 : at + 12], "big")):
        if b[p : p + 4] != b"MTrk":
            return 0
        p += 8 + int.from_bytes(b[p + 4 : p + 8], "big")
    return p - at if at + 14 < p <= len(b) else 0


def _bmp(b: bytes, at: int) -> int:
    size, zero, start, head = struct.unpack("<IIII", b[at + 2 : at + 18]) if at + 18 <= len(b) else (0, 1, 0, 0)
    return size if not zero and head in (12, 40, 108, 124) and 14 + head <= start < size <= len(b) - at else 0


# Magic bytes and media types.
FORMATS = [
    (b"RIFF", {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}, _riff),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"%PDF-", "application/pdf", _pdf),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
    (b"MThd", "audio/midi", _midi),
    (b"BM", "image/bmp", _bmp),
]


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), i)
    a.make_automaton()
    return a


def found(b: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of a sound item at the start, and of the outermost ones within or after it."""
    out, free, chains = [], 1, {}
    for end, i in _automaton().iter(b.decode("latin-1")):
        magic, kind, check = FORMATS[i]
        at = end - len(magic) + 1
        if (at == 0 or at >= free) and (n := check(b, at, chains) if check is _zip else check(b, at)):
            out.append((at, n, kind[b[at + 8 : at + 12]] if isinstance(kind, dict) else kind))
            free = at + n if at else 1  # the item at the start is looked into, embedded ones are not
    return out


def sniffed(df: DataFrame, media: str = "media", declared: str | None = None) -> DataFrame:
    """Adds media_type (confirmed at the start, else declared), corrected, and carved: what lies further inside."""
    kind = T.StructType.fromDDL("media_type string, corrected boolean, carved array<struct<offset: bigint, length: bigint, type: string>>")
    schema = T.StructType([*df.schema.fields, *kind.fields])
    carving = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = batch.column(declared).to_pylist() if declared else [None] * len(batch)
            types, fixed, carved = [], [], []
            for b, d in zip(batch.column(media).to_pylist(), said):
                items = found(b) if b is not None else []
                head = next((k for at, _, k in items if at == 0), None)
                types.append(head or d)
                fixed.append(head != d if head else False if b is not None else None)
                carved.append([dict(offset=at, length=n, type=k) for at, n, k in items if at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(fixed, pa.bool_()), pa.array(carved, carving)], names=schema.names)

    return in_arrow(df, run, schema)


def stored(texts: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, media): each text's padded UTF-8 bytes as a WAV file, declared as plain bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            cols = [batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(["application/octet-stream"] * len(raw)), pa.array([to_wav(padded(r)) for r in raw], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "declared", "media"])

    return in_arrow(texts.select("doc_id", "text"), run, "doc_id long, n_bytes long, declared string, media binary")


def with_samples(df: DataFrame) -> DataFrame:
    """Adds the samples that WAV media hold, and a feature: mean, deviation, peak and sign changes about the middle."""
    schema = T.StructType([*df.schema.fields, T.StructField("samples", T.BinaryType()), T.StructField("level", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            samples = [from_wav(b) for b in batch.column("media").to_pylist()]
            levels = []
            for s in samples:
                x = np.frombuffer(s, np.uint8).astype(np.int32) - 128
                levels.append(f"mean={x.mean():.3f} dev={x.std():.3f} peak={np.abs(x).max()} cross={int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())}" if len(x) else "empty")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(samples, pa.binary()), pa.array(levels, pa.string())], names=schema.names)

    return in_arrow(df, run, schema)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media, _ = written(stored(table(spark, sf_dir, "documents")), "media")
    df = with_samples(sniffed(media, declared="declared"))
    feature = F.concat_ws(" ", F.concat(F.col("media_type"), F.lit("/u8")), "level", F.concat(F.lit("carved="), F.array_join(F.transform("carved", lambda c: F.concat(c["type"], F.lit("@"), c["offset"].cast("string"), F.lit("+"), c["length"].cast("string"))), ",")))
    return df.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(samples, octet_length(samples) - {UNIT - 1}, {UNIT})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
