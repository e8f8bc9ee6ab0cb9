"""Container and tag parsing where each item's place depends on the one before it.

Each parser is a small generator over one file's bytes and yields rows; Spark spreads files over tasks in Arrow
batches and does the rest: labels, sums, joins. Fields at fixed places are read natively in ``files``.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.functions import text
from tonelake.operators import lookups
from tonelake.session import in_arrow


def parsed(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str, key: str = "path") -> DataFrame:
    """(key, rows of ``parse``) of (key, content); a file that breaks off gives the rows up to there."""
    own = T.StructType.fromDDL(schema)
    out = T.StructType([files.schema[key], *own.fields])
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    for row in parse(content or b""):
                        rows.append((k, *row))
                        if len(rows) == 4096:
                            yield _batch(rows, arrow)
                            rows = []
                except (IndexError, struct.error):
                    pass
            if rows:
                yield _batch(rows, arrow)

    return in_arrow(files.select(key, "content"), run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow(t: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}[t.simpleString()]


def _u(b: bytes, at: int, n: int, order: str = "big") -> int:
    if at + n > len(b):
        raise IndexError
    return int.from_bytes(b[at : at + n], order)


# Transport framing


def chunked(b: bytes) -> Iterator[tuple[int, bytes]]:
    """(position, data) of an HTTP chunked body; extensions and trailers are skipped; a bad size ends it."""
    at = 0
    while (end := b.find(b"\r\n", at, at + 257)) >= 0:
        size = b[at:end].split(b";")[0].strip()
        if not size or any(c not in b"0123456789abcdefABCDEF" for c in size) or (n := int(size, 16)) == 0:
            return
        yield end + 2, b[end + 2 : end + 2 + n]
        at = end + 2 + n + 2


def chunks(bodies: DataFrame, key: str = "stream_id") -> DataFrame:
    """(key, position, data)."""
    return parsed(bodies, chunked, "position bigint, data binary", key)


def icy(metaint: int) -> Callable[[bytes], Iterator[tuple[int, bytes, bytes]]]:
    """A parser of (audio position, audio, metadata) blocks: after each ``metaint`` bytes a length byte, times 16, and text."""

    def parse(b: bytes) -> Iterator[tuple[int, bytes, bytes]]:
        at = played = 0
        while at < len(b):
            audio = b[at : at + metaint]
            at += metaint
            n = b[at] * 16 if at < len(b) else 0
            played += len(audio)
            yield played, audio, b[at + 1 : at + 1 + n].rstrip(b"\0")
            at += 1 + n

    return parse


def icy_blocks(streams: DataFrame, metaint: int, key: str = "stream_id") -> DataFrame:
    """(key, audio_pos, audio, meta): clean payload and repaired text, a tail after 'song_spot' cut off; null without text."""
    rows = parsed(streams, icy(metaint), "audio_pos bigint, audio binary, raw binary", key)
    meta = F.regexp_replace(text.latin_to_utf8(F.col("raw")), r"(?s)song_spot=.*$", "song_spot")
    return rows.select(key, "audio_pos", "audio", F.when(F.octet_length("raw") > 0, meta).alias("meta"))


# Tags and blocks


def id3v2(b: bytes) -> Iterator[tuple[str, int, int, bytes]]:
    """(frame id, offset, version, body) of all chained tags; bodies of pictures are kept whole."""
    at = 0
    while b[at : at + 3] == b"ID3" and at + 10 <= len(b):
        version, flags = b[at + 3], b[at + 5]
        end = at + 10 + _safe(b, at + 6)
        p = at + 10
        if flags & 0x40 and version > 2:  # extended header
            p += _safe(b, p) if version == 4 else 4 + _u(b, p, 4)
        name, head = (3, 6) if version == 2 else (4, 10)
        while p + head <= end and b[p]:
            n = _u(b, p + 3, 3) if version == 2 else _safe(b, p + 4) if version == 4 else _u(b, p + 4, 4)
            yield b[p : p + name].decode("latin-1"), p + head, version, b[p + head : min(p + head + n, end)]
            p += head + n
        at = end


def _safe(b: bytes, at: int) -> int:
    return sum((_u(b, at + i, 1) & 127) << 7 * (3 - i) for i in range(4))


def id3_frames(files: DataFrame) -> DataFrame:
    """(path, tag, offset, version, body) of ID3v2 frames."""
    return parsed(files, id3v2, "tag string, offset bigint, version int, body binary")


def encoded_text(code: Column, body: Column) -> Column:
    """Text of an encoding byte: Latin-1, UTF-16 with mark, UTF-16 big-endian, UTF-8; the final zeros are cut."""
    s = F.when(code == 0, text.latin_to_utf8(body)).when(code == 1, text.from_utf16(body)).when(code == 2, text.from_utf16(body, True)).otherwise(F.decode(body, "UTF-8"))
    return F.regexp_replace(s, r"\x00+$", "")


def id3_texts(frames: DataFrame) -> DataFrame:
    """(path, tag, label, value, enc) of text, comment and lyrics frames; comments lose language and description."""
    code, body = text.big_endian(F.substring("body", 1, 1)), F.expr("substring(body, 2, octet_length(body))")
    worded = F.regexp_like("tag", F.lit("^(T|W[^X]|COM|USLT|ULT)"))
    said = F.col("tag").isin("COM", "COMM", "ULT", "USLT")
    rest = F.when(said, F.expr("substring(body, 5, octet_length(body))")).otherwise(body)
    value = F.when(F.startswith("tag", F.lit("W")), text.latin_to_utf8(F.col("body"))).otherwise(encoded_text(code, rest))
    value = F.when(said, F.regexp_replace(value, r"(?s)^[^\x00]*\x00+﻿?", "")).otherwise(value)
    rows = frames.where(worded & (F.octet_length("body") > 0)).select("path", "tag", value.alias("value"), F.when(F.startswith("tag", F.lit("W")), 0).otherwise(code).cast("int").alias("enc"))
    return lookups.with_tag_labels(rows)


def id3_pictures(frames: DataFrame) -> DataFrame:
    """(path, mime, pos, len) of attached pictures: byte ranges of the file."""
    s = F.decode("body", "ISO-8859-1")
    named = F.when(F.col("version") == 2, F.substring(s, 2, 3)).otherwise(F.regexp_extract(s, r"(?s)^.([^\x00]*)\x00", 1))
    wide = text.big_endian(F.substring("body", 1, 1)).isin(1, 2)
    narrow_head = F.char_length(F.regexp_extract(s, r"(?s)^.(?:[^\x00]*\x00)?.[^\x00]*\x00", 0))
    wide_head = F.char_length(F.regexp_extract(s, r"(?s)^.[^\x00]*\x00.(?:..)*?\x00\x00", 0))
    old_head = F.char_length(F.regexp_extract(s, r"(?s)^.{5}[^\x00]*\x00", 0))
    head = F.when(F.col("version") == 2, old_head).when(wide, wide_head).otherwise(narrow_head)
    rows = frames.where(F.col("tag").isin("APIC", "PIC"))
    return rows.select("path", named.alias("mime"), (F.col("offset") + head).alias("pos"), (F.octet_length("body") - head).cast("bigint").alias("len"))


def id3_synced_lyrics(frames: DataFrame) -> DataFrame:
    """(path, line_no, ts_ms, text) of synchronised lyrics in Latin-1 or UTF-8: text, a zero, and four bytes of milliseconds."""
    s = F.decode(F.expr("substring(body, 7, octet_length(body))"), "ISO-8859-1")
    body = F.regexp_replace(s, r"(?s)^[^\x00]*\x00", "")
    items = F.regexp_extract_all(body, F.lit(r"(?s)[^\x00]*\x00.{4}"), F.lit(0))
    rows = frames.where(F.col("tag").isin("SYLT", "SLT")).select("path", F.posexplode(items).alias("line_no", "x"))
    raw = F.encode("x", "ISO-8859-1")
    ms = text.big_endian(F.expr("substring(encode(x, 'ISO-8859-1'), octet_length(encode(x, 'ISO-8859-1')) - 3, 4)"))
    line = text.latin_to_utf8(F.substring(raw, F.lit(1), F.octet_length(raw) - 5))
    return rows.select("path", "line_no", ms.alias("ts_ms"), F.regexp_replace(line, r"^[\r\n]+", "").alias("text"))


def segment_timestamp(frames: DataFrame) -> DataFrame:
    """(path, seconds): the 90 kHz clock of the private frame that starts audio segments."""
    private = frames.where((F.col("tag") == "PRIV") & F.startswith(F.decode("body", "ISO-8859-1"), F.lit("com.apple.streaming.transportStreamTimestamp")))
    ticks = F.conv(F.hex(F.expr("substring(body, octet_length(body) - 7, 8)")), 16, 10).cast("bigint")
    return private.select("path", (ticks / 90_000).alias("seconds"))


def flac_blocks(b: bytes) -> Iterator[tuple[int, int, int]]:
    """(type, offset, size) of the metadata blocks of a native FLAC stream."""
    at, last = b.find(b"fLaC", 0, 4) + 4, b[:4] != b"fLaC"
    while not last:
        head, n = _u(b, at, 1), _u(b, at + 1, 3)
        yield head & 127, at + 4, n
        last, at = bool(head & 128), at + 4 + n


def flac_metadata(files: DataFrame) -> DataFrame:
    """(path, block_no, type, offset, size)."""
    rows = parsed(files, flac_blocks, "type int, offset bigint, size bigint")
    return rows.withColumn("block_no", F.row_number().over(Window.partitionBy("path").orderBy("offset")) - 1)


def flac_stream_info(files: DataFrame) -> DataFrame:
    """(path, block_min, block_max, sample_rate, channels, bits, total_samples, duration, data_start) of native FLAC."""
    from tonelake.sources.files import be

    blocks = flac_metadata(files)
    start = blocks.groupBy("path").agg(F.max(F.col("offset") + F.col("size")).alias("data_start"), F.max(F.when(F.col("type") == 0, F.col("offset"))).alias("o"))
    df = files.join(start.where("o IS NOT NULL"), "path")
    c, o = F.col("content"), F.col("o")
    packed, low = be(c, o + 10, 4), be(c, o + 14, 4)
    total = packed.bitwiseAND(F.lit(15)) * (1 << 32) + low
    df = df.select(
        "path", be(c, o, 2).cast("int").alias("block_min"), be(c, o + 2, 2).cast("int").alias("block_max"), F.shiftright(packed, 12).cast("int").alias("sample_rate"),
        (F.shiftright(packed, 9).bitwiseAND(F.lit(7)) + 1).cast("int").alias("channels"), (F.shiftright(packed, 4).bitwiseAND(F.lit(31)) + 1).cast("int").alias("bits"), total.alias("total_samples"), "data_start",
    )
    return df.withColumn("duration", F.expr("try_divide(total_samples, sample_rate)"))


def comments(b: bytes) -> Iterator[tuple[str, str]]:
    """(key, value) of a Vorbis comment block, without any framing before the vendor's length."""
    at = 4 + _u(b, 0, 4, "little")
    n, at = _u(b, at, 4, "little"), at + 4
    for _ in range(n):
        size = _u(b, at, 4, "little")
        key, _, value = b[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        yield key.upper(), value
        at += 4 + size


def comment_rows(blocks: DataFrame, key: str = "path") -> DataFrame:
    """(key, name, value) of (key, content) comment blocks."""
    return parsed(blocks, comments, "name string, value string", key)


def flac_comments(files: DataFrame) -> DataFrame:
    """(path, name, value) of the comment blocks of native FLAC files."""
    at = flac_metadata(files).where("type = 4")
    return comment_rows(files.join(at, "path").select("path", F.expr("substring(content, CAST(offset AS INT) + 1, CAST(size AS INT))").alias("content")))


def lyric_lines(rows: DataFrame, key: str = "path") -> DataFrame:
    """(key, line_no, ts_ms, text) of LYRICS comments whose lines carry times."""
    lines = rows.where("name = 'LYRICS'").select(key, F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return lines.withColumn("ts_ms", text.lyric_ms(F.col("line"))).where("ts_ms >= 0").select(key, "line_no", "ts_ms", F.trim(F.regexp_replace("line", r"^\[[^\]]*\]", "")).alias("text"))


def flac_pictures(files: DataFrame) -> DataFrame:
    """(path, mime, pos, len) of picture blocks: byte ranges of the file."""
    from tonelake.sources.files import be

    at = flac_metadata(files).where("type = 6")
    df = files.join(at, "path")
    c, o = F.col("content"), F.col("offset")
    m = be(c, o + 4, 4)
    d = be(c, o + 8 + m, 4)
    return df.select("path", F.decode(F.substring("content", (o + 9).cast("int"), m.cast("int")), "ISO-8859-1").alias("mime"), (o + 32 + m + d).alias("pos"), be(c, o + 28 + m + d, 4).alias("len"))


#: Each byte with its bits in reverse.
_MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(page: bytes) -> int:
    """An Ogg page's CRC-32, highest bit first and from zero: the usual one is its mirror image, so both ends are mirrored."""
    mirrored = zlib.crc32(page.translate(_MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{mirrored:032b}"[::-1], 2)


def ogg(b: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(page number, serial, flags, granule, packet): packets in turn, those that go on over pages joined.

    A packet gets the page that ends it, and that page's granule if it is the last to end there, else -1.
    """
    at, rest = 0, b""
    while (at := b.find(b"OggS", at)) >= 0:
        flags, granule, serial, page, n = _u(b, at + 5, 1), int.from_bytes(b[at + 6 : at + 14], "little", signed=True), _u(b, at + 14, 4, "little"), _u(b, at + 18, 4, "little"), _u(b, at + 26, 1)
        lacing = b[at + 27 : at + 27 + n]
        p, ends = at + 27 + n, [i for i, x in enumerate(lacing) if x < 255]
        if not flags & 1:
            rest = b""
        for i, x in enumerate(lacing):
            rest += b[p : p + x]
            p += x
            if x < 255:
                yield page, serial, flags, granule if i == ends[-1] else -1, rest
                rest = b""
        at = p


def ogg_packets(files: DataFrame) -> DataFrame:
    """(path, page_no, serial, flags, granule, packet)."""
    return parsed(files, ogg, "page_no bigint, serial bigint, flags int, granule bigint, packet binary")


def ogg_duration(files: DataFrame, rate: int) -> DataFrame:
    """(path, last_granule, duration): from the last page of the final 64 KB, null if it isn't marked as the last."""
    from tonelake.sources.files import be, le

    tail = F.expr("substring(content, greatest(octet_length(content) - 65535, 1), 65536)")
    rows = files.select("path", tail.alias("t")).withColumn("at", text.bytes_index_of(F.col("t"), b"OggS", last=True)).where("at >= 0")
    ended = be(F.col("t"), F.col("at") + 5, 1).bitwiseAND(F.lit(4)) != 0
    rows = rows.select("path", F.when(ended, le(F.col("t"), F.col("at") + 6, 7)).alias("last_granule"))
    return rows.withColumn("duration", F.col("last_granule") / rate)


def ogg_comments(packets: DataFrame) -> DataFrame:
    """(path, name, value) of the comment packets of Opus, Vorbis and Ogg FLAC streams."""
    s = F.decode("packet", "ISO-8859-1")
    skip = F.when(F.startswith(s, F.lit("OpusTags")), 8).when(F.startswith(s, F.lit("\x03vorbis")), 7).when(F.regexp_like(F.hex(F.substring("packet", 1, 1)), F.lit("^[08]4$")) & (F.col("page_no") > 0), 4)
    own = packets.where("page_no < 64").withColumn("_skip", skip).where("_skip IS NOT NULL")
    return comment_rows(own.select("path", F.expr("substring(packet, _skip + 1, octet_length(packet))").alias("content")))


#: Atoms that hold atoms.
HOLDERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"ilst", b"stsd", b"meta", b"mp4a"}
_SKIP = {b"meta": 4, b"stsd": 8, b"mp4a": 28}


def atoms(b: bytes) -> Iterator[tuple[str, str, int, int]]:
    """(path of names, name, offset of the body, size of the body), parents before children."""
    todo = [("", 0, len(b))]
    while todo:
        where, at, end = todo.pop()
        while at + 8 <= end:
            n, name, head = _u(b, at, 4), b[at + 4 : at + 8], 8
            if n == 1:
                n, head = _u(b, at + 8, 8), 16
            n = end - at if n == 0 else n
            if n < head:
                break
            own = f"{where}/{name.decode('latin-1')}"
            yield own, name.decode("latin-1"), at + head, n - head
            if name in HOLDERS or where.endswith("/ilst"):
                todo.append((own, at + head + _SKIP.get(name, 0), min(at + n, end)))
            at += n


def m4a_atoms(files: DataFrame) -> DataFrame:
    """(path, atom_path, atom, offset, size)."""
    return parsed(files, atoms, "atom_path string, atom string, offset bigint, size bigint")


def m4a_heads(b: bytes) -> Iterator[tuple[bytes | None, str | None, int | None, int | None]]:
    """(what the media header begins with, codec, offset and size of the data) of a file that has an atom."""
    seen, media, codecs, data, sizes = False, [], [], [], []
    try:
        for where, name, at, n in atoms(b):
            seen = True
            if name == "mdhd":
                media.append(at)
            elif name == "mdat":
                data, sizes = [min([at, *data])], [min([n, *sizes])]
            if re.search("/stsd/[^/]+$", where):
                codecs.append(name)
    except (IndexError, struct.error):
        pass
    if seen:
        yield b[min(media) : min(media) + 32] if media else None, min(codecs, default=None), min(data, default=None), min(sizes, default=None)


def m4a_info(files: DataFrame) -> DataFrame:
    """(path, timescale, duration, codec, valid, data_start, data_size): valid if the sample description is AAC."""
    from tonelake.sources.files import be

    df = parsed(files, m4a_heads, "m binary, codec string, data_start bigint, data_size bigint")
    wide = be(F.col("m"), 0, 1) == 1
    scale = F.when(wide, be(F.col("m"), 20, 4)).otherwise(be(F.col("m"), 12, 4))
    length = F.when(wide, be(F.col("m"), 25, 7)).otherwise(be(F.col("m"), 16, 4))
    return df.select("path", scale.alias("timescale"), F.try_divide(length, scale).alias("duration"), "codec", (F.col("codec") == "mp4a").alias("valid"), "data_start", "data_size")


def m4a_values(b: bytes) -> Iterator[tuple[str, bytes, bytes]]:
    """(atom, head, value) of iTunes metadata without pictures."""
    for where, _, at, n in atoms(b):
        m = re.search("/ilst/([^/]+)/data$", where)
        if m and m[1] != "covr":
            yield m[1], b[at : at + 8], b[at + 8 : at + max(n, 8)]


def m4a_tags(files: DataFrame) -> DataFrame:
    """(path, atom, label, value) of iTunes metadata; numbers of tracks, disks and flags as text; pictures are left to ``m4a_cover``."""
    body = parsed(files, m4a_values, "atom string, h binary, v binary")
    kind = text.big_endian(F.substring("h", 2, 3))
    number = F.when(F.col("atom").isin("trkn", "disk"), F.concat(text.big_endian(F.substring("v", 3, 2)).cast("string"), F.lit("/"), text.big_endian(F.substring("v", 5, 2)).cast("string"))).otherwise(text.big_endian(F.substring("v", 1, 4)).cast("string"))
    shown = body.select("path", "atom", F.when(kind == 1, F.decode("v", "UTF-8")).otherwise(number).alias("value"))
    return shown.join(F.broadcast(lookups.atom_labels(files.sparkSession)), "atom", "left").select("path", "atom", "label", "value")


def m4a_cover(files: DataFrame) -> DataFrame:
    """(path, pos, len) of the cover picture."""
    rows = m4a_atoms(files).where(F.endswith("atom_path", F.lit("/ilst/covr/data")))
    return rows.groupBy("path").agg(F.min(F.struct("offset", "size")).alias("m")).select("path", (F.col("m.offset") + 8).alias("pos"), (F.col("m.size") - 8).alias("len"))


def m4a_sizes(b: bytes) -> Iterator[tuple[int, int]]:
    """(sample_no, size) of the sample-size table."""
    for _, name, at, _ in atoms(b):
        if name == "stsz":
            same, n = _u(b, at + 4, 4), _u(b, at + 8, 4)
            for i in range(n):
                yield i, same or _u(b, at + 12 + i * 4, 4)


def m4a_sample_sizes(files: DataFrame) -> DataFrame:
    """(stream_id, sample_no, size) of the sample-size table."""
    return parsed(files, m4a_sizes, "sample_no bigint, size bigint").withColumnRenamed("path", "stream_id")


# MPEG audio bit rates in kb/s (layer III, MPEG-1 and then 2) and sample rates of MPEG-1.
KBPS = [[0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]]
RATES = [44_100, 48_000, 32_000]


def mp3_header(b: bytes, at: int) -> tuple[int, int, int, int] | None:
    """(size, rate, bits per second, samples) of a layer III frame header, None for anything else."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, kb, sr = b[at + 1] >> 3 & 3, b[at + 1] >> 1 & 3, b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version == 1 or layer != 1 or kb in (0, 15) or sr == 3:
        return None
    rate = RATES[sr] >> (0 if version == 3 else 1 if version == 2 else 2)
    bps, samples = KBPS[version != 3][kb] * 1000, 1152 if version == 3 else 576
    return samples // 8 * bps // rate + (b[at + 2] >> 1 & 1), rate, bps, samples


def mp3_frames(b: bytes) -> Iterator[tuple[int, int, int, int, int]]:
    """(offset, size, rate, bitrate, samples): frames in turn; after a break the next place where two follow each other."""
    at = 0
    if b[:3] == b"ID3":
        at = 10 + _safe(b, 6)
    synced = False
    while 0 <= at < len(b) - 3:
        h = mp3_header(b, at)
        if h and (synced or mp3_header(b, at + h[0]) or at + h[0] == len(b)):
            synced = True
            yield at, h[0], h[1], h[2], h[3]
            at += h[0]
        else:
            synced = False
            at = b.find(b"\xff", at + 1)


def mp3_frame_rows(files: DataFrame) -> DataFrame:
    """(path, offset, size, sample_rate, bitrate, samples)."""
    return parsed(files, mp3_frames, "offset bigint, size int, sample_rate int, bitrate int, samples int")


def mp3_sums(b: bytes) -> Iterator[tuple[int, int, int, int, int, bytes]]:
    """(frames, bytes, samples, highest rate, most samples of a frame, what the first frame begins with) of a file that has frames."""
    n = size = samples = rate = per = first = 0
    for at, own, r, _, s in mp3_frames(b):
        first = at if n == 0 else first
        n, size, samples, rate, per = n + 1, size + own, samples + s, max(rate, r), max(per, s)
    if n:
        yield n, size, samples, rate, per, b[first : first + 80]


def mp3_info(files: DataFrame) -> DataFrame:
    """(path, frames, sample_rate, duration, bitrate): from a Xing or Info header's frame count, else by summing frames."""
    from tonelake.sources.files import be

    df = parsed(files, mp3_sums, "frames bigint, bytes bigint, samples bigint, sample_rate int, per int, head binary")
    head = F.decode(F.substring("head", 1, 64), "ISO-8859-1")
    df = df.withColumn("_x", F.greatest(text.index_of(head, "Xing"), text.index_of(head, "Info")))
    flagged = (F.col("_x") >= 0) & (be(F.col("head"), F.col("_x") + 4, 4).bitwiseAND(F.lit(1)) == 1)
    told = F.when(flagged, be(F.col("head"), F.col("_x") + 8, 4))
    df = df.withColumn("duration", F.coalesce(told * F.col("per"), F.col("samples")) / F.col("sample_rate"))
    return df.select("path", F.coalesce(told, F.col("frames")).alias("frames"), "sample_rate", "duration", F.expr("bytes * 8 * sample_rate div samples").alias("bitrate"))


def adts_frames(b: bytes) -> Iterator[tuple[int, int, int, int]]:
    """(offset, size, rate, channels) of ADTS frames; the first is one that another follows."""
    rates = [96_000, 88_200, 64_000, 48_000, 44_100, 32_000, 24_000, 22_050, 16_000, 12_000, 11_025, 8000, 7350]  # fixed values
    at, synced = 0, False

    def size(i: int) -> int:
        good = i + 7 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xF6 == 0xF0 and b[i + 2] >> 2 & 15 < 13
        return (b[i + 3] & 3) << 11 | b[i + 4] << 3 | b[i + 5] >> 5 if good else 0

    while 0 <= at < len(b) - 6:
        n = size(at)
        if n > 6 and (synced or size(at + n) or at + n == len(b)):
            synced = True
            yield at, n, rates[b[at + 2] >> 2 & 15], (b[at + 2] & 1) << 2 | b[at + 3] >> 6
            at += n
        else:
            synced, at = False, b.find(b"\xff", at + 1)


def adts_frame_rows(files: DataFrame) -> DataFrame:
    """(path, offset, size, sample_rate, channels)."""
    return parsed(files, adts_frames, "offset bigint, size int, sample_rate int, channels int")
