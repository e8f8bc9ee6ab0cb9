"""Queries over media bytes that are made of the test tables: each row, or block of rows, is written as a file and parsed.

A customer is a tagged file, a page an MP3 stream, a block of events a WAV or FLAC file. The SQL takes its rows from the
same tables, so the work grows with them. Where a name is that of a query over fixtures, this one is registered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.operators import running
from tonelake.plans import fixtures
from tonelake.plans.bindings import sample, table
from tonelake.plans.stream_queries import from_rows, from_table, run
from tonelake.session import in_arrow
from tonelake.sources import containers, decoders, dispatch, files, web
from tonelake.streaming import stateful

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def built(rows: DataFrame, build: Callable[..., bytes], key: str = "path") -> DataFrame:
    """(key, content): a file per row, written by ``build`` of the row's other columns."""
    names = [c for c in rows.columns if c != key]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [build(*v) for v in zip(*(batch.column(n).to_pylist() for n in names))]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(made, pa.binary())], [key, "content"])

    return in_arrow(rows, write, f"{key} string, content binary")


def customers(spark: SparkSession, d: str, build: Callable[[int, str, str], bytes], key: str = "path") -> DataFrame:
    """A file per customer; rows are dealt first, since a split of the table holds far more of them than of the files."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias(key), "c_custkey", "c_name", "c_mktsegment")
    return built(rows.repartition(key), build, key)


C = "c AS (SELECT c_custkey::VARCHAR AS path, c_custkey AS k, c_name AS name, c_mktsegment AS seg FROM customer)"

# Samples: 500 events in a row are a file.

PER = 500
V16 = "greatest(least(round(value * 100)::BIGINT - 24501, 32767), -32768)"
E = f"e AS (SELECT event_id // {PER} AS k, row_number() OVER (PARTITION BY event_id // {PER} ORDER BY event_id) - 1 AS frame_no, {V16} AS v FROM events)"


def event_files(spark: SparkSession, d: str, build: Callable[[int, list[int]], bytes]) -> DataFrame:
    e = table(spark, d, "events").select(F.expr(f"event_id div {PER}").alias("k"), F.struct("event_id", F.shiftright(sample(), 16).alias("v")).alias("x"))
    rows = e.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return built(rows.select(F.col("k").cast("string").alias("path"), "k", F.transform("x", lambda x: x["v"]).alias("v")), build)


def wav_file(k: int, v: list[int]) -> bytes:
    """By its number: 8 to 32 bits, mono or with the complement on the right, 8 to 24 kHz."""
    bits, mono = (8, 16, 24, 32)[k % 4], k // 4 % 2 == 0

    def raw(x: int) -> int:
        return x + 32_768 >> 8 if bits == 8 else x << bits - 16

    return fixtures.wav([(raw(x),) if mono else (raw(x), raw(~x)) for x in v], bits, 8000 * (1 + k % 3))


WIDE = "(CASE WHEN k % 4 = 0 THEN ((({0} + 32768) >> 8) - 128) * 16777216 ELSE {0} * 65536 END)::INTEGER"


@query(
    "B4_wav_info",
    f"""WITH {E}, g AS (SELECT k, count(*) AS n, CASE WHEN k // 4 % 2 = 0 THEN 1 ELSE 2 END AS ch, [8, 16, 24, 32][1 + k % 4] AS bits, 8000 * (1 + k % 3) AS rate FROM e GROUP BY k)
    SELECT k::VARCHAR AS path, ch AS channels, rate AS sample_rate, bits, n * ch * bits // 8 AS data_size, ch * rate * bits AS bitrate FROM g""",
)
def wav_info(spark, d):
    return files.wav_info(event_files(spark, d, wav_file)).where("valid").select("path", "channels", "sample_rate", "bits", "data_size", "bitrate")


@query("C1_wav_samples", f"WITH {E} SELECT k::VARCHAR AS path, frame_no, {WIDE.format('v')} AS l, CASE WHEN k // 4 % 2 = 0 THEN {WIDE.format('v')} ELSE {WIDE.format('(-v - 1)')} END AS r FROM e")
def wav_samples(spark, d):
    return files.wav_samples(event_files(spark, d, wav_file)).select(F.col("stream_id").alias("path"), "frame_no", F.col("left").alias("l"), F.col("right").alias("r"))


def flac_file(k: int, v: list[int]) -> bytes:
    """Frames of 100 samples of 8 bits, predicted and paired by the file's number."""
    x = [s >> 8 for s in v]
    frames = [fixtures.flac_frame(i, x[i * 100 : i * 100 + 100], [~s for s in x[i * 100 : i * 100 + 100]], ("verbatim", "fixed2", "lpc")[k % 3], (1, 8, 9, 10)[k % 4]) for i in range(-(-len(x) // 100))]
    return fixtures.flac(frames, len(x), ["TITLE=x"])


@query("C2_flac_samples", f"WITH {E} SELECT k::VARCHAR AS path, frame_no, ((v >> 8) * 65536)::INTEGER AS l, ((-(v >> 8) - 1) * 65536)::INTEGER AS r FROM e")
def flac_samples(spark, d):
    return decoders.flac_pcm(event_files(spark, d, flac_file)).select(F.col("stream_id").alias("path"), "frame_no", F.col("left").alias("l"), F.col("right").alias("r"))


# Tagged files.


def flac_tagged(k: int, name: str, seg: str) -> bytes:
    return fixtures.flac([], k * 10, [f"TITLE={name}", f"LYRICS=[00:01.00]{seg}\n[01:02.50]{name}"], seg.encode())


@query("B5_flac_stream_info", f"WITH {C} SELECT path, 44100 AS sample_rate, 2 AS channels, 16 AS bits, k * 10 AS total_samples FROM c")
def flac_stream_info(spark, d):
    return containers.flac_stream_info(customers(spark, d, flac_tagged)).select("path", "sample_rate", "channels", "bits", "total_samples")


@query("B5_flac_comments", f"WITH {C} SELECT path, 'TITLE' AS name, name AS value FROM c UNION ALL SELECT path, 'LYRICS', '[00:01.00]' || seg || chr(10) || '[01:02.50]' || name FROM c")
def flac_comments(spark, d):
    return containers.flac_comments(customers(spark, d, flac_tagged))


@query("B5_flac_lyrics", f"WITH {C} SELECT path, 0 AS line_no, 1000 AS ts_ms, seg AS text FROM c UNION ALL SELECT path, 1, 62500, name FROM c")
def flac_lyrics(spark, d):
    return containers.lyric_lines(containers.flac_comments(customers(spark, d, flac_tagged)))


def _picture():
    return F.decode(F.expr("substring(content, CAST(pos AS INT) + 1, CAST(len AS INT))"), "ISO-8859-1").alias("picture")


@query("B5_flac_pictures", f"WITH {C} SELECT path, 'image/png' AS mime, seg AS picture FROM c")
def flac_pictures(spark, d):
    own = customers(spark, d, flac_tagged)
    return own.join(containers.flac_pictures(own), "path").select("path", "mime", _picture())


def id3_tagged(k: int, name: str, seg: str) -> bytes:
    """Version 2, 3 or 4 by the key."""
    n, s, at = name.encode("latin-1"), seg.encode("latin-1"), k % 100_000
    if k % 3 == 0:
        return fixtures.id3(2, [("TT2", b"\0" + n), ("PIC", b"\0PNG\x03d\0" + s)])
    if k % 3 == 2:
        return fixtures.id3(4, [("TALB", b"\x03" + f"ñ{name}".encode()), ("TIT2", b"\x02" + name.encode("utf-16-be")), ("PRIV", b"com.apple.streaming.transportStreamTimestamp\0" + (k * 90_000).to_bytes(8, "big"))])
    lines = b"\0eng\x02\x01\0" + s + b"\0" + at.to_bytes(4, "big") + n + b"\0" + (at + 1000).to_bytes(4, "big")
    own = [("TIT2", b"\x01" + name.encode("utf-16")), ("TPE1", b"\0" + s), ("COMM", b"\0engd\0" + n), ("APIC", b"\0image/png\0\x03d\0" + s), ("SYLT", lines), ("WOAF", b"http://c/%d" % k), ("XXXX", b"\0?")]
    return fixtures.id3(3, own)


@query(
    "B6_id3_texts",
    f"""WITH {C} SELECT path, 'TT2' AS tag, 'Title/Songname/Content description' AS label, name AS value, 0 AS enc FROM c WHERE k % 3 = 0
    UNION ALL SELECT path, 'TIT2', 'Title', name, CASE WHEN k % 3 = 1 THEN 1 ELSE 2 END FROM c WHERE k % 3 > 0 UNION ALL SELECT path, 'TPE1', 'Artist', seg, 0 FROM c WHERE k % 3 = 1
    UNION ALL SELECT path, 'COMM', 'Comment', name, 0 FROM c WHERE k % 3 = 1 UNION ALL SELECT path, 'WOAF', 'File URL', 'http://c/' || k, 0 FROM c WHERE k % 3 = 1 UNION ALL SELECT path, 'TALB', 'Album', 'ñ' || name, 3 FROM c WHERE k % 3 = 2""",
)
def id3_texts(spark, d):
    return containers.id3_texts(containers.id3_frames(customers(spark, d, id3_tagged))).select("path", "tag", "label", "value", "enc")


@query("B6_id3_pictures", f"WITH {C} SELECT path, CASE WHEN k % 3 = 0 THEN 'PNG' ELSE 'image/png' END AS mime, seg AS picture FROM c WHERE k % 3 < 2")
def id3_pictures(spark, d):
    own = customers(spark, d, id3_tagged)
    return own.join(containers.id3_pictures(containers.id3_frames(own)), "path").select("path", "mime", _picture())


@query("B6_id3_synced_lyrics", f"WITH {C} SELECT path, 0 AS line_no, k % 100000 AS ts_ms, seg AS text FROM c WHERE k % 3 = 1 UNION ALL SELECT path, 1, k % 100000 + 1000, name FROM c WHERE k % 3 = 1")
def id3_synced_lyrics(spark, d):
    return containers.id3_synced_lyrics(containers.id3_frames(customers(spark, d, id3_tagged)))


@query("B11_segment_timestamp", f"WITH {C} SELECT path, k::DOUBLE AS seconds FROM c WHERE k % 3 = 2")
def segment_timestamp(spark, d):
    return containers.segment_timestamp(containers.id3_frames(customers(spark, d, id3_tagged)))


@query(
    "B9_id3v1",
    f"""WITH {C} SELECT path, unnest(['title', 'artist', 'year', 'comment', 'track', 'genre']) AS field,
    unnest([name, seg, (1990 + k % 30)::VARCHAR, 'note', (1 + k % 200)::VARCHAR, (k % 192)::VARCHAR]) AS value FROM c""",
)
def id3v1(spark, d):
    return files.id3v1(customers(spark, d, lambda k, name, seg: b"audio" * 10 + fixtures.id3v1(name, seg, str(1990 + k % 30), 1 + k % 200, k % 192)))


# MPEG audio: a page is a stream of 1 to 20 frames.


def mp3_pages(spark: SparkSession, d: str, build: Callable[[int], bytes]) -> DataFrame:
    return built(table(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), "page_id"), build)


def mp3_file(k: int) -> bytes:
    n = 1 + k % 20
    return fixtures.mp3(n, tail=fixtures.id3v1("t", "a", "1999", 1, 1)) if k % 3 == 0 else fixtures.mp3(n, xing=1000 + k) if k % 3 == 1 else b"\xff\xfb\x90" * 3 + b"\0\0" + fixtures.mp3(n + 1)


@query("B7_mp3_info", "WITH p AS (SELECT page_id AS k, CASE page_id % 3 WHEN 0 THEN 1 + page_id % 20 WHEN 1 THEN 1000 + page_id ELSE 2 + page_id % 20 END AS n FROM pages WHERE page_id % 3 > 0 OR page_id % 20 > 0) SELECT k::VARCHAR AS path, n AS frames, 44100 AS sample_rate, round(n * 1152 / 44100.0::DOUBLE, 6) AS duration FROM p")
def mp3_info(spark, d):
    """One frame with a tag behind it isn't told from noise: no row."""
    return containers.mp3_info(mp3_pages(spark, d, mp3_file)).select("path", "frames", "sample_rate", F.round("duration", 6).alias("duration"))


@query("B17_mp3_sync", "SELECT page_id::VARCHAR AS path, 11 + unnest(range(2 + page_id % 20)) * 417 AS \"offset\" FROM pages")
def mp3_sync(spark, d):
    return containers.mp3_frame_rows(mp3_pages(spark, d, lambda k: b"\xff\xfb\x90" * 3 + b"\0\0" + fixtures.mp3(2 + k % 20))).select("path", "offset")


@query("C8_resync", "SELECT path, i * 417 + CASE WHEN i >= 2 THEN 5 ELSE 0 END AS \"offset\" FROM (SELECT page_id::VARCHAR AS path, unnest(range(4 + page_id % 20)) AS i FROM pages)")
def resync(spark, d):
    return containers.mp3_frame_rows(mp3_pages(spark, d, lambda k: fixtures.mp3(2) + b"\xff\0\0\0\0" + fixtures.mp3(2 + k % 20))).select("path", "offset")


def adts(n: int) -> bytes:
    size = n + 7
    return bytes([0xFF, 0xF1, 0x50, 0x80 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 31, 0xFC]) + bytes(n)


@query("B17_adts_sync", "SELECT page_id::VARCHAR AS path, 3 + unnest(range(2 + page_id % 5)) * (107 + page_id % 50) AS \"offset\", 44100 AS sample_rate, 2 AS channels FROM pages")
def adts_sync(spark, d):
    return containers.adts_frame_rows(mp3_pages(spark, d, lambda k: b"xyz" + adts(100 + k % 50) * (2 + k % 5))).select("path", "offset", "sample_rate", "channels")


# Ogg, MP4 and dispatch.


def opus_file(k: int, name: str, seg: str) -> bytes:
    tags = b"OpusTags" + fixtures.vorbis_comment([f"ARTIST={name}", f"TITLE={seg}"])
    first = bytes([k % 256, k % 64]) + b"a" * 508
    return (
        fixtures.ogg_page(0, 2, 0, [fixtures.opus_head(1 + k % 2, k % 1000)]) + fixtures.ogg_page(1, 0, 0, [tags]) + fixtures.ogg_page(2, 0, -1, [first], True)
        + fixtures.ogg_page(3, 1, 960, [b"b" * (k % 300), b"\x03\x05c"]) + fixtures.ogg_page(4, 4, 48_000 * k, [b"\x58d"])
    )


@query(
    "B12_ogg_packets",
    f"""WITH {C} SELECT path, 0 AS page_no, 0 AS granule, 19 AS bytes FROM c UNION ALL SELECT path, 1, 0, 41 + strlen(name) + strlen(seg) FROM c UNION ALL SELECT path, 3, -1, 510 + k % 300 FROM c
    UNION ALL SELECT path, 3, 960, 3 FROM c UNION ALL SELECT path, 4, 48000 * k, 2 FROM c""",
)
def ogg_packets(spark, d):
    return containers.ogg_packets(customers(spark, d, opus_file)).select("path", "page_no", "granule", F.octet_length("packet").alias("bytes"))


@query("B16_ogg_duration", f"WITH {C} SELECT path, 48000 * k AS last_granule, k::DOUBLE AS duration FROM c")
def ogg_duration(spark, d):
    return containers.ogg_duration(customers(spark, d, opus_file), 48_000)


@query(
    "B13_opus_packets",
    f"""WITH {C}, t AS (SELECT path, 3 AS page_no, k % 256 AS toc, k % 64 AS second FROM c UNION ALL SELECT path, 3, 3, 5 FROM c UNION ALL SELECT path, 4, 88, 100 FROM c), x AS (SELECT *, toc >> 3 AS config FROM t)
    SELECT path, page_no, CASE WHEN config < 12 THEN 'SILK' WHEN config < 16 THEN 'HYBRID' ELSE 'CELT' END AS mode,
    CASE WHEN config < 12 THEN [10000, 20000, 40000, 60000][1 + config % 4] WHEN config < 16 THEN [10000, 20000][1 + config % 2] ELSE [2500, 5000, 10000, 20000][1 + config % 4] END AS frame_us,
    toc & 4 <> 0 AS stereo, CASE toc & 3 WHEN 0 THEN 1 WHEN 3 THEN second & 63 ELSE 2 END AS frames FROM x""",
)
def opus_packets(spark, d):
    rows = containers.ogg_packets(customers(spark, d, opus_file)).where("page_no > 1")
    return files.opus_packet_info(rows).select("path", "page_no", "mode", "frame_us", "stereo", "frames")


@query("B13_opus_head", f"WITH {C} SELECT path, 1 + k % 2 AS channels, k % 1000 AS pre_skip, 48000 AS sample_rate, TRUE AS valid FROM c")
def opus_head(spark, d):
    rows = containers.ogg_packets(customers(spark, d, opus_file)).where("page_no = 0")
    return rows.select("path", files.opus_head(F.col("packet")).alias("h")).select("path", "h.channels", "h.pre_skip", "h.sample_rate", "h.valid")


@query("B13_opus_tags", f"WITH {C} SELECT path, 'ARTIST' AS name, name AS value FROM c UNION ALL SELECT path, 'TITLE', seg FROM c")
def opus_tags(spark, d):
    return containers.ogg_comments(containers.ogg_packets(customers(spark, d, opus_file))).select("path", "name", "value")


def vorbis_file(k: int, name: str, seg: str) -> bytes:
    head = b"\x01vorbis" + bytes(4) + b"\x02" + (44_100).to_bytes(4, "little") + bytes(4) + (1000 * k % 10**9).to_bytes(4, "little") + bytes(4) + bytes([9 + k % 3 << 4 | 6 + k % 3, 1])
    return fixtures.ogg_page(0, 2, 0, [head]) + fixtures.ogg_page(1, 0, 0, [b"\x03vorbis" + fixtures.vorbis_comment([f"title={name}"]) + b"\x01"])


def ogg_flac_file(k: int, name: str, seg: str) -> bytes:
    return fixtures.ogg_page(0, 2, 0, [b"\x7fFLAC\x01\0\0\x02fLaC" + bytes(38)]) + fixtures.ogg_page(1, 0, 0, [b"\x84" + bytes(3) + fixtures.vorbis_comment([f"ALBUM={seg}"])])


@query("B14_vorbis_head", f"WITH {C} SELECT path, 2 AS channels, 44100 AS sample_rate, 1000 * k % 1000000000 AS nominal_bitrate, 1 << (6 + k % 3) AS block0, 1 << (9 + k % 3) AS block1, TRUE AS valid FROM c")
def vorbis_head(spark, d):
    rows = containers.ogg_packets(customers(spark, d, vorbis_file)).where("page_no = 0")
    return rows.select("path", files.vorbis_head(F.col("packet")).alias("h")).select("path", "h.*")


@query("B15_ogg_comments", f"WITH {C} SELECT path, CASE WHEN k % 2 = 0 THEN 'TITLE' ELSE 'ALBUM' END AS name, CASE WHEN k % 2 = 0 THEN name ELSE seg END AS value FROM c")
def ogg_comments(spark, d):
    own = customers(spark, d, lambda k, name, seg: (ogg_flac_file if k % 2 else vorbis_file)(k, name, seg))
    return containers.ogg_comments(containers.ogg_packets(own))


def any_stream(k: int, name: str, seg: str) -> bytes:
    return [lambda: opus_file(k, name, seg), lambda: vorbis_file(k, name, seg), lambda: ogg_flac_file(k, name, seg), lambda: fixtures.mp3(2), lambda: adts(200), lambda: bytes(200)][k % 6]()


@query("A13_sniffed_codecs", f"WITH {C} SELECT path, ['OPUS', 'VORBIS', 'FLAC', 'MP3', 'AAC', 'MP3'][1 + k % 6] AS codec FROM c")
def sniffed_codecs(spark, d):
    kind = F.col("path").cast("long") % 6
    presumed = F.when(kind < 3, "OGG").when(kind == 3, "AAC").otherwise("MP3")
    return customers(spark, d, any_stream).select("path", files.sniff_codec(F.col("content"), presumed, True).alias("codec"))


def m4a_file(k: int, name: str, seg: str) -> bytes:
    return fixtures.m4a(name, k % 1000, seg.encode(), 44_100 * (k % 90_000), 100 + k % 50)


@query("B10_m4a_info", f"WITH {C} SELECT path, 44100 AS timescale, (k % 90000)::DOUBLE AS duration, 'mp4a' AS codec, TRUE AS valid, 100 + k % 50 AS data_size FROM c")
def m4a_info(spark, d):
    return containers.m4a_info(customers(spark, d, m4a_file)).select("path", "timescale", "duration", "codec", "valid", "data_size")


@query("B10_m4a_tags", f"WITH {C} SELECT path, '©nam' AS atom, 'Title' AS label, name AS value FROM c UNION ALL SELECT path, 'trkn', 'Track-Number', (k % 1000) || '/9' FROM c")
def m4a_tags(spark, d):
    return containers.m4a_tags(customers(spark, d, m4a_file))


@query("B10_m4a_cover", f"WITH {C} SELECT path, strlen(seg) AS len FROM c")
def m4a_cover(spark, d):
    return containers.m4a_cover(customers(spark, d, m4a_file)).select("path", "len")


@query("E6_m4a_seek", f"WITH {C} SELECT path AS stream_id, t AS sample_no, [0, 10, 30, 60][1 + t] AS \"offset\" FROM (SELECT path, CASE WHEN k % 100 = 0 THEN 0 WHEN k % 100 <= 10 THEN 1 WHEN k % 100 <= 30 THEN 2 ELSE 3 END AS t FROM c WHERE k % 100 <= 60)")
def m4a_seek(spark, d):
    sizes = containers.m4a_sample_sizes(customers(spark, d, m4a_file))
    return running.sample_offset(sizes.withColumn("target", F.col("stream_id").cast("long") % 100))


def any_file(k: int, name: str, seg: str) -> bytes:
    short = [(i - 5,) for i in range(9)]
    return [lambda: fixtures.wav(short, 16, 8000 + k % 1000), lambda: flac_tagged(k, name, seg), lambda: m4a_file(k, name, seg), lambda: vorbis_file(k, name, seg), lambda: fixtures.mp3(2), lambda: b"none of these"][k % 6]()


@query("B19_header_dispatch", f"WITH {C} SELECT path, ['WAV', 'FLAC', 'M4A', 'VORBIS', 'MP3', NULL][1 + k % 6] AS codec, CASE WHEN k % 6 = 0 THEN 8000 + k % 1000 WHEN k % 6 < 4 THEN 44100 END AS rate FROM c")
def header_dispatch(spark, d):
    return dispatch.stream_headers(customers(spark, d, any_file))


CODECS = ["WAV", "MP3", "AAC", "M4A", "FLAC", "OGG", "OPUS", "VORBIS"]


@query("A16_frame_sizes", f"SELECT p_partkey, [4096, 18000, 18000, 18000, 65535, 65535, 65535, 65535][1 + p_partkey % 8] AS bytes FROM part")
def frame_sizes(spark, d):
    codec = F.element_at(F.array(*map(F.lit, CODECS)), (1 + F.col("p_partkey") % 8).cast("int"))
    return table(spark, d, "part").select("p_partkey", decoders.max_frame_size(codec).alias("bytes"))


@query("A18_byte_reads", f"WITH {C} SELECT path, [0, 8, 12, 24][1 + k % 4] AS place, ['RIFF', 'WAVE', 'fmt ', NULL][1 + k % 4] AS word, CASE WHEN k % 4 = 3 THEN 8000 + k % 1000 END AS number FROM c")
def byte_reads(spark, d):
    k = F.col("path").cast("long")
    place = F.element_at(F.array(*map(F.lit, (0, 8, 12, 24))), (1 + k % 4).cast("int"))
    own = customers(spark, d, lambda k, name, seg: fixtures.wav([(i,) for i in range(9)], 16, 8000 + k % 1000)).withColumn("place", place)
    word, number = F.decode(files.at(F.col("content"), F.col("place"), 4), "ISO-8859-1"), files.le(F.col("content"), F.col("place"), 4)
    return own.select("path", "place", F.when(k % 4 < 3, word).alias("word"), F.when(k % 4 == 3, number).alias("number"))


# Transport framing.


@query("B3_ts_audio", f"WITH {C}, t AS (SELECT path, 3 AS packet_no, name AS part FROM c UNION ALL SELECT path, 4, seg FROM c) SELECT path AS stream_id, packet_no, 258 AS pid, part AS data FROM t")
def ts_audio(spark, d):
    packets = files.ts_packets(customers(spark, d, lambda k, name, seg: fixtures.transport_stream([name.encode(), seg.encode()]), "stream_id"))
    return files.ts_audio(packets).select("stream_id", "packet_no", "pid", F.decode("data", "UTF-8").alias("data"))


@query(
    "B1_chunked",
    """WITH t AS (SELECT page_id, encode(html) AS b FROM pages WHERE html <> ''), h AS (SELECT *, octet_length(b) AS n FROM t)
    SELECT page_id::VARCHAR AS stream_id, 6 + length(to_hex(n)) AS position, sha256(b) AS digest FROM h""",
)
def chunked(spark, d):
    """A page's body in one chunk and a trailer."""
    pages = table(spark, d, "pages").where("html != ''").select(F.col("page_id").cast("string").alias("stream_id"), "html")
    rows = containers.chunks(built(pages, lambda html: fixtures.chunked([html.encode()]), "stream_id"))
    return rows.select("stream_id", "position", F.sha2("data", 256).alias("digest"))


def icy_body(k: int, name: str, seg: str) -> bytes:
    return fixtures.icy(32, [name.encode(), seg.encode(), b"c"], [f"StreamTitle='{name}';".encode(), b"", b"x song_spot=\"T\" y"])


ICY = f"""{C}, i AS (SELECT path, 32 AS audio_pos, rpad(name, 32, '.') AS audio, 'StreamTitle=''' || name || ''';' AS meta FROM c UNION ALL SELECT path, 64, rpad(seg, 32, '.'), NULL FROM c
    UNION ALL SELECT path, 96, rpad('c', 32, '.'), 'x song_spot' FROM c)"""


@query("B2_icy_blocks", f"WITH {ICY} SELECT path AS stream_id, audio_pos, audio, meta FROM i")
def icy_blocks(spark, d):
    return containers.icy_blocks(customers(spark, d, icy_body, "stream_id"), 32).select("stream_id", "audio_pos", F.decode("audio", "UTF-8").alias("audio"), "meta")


@query("A10_chunked_titles", f"WITH {ICY} SELECT path AS stream_id, audio_pos, audio, meta FROM i")
def chunked_titles(spark, d):
    def body(k: int, name: str, seg: str) -> bytes:
        b = icy_body(k, name, seg)
        cut = 1 + k % (len(b) - 1)
        return fixtures.chunked([b[:cut], b[cut:]])

    return web.chunked_titles(customers(spark, d, body, "stream_id"), 32).select("stream_id", "audio_pos", F.decode("audio", "UTF-8").alias("audio"), "meta")


@query("K7_resumed_titles", "SELECT s_suppkey::VARCHAR AS stream_id, 32 AS audio_pos, 'StreamTitle=''' || s_name || ''';' AS meta FROM supplier UNION ALL SELECT s_suppkey::VARCHAR, 96, 'x song_spot=\"T\" y' FROM supplier")
def resumed_titles(spark, d):
    """Each supplier is a station whose bytes come in pieces of 13, over two triggers."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("stream_id"), "s_suppkey", "s_name", F.lit("seg").alias("seg"))
    whole = built(rows, icy_body, "stream_id")
    at = whole.select("stream_id", "content", F.explode(F.expr("sequence(0L, CAST(octet_length(content) AS BIGINT) - 1, 13L)")).alias("offset"))
    pieces = at.select("stream_id", "offset", F.expr("substring(content, CAST(offset AS INT) + 1, 13)").alias("data"))
    return run(stateful.icy_titles(from_rows(pieces, "pieces"), 32), "titles")


@query("K7_resumed_transport", "SELECT s_suppkey::VARCHAR AS stream_id, unnest([3, 4]) AS packet_no, 258 AS pid, unnest([s_name, 'seg']) AS data FROM supplier")
def resumed_transport(spark, d):
    """Each supplier is a transport stream whose bytes come in pieces of 301, over two triggers."""
    rows = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("stream_id"), "s_name")
    whole = built(rows, lambda name: fixtures.transport_stream([name.encode(), b"seg"]), "stream_id")
    at = whole.select("stream_id", "content", F.explode(F.expr("sequence(0L, CAST(octet_length(content) AS BIGINT) - 1, 301L)")).alias("offset"))
    pieces = at.select("stream_id", "offset", F.expr("substring(content, CAST(offset AS INT) + 1, 301)").alias("data"))
    return run(stateful.ts_audio(from_rows(pieces, "packets")), "transport").select("stream_id", "packet_no", "pid", F.decode("data", "UTF-8").alias("data"))


@query(
    "K8_state_per_stream",
    f"""WITH s AS (SELECT event_id % 7 AS k, event_id // 7 AS frame_no, least(abs({V16} * 65536) >> 23, 255) AS v FROM events)
    SELECT k::VARCHAR AS stream_id, frame_no // 8 AS window_no, (sum(v)::BIGINT // 8)::INTEGER AS left_mean FROM s GROUP BY k, frame_no // 8 HAVING count(*) = 8""",
)
def state_per_stream(spark, d):
    e = from_table(spark, d, "events")
    pcm = e.select((F.col("event_id") % 7).cast("string").alias("stream_id"), F.expr("event_id div 7").alias("frame_no"), sample().alias("left"), F.lit(0).alias("right"))
    return run(stateful.vu_windows(pcm, 8), "states").select("stream_id", "window_no", "left_mean")


@query(
    "A27_stream_fresh",
    """WITH s AS (SELECT s_suppkey::VARCHAR AS playlist_id, s_suppkey AS k FROM supplier) SELECT playlist_id, 0 AS fetch_no, unnest([k || 'a', k || 'b']) AS url FROM s
    UNION ALL SELECT playlist_id, 1, k || 'c' FROM s WHERE k % 2 = 0 UNION ALL SELECT playlist_id, 1, unnest([k || 'x', k || 'y']) FROM s WHERE k % 2 = 1""",
)
def stream_fresh(spark, d):
    """Each supplier's playlist is fetched twice: it has grown by one segment, or all are new."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))

    def fetched(n: int, names: str):
        return F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(names)])

    second = F.when(F.col("k") % 2 == 0, fetched(1, "abc")).otherwise(fetched(1, "xy"))
    rows = s.select("k", F.explode(F.concat(fetched(0, "ab"), second)).alias("x")).select(F.col("k").cast("string").alias("playlist_id"), F.col("x.n").cast("long").alias("fetch_no"), F.col("x.i").alias("line_no"), F.concat(F.col("k").cast("string"), "x.c").alias("url"))
    return run(stateful.fresh_segments(from_rows(rows, "fetches", 1)), "fresh").select("playlist_id", "fetch_no", "url")
