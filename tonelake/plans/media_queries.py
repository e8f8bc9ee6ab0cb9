"""Queries over media bytes: containers, tags, framing and decoding. Their files are fixtures, so the SQL states the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.operators import lookups, running
from tonelake.plans import fixtures, playback
from tonelake.plans.bindings import ONE_SQL, many_streams, one_stream
from tonelake.plans.settings import Settings
from tonelake.plans.signal_queries import GAIN_SQL
from tonelake.sources import containers, decoders, dispatch, files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _files(spark, items: dict[str, bytes], key: str = "path"):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in items.items()], f"{key} string, content binary")


def _wavs() -> dict[str, bytes]:
    frames = [(i * 3 % 200,) for i in range(50)]
    wide = [(i * 700 - 16_000, 16_000 - i * 700) for i in range(50)]
    return {
        "8": fixtures.wav(frames, 8), "16": fixtures.wav(wide, 16, 44_100), "24": fixtures.wav([(a * 256, b * 256) for a, b in wide], 24, extra=b"\0\0"), "32": fixtures.wav([(a * 65536,) for a, _ in wide], 32), "no": b"RIFFxxxxNOPE",
    }


@query(
    "B4_wav_info",
    "SELECT * FROM (VALUES ('8', 1, 8000, 8, 50, 64000), ('16', 2, 44100, 16, 200, 1411200), ('24', 2, 8000, 24, 300, 384000), ('32', 1, 8000, 32, 200, 256000)) v(path, channels, sample_rate, bits, data_size, bitrate)",
)
def wav_info(spark, d):
    return files.wav_info(_files(spark, _wavs())).where("valid").select("path", "channels", "sample_rate", "bits", "data_size", "bitrate")


@query(
    "C1_wav_samples",
    """WITH i AS (SELECT range AS i FROM range(50)) SELECT '8' AS path, i AS frame_no, ((i * 3 % 200 - 128) * 16777216)::INTEGER AS l, ((i * 3 % 200 - 128) * 16777216)::INTEGER AS r FROM i
    UNION ALL SELECT '16', i, ((i * 700 - 16000) * 65536)::INTEGER, ((16000 - i * 700) * 65536)::INTEGER FROM i UNION ALL SELECT '24', i, ((i * 700 - 16000) * 65536)::INTEGER, ((16000 - i * 700) * 65536)::INTEGER FROM i
    UNION ALL SELECT '32', i, ((i * 700 - 16000) * 65536)::INTEGER, ((i * 700 - 16000) * 65536)::INTEGER FROM i""",
)
def wav_samples(spark, d):
    return files.wav_samples(_files(spark, _wavs())).select(F.col("stream_id").alias("path"), "frame_no", F.col("left").alias("l"), F.col("right").alias("r"))


KINDS = ["constant", "verbatim", "fixed2", "lpc"]


def _wave(k: int) -> tuple[list[int], list[int]]:
    left = [5 * k] * 40 if k % 4 == 0 else [(i * i * (k + 1)) % 97 - 40 for i in range(40)]
    right = [7 * k] * 40 if k % 4 == 0 else [(i * (k + 3)) % 89 - 30 for i in range(40)]
    return left, right


def _flac() -> dict[str, bytes]:
    frames = [fixtures.flac_frame(k, *_wave(k), KINDS[k % 4], (1, 8, 9, 10)[k // 4]) for k in range(16)]
    return {"f": fixtures.flac(frames, 640, ["TITLE=Tón", "LYRICS=[00:01.00]one\n[00:02.50]two"], b"PNGPNG")}


@query(
    "C2_flac_samples",
    """WITH s AS (SELECT k.range AS k, i.range AS i FROM range(16) k, range(40) i), v AS (SELECT k * 40 + i AS frame_no, CASE WHEN k % 4 = 0 THEN 5 * k ELSE (i * i * (k + 1)) % 97 - 40 END AS l, CASE WHEN k % 4 = 0 THEN 7 * k ELSE (i * (k + 3)) % 89 - 30 END AS r FROM s)
    SELECT frame_no, (l * 65536)::INTEGER AS l, (r * 65536)::INTEGER AS r FROM v""",
)
def flac_samples(spark, d):
    return decoders.flac_pcm(_files(spark, _flac())).select("frame_no", F.col("left").alias("l"), F.col("right").alias("r"))


@query("B5_flac_stream_info", "SELECT 'f' AS path, 44100 AS sample_rate, 2 AS channels, 16 AS bits, 640 AS total_samples")
def flac_stream_info(spark, d):
    return containers.flac_stream_info(_files(spark, _flac())).select("path", "sample_rate", "channels", "bits", "total_samples")


@query("B5_flac_comments", "SELECT * FROM (VALUES ('TITLE', 'Tón'), ('LYRICS', '[00:01.00]one' || chr(10) || '[00:02.50]two')) v(name, value)")
def flac_comments(spark, d):
    return containers.flac_comments(_files(spark, _flac())).select("name", "value")


@query("B5_flac_lyrics", "SELECT * FROM (VALUES (0, 1000, 'one'), (1, 2500, 'two')) v(line_no, ts_ms, text)")
def flac_lyrics(spark, d):
    return containers.lyric_lines(containers.flac_comments(_files(spark, _flac()))).drop("path")


@query("B5_flac_pictures", "SELECT 'image/png' AS mime, 'PNGPNG' AS picture")
def flac_pictures(spark, d):
    own = _files(spark, _flac())
    at = containers.flac_pictures(own)
    return own.join(at, "path").select("mime", F.decode(F.expr("substring(content, CAST(pos AS INT) + 1, CAST(len AS INT))"), "ISO-8859-1").alias("picture"))


def _id3() -> dict[str, bytes]:
    sylt = b"\0eng\x02\x01\0" + b"la\0" + (1500).to_bytes(4, "big") + b"lo\0" + (2500).to_bytes(4, "big")
    utf16 = b"\x01" + "Tón".encode("utf-16")
    v3 = fixtures.id3(3, [("TIT2", utf16), ("TPE1", b"\0Caf\xe9"), ("COMM", b"\0engd\0note"), ("APIC", b"\0image/png\0\x03d\0PIX"), ("SYLT", sylt), ("WOAF", b"http://f"), ("XXXX", b"\0?")])
    v4 = fixtures.id3(4, [("TALB", b"\x03" + "ñ".encode() * 100), ("TIT2", b"\x02" + "ab".encode("utf-16-be"))])
    return {"2": fixtures.id3(2, [("TT2", b"\0Two"), ("PIC", b"\0PNG\x03d\0PX")]), "3": v3, "4": v4 + fixtures.id3(3, [("TPE1", b"\0chained")]), "none": b"RIFF"}


@query(
    "B6_id3_texts",
    f"""SELECT * FROM (VALUES ('2', 'TT2', 'Title/Songname/Content description', 'Two', 0), ('3', 'TIT2', 'Title', 'Tón', 1), ('3', 'TPE1', 'Artist', 'Café', 0), ('3', 'COMM', 'Comment', 'note', 0), ('3', 'WOAF', 'File URL', 'http://f', 0),
    ('4', 'TALB', 'Album', '{"ñ" * 100}', 3), ('4', 'TIT2', 'Title', 'ab', 2), ('4', 'TPE1', 'Artist', 'chained', 0)) v(path, tag, label, value, enc)""",
)
def id3_texts(spark, d):
    return containers.id3_texts(containers.id3_frames(_files(spark, _id3()))).select("path", "tag", "label", "value", "enc")


@query("B6_id3_pictures", "SELECT * FROM (VALUES ('2', 'PNG', 'PX'), ('3', 'image/png', 'PIX')) v(path, mime, picture)")
def id3_pictures(spark, d):
    own = _files(spark, _id3())
    at = containers.id3_pictures(containers.id3_frames(own))
    return own.join(at, "path").select("path", "mime", F.decode(F.expr("substring(content, CAST(pos AS INT) + 1, CAST(len AS INT))"), "ISO-8859-1").alias("picture"))


@query("B6_id3_synced_lyrics", "SELECT * FROM (VALUES (0, 1500, 'la'), (1, 2500, 'lo')) v(line_no, ts_ms, text)")
def id3_synced_lyrics(spark, d):
    return containers.id3_synced_lyrics(containers.id3_frames(_files(spark, _id3()))).drop("path")


@query("B11_segment_timestamp", "SELECT 'seg' AS path, 10.0::DOUBLE AS seconds")
def segment_timestamp(spark, d):
    body = b"com.apple.streaming.transportStreamTimestamp\0" + (900_000).to_bytes(8, "big")
    return containers.segment_timestamp(containers.id3_frames(_files(spark, {"seg": fixtures.id3(4, [("PRIV", body)])})))


def _mp3() -> dict[str, bytes]:
    v1 = fixtures.id3v1("Tón", "Café", "1999", 7, 17)
    return {"cbr": fixtures.mp3(20, tail=v1), "xing": fixtures.mp3(3, xing=1000), "noise": b"\xff\xfb\x90" * 3 + b"\0\0" + fixtures.mp3(4)}


@query("B7_mp3_info", "SELECT * FROM (VALUES ('cbr', 20, 44100, round(20 * 1152 / 44100.0::DOUBLE, 6)), ('xing', 1000, 44100, round(1000 * 1152 / 44100.0::DOUBLE, 6)), ('noise', 4, 44100, round(4 * 1152 / 44100.0::DOUBLE, 6))) v(path, frames, sample_rate, duration)")
def mp3_info(spark, d):
    return containers.mp3_info(_files(spark, _mp3())).select("path", "frames", "sample_rate", F.round("duration", 6).alias("duration"))


@query("B17_mp3_sync", "SELECT 'noise' AS path, 11 + range * 417 AS \"offset\" FROM range(4)")
def mp3_sync(spark, d):
    return containers.mp3_frame_rows(_files(spark, {"noise": _mp3()["noise"]})).select("path", "offset")


@query("B9_id3v1", "SELECT * FROM (VALUES ('cbr', 'title', 'Tón'), ('cbr', 'artist', 'Café'), ('cbr', 'year', '1999'), ('cbr', 'comment', 'note'), ('cbr', 'track', '7'), ('cbr', 'genre', '17')) v(path, field, value)")
def id3v1(spark, d):
    return files.id3v1(_files(spark, _mp3()))


def _ogg() -> dict[str, bytes]:
    tags = b"OpusTags" + fixtures.vorbis_comment(["ARTIST=Ä", "TITLE=x"])
    pages = fixtures.ogg_page(0, 2, 0, [fixtures.opus_head()]) + fixtures.ogg_page(1, 0, 0, [tags]) + fixtures.ogg_page(2, 0, -1, [b"\xfc" + b"a" * 509], True) + fixtures.ogg_page(3, 1, 960, [b"b" * 10, b"\x03\x05c"]) + fixtures.ogg_page(4, 4, 96_000, [b"\x58d"])
    return {"o": pages}


@query("B12_ogg_packets", "SELECT * FROM (VALUES (0, 0, 19), (1, 0, 44), (3, -1, 520), (3, 960, 3), (4, 96000, 2)) v(page_no, granule, bytes)")
def ogg_packets(spark, d):
    return containers.ogg_packets(_files(spark, _ogg())).select("page_no", "granule", F.octet_length("packet").alias("bytes"))


@query("B16_ogg_duration", "SELECT 'o' AS path, 96000 AS last_granule, 2.0::DOUBLE AS duration")
def ogg_duration(spark, d):
    return containers.ogg_duration(_files(spark, _ogg()), 48_000)


@query("B13_opus_packets", "SELECT * FROM (VALUES (3, 'CELT', 20000, TRUE, 1), (3, 'SILK', 10000, FALSE, 5), (4, 'SILK', 60000, FALSE, 1)) v(page_no, mode, frame_us, stereo, frames)")
def opus_packets(spark, d):
    rows = containers.ogg_packets(_files(spark, _ogg())).where("page_no > 1")
    return files.opus_packet_info(rows).select("page_no", "mode", "frame_us", "stereo", "frames")


@query("B13_opus_head", "SELECT 2 AS channels, 312 AS pre_skip, 48000 AS sample_rate, TRUE AS valid")
def opus_head(spark, d):
    rows = containers.ogg_packets(_files(spark, _ogg())).where("page_no = 0")
    return rows.select(files.opus_head(F.col("packet")).alias("h")).select("h.channels", "h.pre_skip", "h.sample_rate", "h.valid")


@query("B13_opus_tags", "SELECT * FROM (VALUES ('ARTIST', 'Ä'), ('TITLE', 'x')) v(name, value)")
def opus_tags(spark, d):
    return containers.ogg_comments(containers.ogg_packets(_files(spark, _ogg()))).select("name", "value")


def _vorbis() -> dict[str, bytes]:
    head = b"\x01vorbis" + bytes(4) + b"\x02" + (44_100).to_bytes(4, "little") + bytes(4) + (128_000).to_bytes(4, "little") + bytes(4) + b"\xb8\x01"
    tags = b"\x03vorbis" + fixtures.vorbis_comment(["title=v"]) + b"\x01"
    lac = b"\x7fFLAC\x01\0\0\x02fLaC" + bytes(38)
    return {"v": fixtures.ogg_page(0, 2, 0, [head]) + fixtures.ogg_page(1, 0, 0, [tags]), "l": fixtures.ogg_page(0, 2, 0, [lac]) + fixtures.ogg_page(1, 0, 0, [b"\x84" + bytes(3) + fixtures.vorbis_comment(["ALBUM=l"])])}


@query("B14_vorbis_head", "SELECT 2 AS channels, 44100 AS sample_rate, 128000 AS nominal_bitrate, 256 AS block0, 2048 AS block1, TRUE AS valid")
def vorbis_head(spark, d):
    rows = containers.ogg_packets(_files(spark, {"v": _vorbis()["v"]})).where("page_no = 0")
    return rows.select(files.vorbis_head(F.col("packet")).alias("h")).select("h.*")


@query("B15_ogg_comments", "SELECT * FROM (VALUES ('v', 'TITLE', 'v'), ('l', 'ALBUM', 'l')) v(path, name, value)")
def ogg_comments(spark, d):
    return containers.ogg_comments(containers.ogg_packets(_files(spark, _vorbis())))


@query("A13_sniffed_codecs", "SELECT * FROM (VALUES ('o', 'OPUS'), ('v', 'VORBIS'), ('l', 'FLAC'), ('m', 'MP3'), ('a', 'AAC'), ('x', 'MP3')) v(path, codec)")
def sniffed_codecs(spark, d):
    items = _ogg() | _vorbis() | {"m": fixtures.mp3(2), "a": b"\xff\xf1\x50\x80" + bytes(200), "x": bytes(200)}
    presumed = F.when(F.col("path").isin("o", "v", "l"), "OGG").when(F.col("path") == "m", "AAC").otherwise("MP3")
    return _files(spark, items).select("path", files.sniff_codec(F.col("content"), presumed, True).alias("codec"))


@query("B10_m4a_info", "SELECT 44100 AS timescale, 10.0::DOUBLE AS duration, 'mp4a' AS codec, TRUE AS valid, 100 AS data_size")
def m4a_info(spark, d):
    return containers.m4a_info(_files(spark, {"m": fixtures.m4a()})).select("timescale", "duration", "codec", "valid", "data_size")


@query("B10_m4a_tags", "SELECT * FROM (VALUES ('©nam', 'Title', 'Tón'), ('trkn', 'Track-Number', '3/9')) v(atom, label, value)")
def m4a_tags(spark, d):
    return containers.m4a_tags(_files(spark, {"m": fixtures.m4a()})).drop("path")


@query("B10_m4a_cover", "SELECT 6 AS len")
def m4a_cover(spark, d):
    return containers.m4a_cover(_files(spark, {"m": fixtures.m4a()})).select("len")


@query("E6_m4a_seek", "SELECT 'm' AS stream_id, 2 AS sample_no, 30 AS \"offset\"")
def m4a_seek(spark, d):
    sizes = containers.m4a_sample_sizes(_files(spark, {"m": fixtures.m4a()}))
    return running.sample_offset(sizes.withColumn("target", F.lit(25)))


@query("B19_header_dispatch", "SELECT * FROM (VALUES ('16', 'WAV', 44100), ('f', 'FLAC', 44100), ('m', 'M4A', 44100), ('v', 'VORBIS', 44100), ('3', 'MP3', NULL), ('x', NULL, NULL)) v(path, codec, rate)")
def header_dispatch(spark, d):
    items = {"16": _wavs()["16"], "m": fixtures.m4a(), "v": _vorbis()["v"], "3": fixtures.mp3(2), "x": b"none of these"} | _flac()
    return dispatch.stream_headers(_files(spark, items))


@query("A16_frame_sizes", "SELECT * FROM (VALUES ('MP3', 18000), ('FLAC', 65535), ('WAV', 4096)) v(codec, bytes)")
def frame_sizes(spark, d):
    return spark.createDataFrame([("MP3",), ("FLAC",), ("WAV",)], "codec string").select("codec", decoders.max_frame_size(F.col("codec")).alias("bytes"))


@query("A18_byte_reads", "SELECT * FROM (VALUES (0, 'RIFF'), (8, 'WAVE'), (12, 'fmt ')) v(place, word)")
def byte_reads(spark, d):
    at = spark.createDataFrame([(0,), (8,), (12,)], "place int")
    return at.withColumn("content", F.lit(bytearray(_wavs()["16"]))).select("place", F.decode(files.at(F.col("content"), F.col("place"), 4), "ISO-8859-1").alias("word"))


TS = [b"A" * 100, b"B" * 184, b"C" * 50]


@query("B3_ts_audio", "SELECT * FROM (VALUES (3, 258, 100, 'A'), (4, 258, 184, 'B'), (5, 258, 50, 'C')) v(packet_no, pid, bytes, first)")
def ts_audio(spark, d):
    packets = files.ts_packets(_files(spark, {"t": fixtures.transport_stream(TS)}, "stream_id"))
    return files.ts_audio(packets).select("packet_no", "pid", F.octet_length("data").alias("bytes"), F.decode(F.substring("data", 1, 1), "ISO-8859-1").alias("first"))


@query("B1_chunked", "SELECT * FROM (VALUES (7, 'hello'), (21, 'world!')) v(position, data)")
def chunked(spark, d):
    rows = containers.chunks(_files(spark, {"c": fixtures.chunked([b"hello", b"world!"])}, "stream_id"))
    return rows.select("position", F.decode("data", "UTF-8").alias("data"))


@query("B2_icy_blocks", "SELECT * FROM (VALUES (8, 'aaa.....', 'StreamTitle=''é'';'), (16, 'bbb.....', NULL), (24, 'ccc.....', 'x song_spot')) v(audio_pos, audio, meta)")
def icy_blocks(spark, d):
    body = fixtures.icy(8, [b"aaa", b"bbb", b"ccc"], [b"StreamTitle='\xe9';", b"", b"x song_spot=\"T\" y"])
    return containers.icy_blocks(_files(spark, {"i": body}, "stream_id"), 8).select("audio_pos", F.decode("audio", "UTF-8").alias("audio"), "meta")


@query("C8_resync", "SELECT range * 417 + CASE WHEN range >= 2 THEN 5 ELSE 0 END AS \"offset\" FROM range(5)")
def resync(spark, d):
    broken = fixtures.mp3(2) + b"\xff\0\0\0\0" + fixtures.mp3(3)
    return containers.mp3_frame_rows(_files(spark, {"b": broken})).select("offset")


@query("B17_adts_sync", "SELECT 3 + range * 107 AS \"offset\", 44100 AS sample_rate, 2 AS channels FROM range(3)")
def adts_sync(spark, d):
    head = bytes([0xFF, 0xF1, 0x50, 0x80 | 107 >> 11, 107 >> 3 & 255, (107 & 7) << 5 | 31, 0xFC])
    return containers.adts_frame_rows(_files(spark, {"a": b"xyz" + (head + bytes(100)) * 3})).select("offset", "sample_rate", "channels")


@query("L2_playback", f"WITH {ONE_SQL}, m AS (SELECT frame_no, ((l::BIGINT + r::BIGINT) >> 1) AS m FROM pcm) SELECT frame_no, {GAIN_SQL.format('m', '1.0')} AS l, {GAIN_SQL.format('m', '1.0')} AS r FROM m")
def played(spark, d):
    return playback.play(one_stream(spark, d), 44_100, Settings(force_mono=True)).samples.select("frame_no", F.col("left").alias("l"), F.col("right").alias("r"))


@query("L5_output_hook", f"WITH {ONE_SQL} SELECT frame_no FROM pcm WHERE l > 0")
def output_hook(spark, d):
    return playback.play(one_stream(spark, d), 44_100, Settings(volume_control=False), output_hook=lambda x: x.withColumn("keep", F.col("left") > 0)).samples.select("frame_no")


@query("L4_raw_hook", f"WITH {ONE_SQL} SELECT frame_no, (-(l::BIGINT))::INTEGER AS l FROM pcm")
def raw_hook(spark, d):
    return playback.play(one_stream(spark, d), 44_100, Settings(volume_control=False), raw_hook=lambda x: x.withColumn("left", (-F.col("left").cast("bigint")).cast("int"))).samples.select("frame_no", F.col("left").alias("l"))


@query("L6_volume_curve", f"WITH {ONE_SQL} SELECT frame_no, {GAIN_SQL.format('l', 'pow(10.0::DOUBLE, (-30.0::DOUBLE) / 20.0)')} AS l FROM pcm")
def volume_curve(spark, d):
    return playback.play(one_stream(spark, d), 44_100, Settings(volume=21, volume_steps=42), curve=lambda t: t * 60.0 - 60.0).samples.select("frame_no", F.col("left").alias("l"))


@query("L3_vu_events", "SELECT user_id::VARCHAR AS stream_id, unnest(range(count(*) // 8)) AS seq, 14 AS e, 'VU' AS s FROM events GROUP BY user_id")
def vu_events(spark, d):
    from tonelake.operators import meters

    return playback.vu_events(meters.vu_windows(many_streams(spark, d), 8)).select("stream_id", "seq", "e", "s")


@query("J4_wav_alignment", "SELECT range AS target, (range // 4) * 4 + 44 AS at FROM range(64)")
def wav_alignment(spark, d):
    return spark.range(64).select(F.col("id").alias("target"), running.aligned(F.col("id"), 44, 4).alias("at"))


@query("A17_play_order", "SELECT * FROM (VALUES ('d/c.mp3', 1), ('d/b.mp3', 2), ('d/a.mp3', 3), ('e/z.wav', 1)) v(path, play_no)")
def play_order(spark, d):
    rows = spark.createDataFrame([("d/a.mp3",), ("d/c.mp3",), ("d/b.mp3",), ("e/z.wav",)], "path string")
    return files.play_order(rows).select("path", "play_no")


@query("A7_local_files", "SELECT 'PAR1' AS magic")
def local_files(spark, d):
    found = files.media_files(spark, f"{d}/region.parquet", "*.parquet", recursive=False)
    return found.select(files.ascii(F.col("content"), 0, 4).alias("magic")).distinct()


@query("A2_url_expectation", "SELECT * FROM (VALUES ('http://h/a.m3u8?x=1', 'M3U8'), ('http://h/b.mp3', 'MP3'), ('http://h/', NULL)) v(url, kind)")
def url_expectation(spark, d):
    return spark.createDataFrame([("http://h/a.m3u8?x=1",), ("http://h/b.mp3",), ("http://h/",)], "url string").select("url", lookups.url_expectation(F.col("url")).alias("kind"))
