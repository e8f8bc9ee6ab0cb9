"""Media files as rows, and fields read straight from their bytes by native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.functions import signal, text
from tonelake.operators import lookups


def media_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, content, codec) of files; the codec comes from the extension and is null for others."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", "length", "content", lookups.extension_codec(F.col("path")).alias("codec"))


def play_order(files: DataFrame) -> DataFrame:
    """Adds play_no: within a folder, files in reverse order of their names."""
    folder = F.regexp_extract("path", r"^(.*)/", 1)
    return files.withColumn("play_no", F.row_number().over(Window.partitionBy(folder).orderBy(F.col("path").desc())))


def at(content: Column, offset: Column | int, n: Column | int) -> Column:
    """``n`` bytes from an offset, counted from 0 and held within the content."""
    offset = offset if isinstance(offset, Column) else F.lit(offset)
    return F.substring(content, F.greatest(offset, F.lit(0)).cast("int") + 1, n if isinstance(n, Column) else F.lit(n))


def le(content: Column, offset: Column | int, n: int) -> Column:
    return text.little_endian(at(content, offset, n))


def be(content: Column, offset: Column | int, n: int) -> Column:
    return text.big_endian(at(content, offset, n))


def ascii(content: Column, offset: Column | int, n: int) -> Column:
    return F.decode(at(content, offset, n), "ISO-8859-1")


def sniff_codec(content: Column, presumed: Column, web_stream: bool) -> Column:
    """The codec that the first bytes show: what an Ogg stream holds, and ADTS, LATM or MP3 frames of web streams."""
    head = at(content, 0, 127)
    inside = [F.when(text.bytes_index_of(head, m) >= 28, k) for m, k in ((b"vorbis", "VORBIS"), (b"fLaC", "FLAC"), (b"OpusHead", "OPUS"))]
    ogg = F.when(text.bytes_index_of(head, b"OggS") == 0, F.coalesce(*inside))
    b0, b1 = be(content, 0, 1), be(content, 1, 1)
    frame = F.when((b0 == 0xFF) & (b1.bitwiseAND(F.lit(0xF6)) == 0xF0), "AAC").when((b0 == 0x56) & (b1.bitwiseAND(F.lit(0xE0)) == 0xE0), "AAC")
    frame = frame.when((b0 == 0xFF) & (b1.bitwiseAND(F.lit(0xE0)) == 0xE0) & (F.shiftright(b1, 1).bitwiseAND(F.lit(3)) != 0), "MP3")
    if not web_stream:
        return F.when(presumed == "OGG", ogg).otherwise(presumed)
    return F.when(presumed == "OGG", ogg).when(presumed.isin("AAC", "MP3"), F.coalesce(frame, presumed)).otherwise(presumed)


def wav_chunks(files: DataFrame) -> DataFrame:
    """(path, chunk_no, kind, offset, size) of RIFF/WAVE files: a fold over at most 64 chunks, each found from the one before."""
    start = F.array(F.struct(F.lit(12).cast("bigint").alias("offset"), F.lit(0).cast("bigint").alias("size")))
    content = F.col("content")

    def step(a: Column, _: Column) -> Column:
        last = F.element_at(a, -1)
        nxt = F.when(F.size(a) == 1, F.lit(12).cast("bigint")).otherwise(last["offset"] + last["size"] + last["size"] % 2)
        inside = nxt + 8 <= F.octet_length(content)
        size = F.coalesce(le(content, nxt + 4, 4), F.lit(0))
        return F.when(inside, F.concat(a, F.array(F.struct((nxt + 8).alias("offset"), size.alias("size"))))).otherwise(a)

    riff = (ascii(content, 0, 4) == "RIFF") & (ascii(content, 8, 4) == "WAVE")
    rows = files.where(riff).select("path", "content", F.posexplode(F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, step), 2, 64)).alias("chunk_no", "c"))
    return rows.select("path", "chunk_no", ascii(F.col("content"), F.col("c.offset") - 8, 4).alias("kind"), "c.offset", "c.size").distinct()


def wav_info(files: DataFrame) -> DataFrame:
    """(path, channels, sample_rate, bits, data_start, data_size, bitrate, duration, valid) of WAV files; valid: plain PCM, 1 or 2 channels."""
    chunks = wav_chunks(files)
    first = chunks.where(F.col("kind").isin("fmt ", "data")).groupBy("path").agg(*[F.min(F.when(F.col("kind") == k, F.struct("offset", "size"))).alias(n) for k, n in (("fmt ", "f"), ("data", "d"))])
    c, f = F.col("content"), F.col("f.offset")
    df = files.join(first, "path").select(
        "path", le(c, f, 2).cast("int").alias("format"), le(c, f + 2, 2).cast("int").alias("channels"), le(c, f + 4, 4).cast("int").alias("sample_rate"), le(c, f + 14, 2).cast("int").alias("bits"),
        F.col("d.offset").alias("data_start"), F.least(F.col("d.size"), F.octet_length(c) - F.col("d.offset")).alias("data_size"),
    )
    rate = F.col("channels") * F.col("sample_rate") * F.col("bits")
    valid = (F.col("format") == 1) & F.col("channels").isin(1, 2) & F.col("bits").isin(8, 16, 24, 32)
    return df.withColumn("bitrate", rate.cast("bigint")).withColumn("duration", F.expr("try_divide(data_size * 8, bitrate)")).withColumn("valid", valid)


def wav_samples(files: DataFrame) -> DataFrame:
    """(stream_id, frame_no, left, right) of valid WAV files: fixed-width frames exploded and read natively; mono gives both channels."""
    info = wav_info(files).where("valid").drop("format")
    width = F.col("channels") * (F.col("bits") / 8).cast("int")
    frames = (F.col("data_size") / width).cast("int")
    data = files.join(info, "path").select("path", "channels", "bits", F.substring("content", F.col("data_start").cast("int") + 1, F.col("data_size").cast("int")).alias("data"), width.alias("width"), frames.alias("n")).where("n > 0")
    rows = data.select("path", "channels", "bits", "width", "data", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame_no"))
    one = (F.col("bits") / 8).cast("int")

    def value(channel: int) -> Column:
        offset = F.col("frame_no") * F.col("width") + F.when(F.col("channels") == 2, one * channel).otherwise(0)
        raw = text.little_endian(F.substring("data", offset.cast("int") + 1, one))
        half = F.expr("shiftleft(1L, bits - 1)")
        signed = F.when(raw >= half, raw - half * 2).otherwise(raw)
        return F.when(F.col("bits") == 8, signal.widen(raw, 8)).when(F.col("bits") == 16, signal.widen(signed, 16)).when(F.col("bits") == 24, signal.widen(signed, 24)).otherwise(signed).cast("int")

    return rows.select(F.col("path").alias("stream_id"), F.col("frame_no").cast("bigint").alias("frame_no"), value(0).alias("left"), value(1).alias("right"))


def id3v1(files: DataFrame) -> DataFrame:
    """(path, field, value) of the trailing 128-byte tag, and of the 227-byte one before it; empty fields are left out."""
    c, n = F.col("content"), F.octet_length("content")

    def field(start: Column, size: int) -> Column:
        return F.trim(F.regexp_replace(text.latin_to_utf8(at(c, start, size)), r"(?s)\x00.*", ""))

    small = {"title": (3, 30), "artist": (33, 30), "album": (63, 30), "year": (93, 4), "comment": (97, 30)}
    large = {"title+": (4, 60), "artist+": (64, 60), "album+": (124, 60), "genre+": (185, 30)}
    one = files.where((n >= 128) & (ascii(c, n - 128, 3) == "TAG"))
    track = F.when((be(c, n - 3, 1) == 0) & (be(c, n - 2, 1) > 0), be(c, n - 2, 1).cast("string"))
    genre = F.when(be(c, n - 1, 1) < 192, be(c, n - 1, 1).cast("string"))
    plus = (n >= 355) & (ascii(c, n - 355, 4) == "TAG+")
    items = [F.struct(F.lit(k).alias("field"), field(n - 128 + a, m).alias("value")) for k, (a, m) in small.items()]
    items += [F.struct(F.lit("track").alias("field"), track.alias("value")), F.struct(F.lit("genre").alias("field"), genre.alias("value"))]
    items += [F.struct(F.lit(k).alias("field"), F.when(plus, field(n - 355 + a, m)).alias("value")) for k, (a, m) in large.items()]
    return one.select("path", F.explode(F.array(*items)).alias("x")).select("path", "x.field", "x.value").where("coalesce(value, '') != ''")


def ts_packets(streams: DataFrame) -> DataFrame:
    """(stream_id, packet_no, pid, start, payload) of (stream_id, content): 188-byte packets with their sync byte, payload after any adaptation field."""
    cut = streams.where(F.octet_length("content") >= 188).select("stream_id", "content", F.explode(F.expr("sequence(0, CAST(octet_length(content) / 188 AS INT) - 1)")).alias("packet_no"))
    p = cut.select("stream_id", "packet_no", F.substring("content", F.col("packet_no") * 188 + 1, F.lit(188)).alias("p")).where(be(F.col("p"), 0, 1) == 0x47)
    flags, more = be(F.col("p"), 1, 2), be(F.col("p"), 3, 1)
    skip = F.when(more.bitwiseAND(F.lit(0x20)) != 0, 5 + be(F.col("p"), 4, 1)).otherwise(4)
    body = F.when(more.bitwiseAND(F.lit(0x10)) != 0, F.substring("p", skip.cast("int") + 1, F.lit(188)))
    return p.select("stream_id", "packet_no", flags.bitwiseAND(F.lit(0x1FFF)).cast("int").alias("pid"), (flags.bitwiseAND(F.lit(0x4000)) != 0).alias("start"), body.alias("payload"))


def _section(p: Column) -> Column:
    """A table section after its pointer field."""
    return F.substring(p, (be(p, 0, 1) + 2).cast("int"), F.lit(188))


def ts_programs(packets: DataFrame) -> DataFrame:
    """(stream_id, map_pid): where the association table says programs are described."""
    s = packets.where("pid = 0 AND start AND payload IS NOT NULL").select("stream_id", _section(F.col("payload")).alias("s"))
    length = be(F.col("s"), 1, 2).bitwiseAND(F.lit(0x0FFF))
    entries = s.select("stream_id", "s", F.explode(F.sequence(F.lit(0), F.greatest(F.floor((length - 9) / 4).cast("int") - 1, F.lit(0)))).alias("i"))
    at_ = F.col("i") * 4 + 8
    return entries.where(be(F.col("s"), at_, 2) != 0).select("stream_id", be(F.col("s"), at_ + 2, 2).bitwiseAND(F.lit(0x1FFF)).cast("int").alias("map_pid")).distinct()


#: Stream types of audio in program maps.
AUDIO_TYPES = (0x0F, 0x11, 0x04, 0x03)


def ts_audio_pids(packets: DataFrame) -> DataFrame:
    """(stream_id, pid, stream_type) of the audio streams of described programs: a fold over at most 16 descriptions."""
    maps = packets.where("start AND payload IS NOT NULL").join(ts_programs(packets).withColumnRenamed("map_pid", "pid"), ["stream_id", "pid"], "left_semi")
    s = maps.select("stream_id", _section(F.col("payload")).alias("s")).where(be(F.col("s"), 0, 1) == 2)
    c = F.col("s")
    end = be(c, 1, 2).bitwiseAND(F.lit(0x0FFF)) - 1
    first = 12 + be(c, 10, 2).bitwiseAND(F.lit(0x0FFF))
    start = F.struct(first.alias("at"), F.array().cast("array<struct<t:bigint,pid:bigint>>").alias("out"))

    def step(a: Column, _: Column) -> Column:
        own = F.struct(be(c, a["at"], 1).alias("t"), be(c, a["at"] + 1, 2).bitwiseAND(F.lit(0x1FFF)).alias("pid"))
        after = a["at"] + 5 + be(c, a["at"] + 3, 2).bitwiseAND(F.lit(0x0FFF))
        return F.when(a["at"] + 5 <= end, F.struct(after.alias("at"), F.concat(a["out"], F.array(own)).alias("out"))).otherwise(a)

    rows = s.select("stream_id", F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, step, lambda a: a["out"])).alias("x"))
    return rows.where(F.col("x.t").isin(*AUDIO_TYPES)).select("stream_id", F.col("x.pid").cast("int").alias("pid"), F.col("x.t").cast("int").alias("stream_type")).distinct()


def ts_audio(packets: DataFrame) -> DataFrame:
    """(stream_id, packet_no, pid, data): audio bytes in order, the headers of elementary packets cut off."""
    own = packets.where("payload IS NOT NULL").join(ts_audio_pids(packets).select("stream_id", "pid"), ["stream_id", "pid"], "left_semi")
    p = F.col("payload")
    headed = F.col("start") & (be(p, 0, 3) == 1)
    data = F.when(headed, F.substring("payload", (be(p, 8, 1) + 10).cast("int"), F.lit(188))).otherwise(p)
    return own.select("stream_id", "packet_no", "pid", data.alias("data"))


def opus_packet_info(packets: DataFrame) -> DataFrame:
    """Adds mode, frame_us, stereo and frames of Opus packets (packet BINARY) by their first bytes."""
    toc, second = be(F.col("packet"), 0, 1), be(F.col("packet"), 1, 1)
    config = F.shiftright(toc, 3)
    silk = F.element_at(F.array(*[F.lit(x) for x in (10_000, 20_000, 40_000, 60_000)]), (config % 4 + 1).cast("int"))
    celt = F.element_at(F.array(*[F.lit(x) for x in (2500, 5000, 10_000, 20_000)]), (config % 4 + 1).cast("int"))
    mode = F.when(config < 12, "SILK").when(config < 16, "HYBRID").otherwise("CELT")
    us = F.when(config < 12, silk).when(config < 16, F.when(config % 2 == 0, 10_000).otherwise(20_000)).otherwise(celt)
    code = toc.bitwiseAND(F.lit(3))
    frames = F.when(code == 0, 1).when(code == 3, second.bitwiseAND(F.lit(63))).otherwise(2)
    return packets.withColumns({"mode": mode, "frame_us": us, "stereo": toc.bitwiseAND(F.lit(4)) != 0, "frames": frames.cast("int")})


def opus_head(content: Column) -> Column:
    """Struct of channels, pre_skip, sample_rate, mapping and valid of an identification packet."""
    ch, mapping = be(content, 9, 1), be(content, 18, 1)
    valid = (ascii(content, 0, 8) == "OpusHead") & ch.isin(1, 2) & (mapping <= 1)
    return F.struct(ch.cast("int").alias("channels"), le(content, 10, 2).cast("int").alias("pre_skip"), le(content, 12, 4).cast("int").alias("sample_rate"), mapping.cast("int").alias("mapping"), valid.alias("valid"))


def vorbis_head(content: Column) -> Column:
    """Struct of channels, sample_rate, nominal_bitrate, blocksizes and valid of an identification packet."""
    ch, rate, sizes = be(content, 11, 1), le(content, 12, 4), be(content, 28, 1)
    b0, b1 = F.pow(F.lit(2), sizes % 16).cast("int"), F.pow(F.lit(2), F.shiftright(sizes, 4)).cast("int")
    valid = (ascii(content, 1, 6) == "vorbis") & (be(content, 0, 1) == 1) & ch.isin(1, 2) & rate.between(4096, 64_000) & (b0 >= 64) & (b1 <= 8192) & (b0 <= b1)
    return F.struct(ch.cast("int").alias("channels"), rate.cast("int").alias("sample_rate"), le(content, 20, 4).cast("int").alias("nominal_bitrate"), b0.alias("block0"), b1.alias("block1"), valid.alias("valid"))
