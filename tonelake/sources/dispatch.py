"""From content to codec to the parser of its header, for files of any kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.sources import containers, files


def codec_of(content: Column) -> Column:
    """The codec that the first bytes tell; null where none is known."""
    first, second, sync = files.ascii(content, 0, 4), files.ascii(content, 4, 4), files.be(content, 0, 2)
    adts, mpeg = sync.bitwiseAND(0xFFF6) == 0xFFF0, sync.bitwiseAND(0xFFE0) == 0xFFE0
    return (
        F.when((first == "RIFF") & (files.ascii(content, 8, 4) == "WAVE"), "WAV").when(first == "fLaC", "FLAC").when(first == "OggS", files.sniff_codec(content, F.lit("OGG"), True))
        .when(second == "ftyp", "M4A").when(F.substring(first, 1, 3) == "ID3", "MP3").when(adts, "AAC").when(mpeg, "MP3")
    )


def stream_headers(media: DataFrame) -> DataFrame:
    """(path, codec, rate) of (path, length, content): each file goes to its codec's parser; rate is null where the header has none.

    Files of no known codec have a row with nulls. Each parser reads the files of its codec only.
    """
    told = media.withColumn("codec", codec_of(F.col("content")))
    parsers = {
        "WAV": lambda df: files.wav_info(df).select("path", F.col("sample_rate").alias("rate")),
        "FLAC": lambda df: containers.flac_stream_info(df).select("path", F.col("sample_rate").alias("rate")),
        "M4A": lambda df: containers.m4a_info(df).select("path", F.col("timescale").alias("rate")),
        "VORBIS": lambda df: containers.ogg_packets(df).where("page_no = 0").select("path", files.vorbis_head(F.col("packet"))["sample_rate"].alias("rate")),
    }
    rates = None
    for codec, parse in parsers.items():
        one = parse(told.where(F.col("codec") == codec).drop("codec")).select("path", F.col("rate").cast("bigint").alias("rate"))
        rates = one if rates is None else rates.unionByName(one)
    return told.select("path", "codec").join(rates, "path", "left")
