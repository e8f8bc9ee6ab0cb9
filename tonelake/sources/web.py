"""Web radio and HLS as compositions of the HTTP source, framing and playlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import requests, text
from tonelake.sources import containers, files, http, playlists
from tonelake.streaming import stateful


def playable(url: Column) -> Column:
    """Whether a URL may be asked for: its length is right and it isn't a fragment of fragmented MP4."""
    return requests.valid_url(url) & ~F.endswith(F.substring_index(url, "?", 1), F.lit(".m4s"))


def bodies(rows: DataFrame) -> DataFrame:
    """(url, content): the pieces (url, offset, data) of small resources put together, such as playlists and segments."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("data").alias("h"))))
    return rows.groupBy("url").agg(parts.alias("p")).select("url", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("content"))


def web_file(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """(path, content) of a file, fetched in ranges."""
    http.register(spark)
    return bodies(spark.read.format("media_http").options(urls=url, **options).load()).withColumnRenamed("url", "path")


def radio_titles(spark: SparkSession, url: str, metaint: int, **options: str) -> DataFrame:
    """A streaming DataFrame (stream_id, audio_pos, meta) of a station's in-band titles."""
    http.register(spark)
    pieces = spark.readStream.format("media_http").options(urls=url, **options).load()
    return stateful.icy_titles(pieces.select(F.col("url").alias("stream_id"), "offset", "data"), metaint)


def hls_segments(spark: SparkSession, url: str, last_url: str | None = None, **options: str) -> DataFrame:
    """(playlist_id, line_no, extinf, url): the segments of a playlist after the one played last, their URLs absolute.

    A playlist of variants is followed to its best one first. A playlist is a short list; its own URL is all that
    comes to the driver.
    """
    rows = _playlist(spark, url, options)
    if rows.where(F.startswith("line", F.lit("#EXT-X-STREAM-INF"))).limit(1).count():
        base = spark.createDataFrame([(url, url)], "playlist_id string, base_url string")
        url = playlists.variant(rows, base).first()["url"]
        rows = _playlist(spark, url, options)
    segments = playlists.m3u8_segments(rows).withColumn("url", playlists.absolute(F.col("url"), F.lit(url)))
    last = spark.createDataFrame([(url, last_url)], "playlist_id string, last_url string")
    return playlists.fresh(segments, last).where(playable(F.col("url")))


def _playlist(spark: SparkSession, url: str, options: dict) -> DataFrame:
    body = web_file(spark, url, **options)
    return playlists.lines(body.select(F.col("path").alias("playlist_id"), text.latin_to_utf8(F.col("content")).alias("content")))


def hls_audio(spark: SparkSession, segments: DataFrame, **options: str) -> DataFrame:
    """(stream_id, line_no, packet_no, data): audio of segments in order, out of MPEG-TS where they are, whole otherwise.

    ``segments`` is one playlist's, so its URLs (a few dozen) make up the request.
    """
    listed = segments.select("url", "line_no").collect()
    if not listed:
        return spark.createDataFrame([], "stream_id string, line_no int, packet_no int, data binary")
    http.register(spark)
    got = bodies(spark.read.format("media_http").options(urls=" ".join(r["url"] for r in listed), **options).load())
    order = spark.createDataFrame(listed, "url string, line_no int")
    framed = files.be(F.col("content"), 0, 1) == 0x47
    ts = files.ts_audio(files.ts_packets(got.where(framed).withColumnRenamed("url", "stream_id"))).select("stream_id", "packet_no", "data")
    raw = got.where(~framed).select(F.col("url").alias("stream_id"), F.lit(0).alias("packet_no"), F.col("content").alias("data"))
    return ts.unionByName(raw).join(order.withColumnRenamed("url", "stream_id"), "stream_id").select("stream_id", "line_no", "packet_no", "data")


def chunked_titles(streams: DataFrame, metaint: int) -> DataFrame:
    """(stream_id, audio_pos, audio, meta) of whole recorded bodies that are chunked as well: both framings undone."""
    parts = containers.chunks(streams)
    joined = parts.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("position", F.hex("data").alias("h")))).alias("p"))
    plain = joined.select("stream_id", F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")).alias("content"))
    return containers.icy_blocks(plain, metaint)
