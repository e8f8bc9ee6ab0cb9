"""Playlists as ordered lines (playlist_id, line_no, line), and the URL each format chooses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import text

# Codec strings of variants, best first.
VARIANT_CODECS = ["mp4a.40.34", "mp4a.40.01", "mp4a.40.2", "mp4a.40.02", "mp4a.40.29", "mp4a.40.42", "mp4a.40.5", "mp4a.40.05", "mp4a.67"]


def _order() -> Window:
    return Window.partitionBy("playlist_id").orderBy("line_no")


def lines(texts: DataFrame) -> DataFrame:
    """(playlist_id, line_no, line) of (playlist_id, content): line ends cut, empty lines dropped, HTML pages rejected."""
    rows = texts.where(~F.regexp_like("content", F.lit(r"(?i)<!doctype html|<html"))).select("playlist_id", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.regexp_replace("line", r"[\r\n]+$", "")).where("line != ''")


def m3u_url(rows: DataFrame) -> DataFrame:
    """(playlist_id, url): the first line with 'http', comments skipped once the format's header was seen."""
    seen = F.max(F.contains("line", F.lit("#EXTM3U")).cast("int")).over(_order()) == 1
    real = rows.withColumn("_seen", seen).where(~(F.col("_seen") & F.startswith("line", F.lit("#"))) & ~F.contains("line", F.lit("#EXTM3U")) & F.contains("line", F.lit("http")))
    return real.groupBy("playlist_id").agg(F.min_by(F.trim("line"), "line_no").alias("url"))


def m3u_titles(rows: DataFrame) -> DataFrame:
    """(playlist_id, line_no, title): what follows the comma of #EXTINF lines."""
    return rows.where(F.contains("line", F.lit("#EXTINF:")) & (text.index_of(F.col("line"), ",") > 0)).select("playlist_id", "line_no", text.remove_before(F.col("line"), ",", keep=False).alias("title"))


def pls_entries(rows: DataFrame) -> DataFrame:
    """(playlist_id, number, first_line, file, title) of numbered entries after the format's header."""
    seen = F.max(F.contains("line", F.lit("[playlist]")).cast("int")).over(_order()) == 1
    key = F.lower(F.regexp_extract("line", r"(?i)^(file|title)\d*=", 1))
    number = F.regexp_extract("line", r"(?i)^(?:file|title)(\d+)=", 1).try_cast("int")
    own = rows.withColumn("_seen", seen).withColumns({"_key": key, "number": number}).where("_seen AND _key != '' AND number IS NOT NULL")
    value = text.remove_before(F.col("line"), "=", keep=False)
    last = {k: F.max_by(F.when(F.col("_key") == k, value), F.when(F.col("_key") == k, F.col("line_no"))) for k in ("file", "title")}
    return own.groupBy("playlist_id", "number").agg(F.min("line_no").alias("first_line"), last["file"].alias("file"), last["title"].alias("title"))


def pls_url(rows: DataFrame) -> DataFrame:
    """(playlist_id, url, title): of the entries with a file the one whose number comes first."""
    have = pls_entries(rows).where("coalesce(file, '') != ''")
    return have.groupBy("playlist_id").agg(F.min(F.struct("first_line", "file", "title")).alias("m")).select("playlist_id", F.col("m.file").alias("url"), "m.title")


def asx_entries(rows: DataFrame) -> DataFrame:
    """(playlist_id, entry_no, title, author, url) of entries, read line by line."""
    low = F.lower("line")
    opened, closed = F.contains(low, F.lit("<entry")), F.contains(low, F.lit("</entry"))
    inside = rows.withColumn("_in", F.sum(F.when(F.contains(low, F.lit("<asx")), 1).when(F.contains(low, F.lit("</asx")), -1).otherwise(0)).over(_order()))
    inside = inside.withColumn("entry_no", F.sum(opened.cast("int")).over(_order())).withColumn("_open", F.sum(opened.cast("int") - closed.cast("int")).over(_order()))
    own = inside.where("_in > 0 AND _open > 0")

    def last(tag: str, pattern: str) -> Column:
        hit = F.contains(low, F.lit(tag)) & (F.regexp_extract("line", pattern, 1) != "")
        return F.max_by(F.when(hit, F.regexp_extract("line", pattern, 1)), F.when(hit, F.col("line_no")))

    return own.groupBy("playlist_id", "entry_no").agg(last("<title", r"(?i)>(.*)<").alias("title"), last("<author", r"(?i)<author>(.*)</author").alias("author"), last("<ref", r'"(.*)"').alias("url"))


def asx_url(rows: DataFrame) -> DataFrame:
    """(playlist_id, url, title) of the first entry with a URL."""
    first = asx_entries(rows).where("url IS NOT NULL").groupBy("playlist_id").agg(F.min(F.struct("entry_no", "url", "title")).alias("m"))
    return first.select("playlist_id", "m.url", "m.title")


def m3u8_segments(rows: DataFrame) -> DataFrame:
    """(playlist_id, line_no, extinf, url): each #EXTINF line with the line that follows it, date lines skipped."""
    kept = rows.where(~F.startswith("line", F.lit("#EXT-X-PROGRAM-DATE-TIME:")))
    after = kept.withColumn("url", F.lead("line").over(_order()))
    return after.where(F.startswith("line", F.lit("#EXTINF:")) & F.col("url").isNotNull()).select("playlist_id", "line_no", F.col("line").alias("extinf"), "url")


def is_redirection(rows: DataFrame) -> DataFrame:
    """(playlist_id, redirects): whether a playlist lists variants in place of segments."""
    return rows.groupBy("playlist_id").agg(F.max(F.startswith("line", F.lit("#EXT-X-STREAM-INF:"))).alias("redirects"))


def absolute(url: Column, base: Column) -> Column:
    """A playlist's line against the playlist's own URL."""
    origin = F.regexp_extract(base, r"^(.{8}[^/]*)", 1)
    folder = F.regexp_extract(base, r"^(.*/)", 1)
    return F.when(F.startswith(url, F.lit("http")), url).when(F.startswith(url, F.lit("/")), F.concat(origin, url)).otherwise(F.concat(folder, url))


def variant_rank(line: Column) -> Column:
    """Rank of the best codec string that a line contains, null without one."""
    named = F.contains(line, F.lit('CODECS="mp4a'))
    return F.when(named, F.coalesce(*[F.when(F.contains(line, F.lit(c)), F.lit(i)) for i, c in enumerate(VARIANT_CODECS)]))


def variant(rows: DataFrame, base: DataFrame) -> DataFrame:
    """(playlist_id, codec, url): the variant with the best codec, the first of equals; without codecs the last one.

    ``base`` gives (playlist_id, base_url). Leading '../' are dropped, relative lines go to the base's folder.
    """
    ranked = rows.withColumn("_next", F.lead("line").over(_order())).withColumn("_rank", variant_rank(F.col("line")))
    ranked = ranked.where(F.col("_rank").isNotNull() | F.contains("line", F.lit("#EXT-X-STREAM-INF")))
    choice = F.struct(F.coalesce("_rank", F.lit(100)), F.when(F.col("_rank").isNull(), -F.col("line_no")).otherwise(F.col("line_no")))
    best = ranked.groupBy("playlist_id").agg(F.min_by("_next", choice).alias("_next"), F.min("_rank").alias("_rank"))
    line = F.regexp_replace("_next", r"^(\.\./)+", "")
    url = F.when(F.regexp_like(line, F.lit("(?i)^http")), line).otherwise(F.concat(F.regexp_extract("base_url", r"^(.*/)", 1), line))
    return best.join(base, "playlist_id").select("playlist_id", F.when(F.col("_rank") == 0, "MP3").otherwise("AAC").alias("codec"), url.alias("url"))


def fresh(segments: DataFrame, last: DataFrame) -> DataFrame:
    """Segments after the last occurrence of the URL played last, all if it isn't there; ``last`` has (playlist_id, last_url)."""
    seen = segments.join(last, "playlist_id", "left")
    upto = F.max(F.when(F.col("url") == F.col("last_url"), F.col("line_no"))).over(Window.partitionBy("playlist_id"))
    return seen.withColumn("_upto", F.coalesce(upto, F.lit(-1))).where("line_no > _upto").drop("_upto", "last_url")


def delta_request(url: Column, content: Column) -> Column:
    """The URL with the skip parameter, once, if the server says it can send playlists in part."""
    able = F.contains(content, F.lit("SERVER-CONTROL")) & ~F.contains(url, F.lit("_HLS_skip=YES"))
    return F.when(able, F.concat(url, F.lit("?_HLS_skip=YES"))).otherwise(url)
