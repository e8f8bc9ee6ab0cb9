"""Stream titles from in-band metadata, and the suppression of repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions import text


def _joined(title: Column, artist: Column) -> Column:
    return F.nullif(F.concat_ws(" - ", F.nullif(title, F.lit("")), F.nullif(artist, F.lit(""))), F.lit(""))


def title(meta: Column) -> Column:
    """The title that a piece of metadata shows: quoted stream title, radio XML, grouping tag or playlist line; else null."""
    return _title(text.html_to_utf8(meta))


def _title(m: Column) -> Column:
    """``title`` of metadata whose entities are resolved."""

    def within(a: str, b: str) -> Column:
        return F.regexp_extract(m, f"(?s){a}(.*?){b}", 1)

    xml = F.when(F.contains(m, F.lit("<DB_DALET_TITLE_NAME>")), _joined(within("<DB_DALET_TITLE_NAME>", "</DB_DALET_TITLE_NAME>"), within("<DB_LEAD_ARTIST_NAME>", "</DB_LEAD_ARTIST_NAME>")))
    quoted = F.coalesce(F.nullif(within("^StreamTitle='", "';"), F.lit("")), F.when(~F.contains(m, F.lit("';")), F.nullif(within("^StreamTitle='", "'"), F.lit(""))))
    name = F.regexp_extract(m, r'(?s).title="([^"]*)"', 1)
    spot = F.regexp_extract(m, r'(?s).title="text=\\"([^\\"]*)', 1)
    artist = F.regexp_extract(m, r'(?s).artist="([^"]*)"', 1)
    line = _joined(F.when(spot != "", spot).otherwise(name), F.when(artist == " ", F.lit("")).otherwise(artist))
    ad = text.index_of(m, "adw_ad=") > 0
    found = F.when(F.startswith(m, F.lit("StreamTitle='<?xml version=")), xml).when(F.startswith(m, F.lit("StreamTitle='")), quoted)
    found = found.when(F.startswith(m, F.lit("Grouping:")), F.nullif(text.substr(m, 9), F.lit(""))).when(F.startswith(m, F.lit("#EXTINF")), line)
    return F.when(~ad, found)


def advertisement(meta: Column) -> Column:
    """Duration text of an advertisement marker, else null."""
    return F.when(text.index_of(meta, "adw_ad=") > 0, F.regexp_extract(meta, r"durationMilliseconds='?([^';]*)'?;", 1))


def stream_url(meta: Column) -> Column:
    return F.when(text.index_of(meta, "StreamUrl=") > 0, F.nullif(F.regexp_extract(meta, r"StreamUrl=([^;]*);", 1), F.lit("")))


def json_result(t: Column) -> Column:
    """The result member of a title that is a JSON object, its escapes resolved; other titles stay; null without a result."""
    first = F.substring_index(t, "\n", 1)
    found = F.regexp_extract(first, r'(?i)"result":"((?:[^"\\]|\\.)*)"', 1)
    return F.when(~F.startswith(t, F.lit('{"')), t).when(text.is_json(first) & (found != ""), text.unicode_to_utf8(found))


def changes(rows: DataFrame, value: str, keys: tuple[str, ...] = ("stream_id",), order: str = "seq") -> DataFrame:
    """Rows whose value is set and differs from the one before it in the stream.

    Rows without a value are left out behind the window: before it, that filter would work each value out once more.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = rows.withColumn("_before", F.last(value, ignorenulls=True).over(w))
    return before.where(F.col(value).isNotNull() & ~F.col("_before").eqNullSafe(F.col(value))).drop("_before")


def stream_titles(meta: DataFrame) -> DataFrame:
    """(stream_id, seq, title): title changes of (stream_id, seq, meta). Rows are dealt by stream first, so that titles are found in many tasks."""
    plain = meta.select("stream_id", "seq", "meta").repartition("stream_id").select("stream_id", "seq", text.html_to_utf8(F.col("meta")).alias("_m"))
    titled = plain.select("stream_id", "seq", _title(F.col("_m")).alias("title"))
    return changes(titled, "title").select("stream_id", "seq", json_result(F.col("title")).alias("title")).where("title IS NOT NULL")
