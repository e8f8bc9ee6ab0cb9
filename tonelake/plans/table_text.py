"""Queries over playlists, headers, titles, lookups and curves whose inputs are made of the test tables.

A page or customer is a playlist, a connection or a file name; an event is a meter level, a volume or a line of lyrics.
Where a name is that of a query over fixtures, this one is registered.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.functions import signal, text
from tonelake.operators import equalizer, lookups, running, spectrum, titles
from tonelake.plans.bindings import sample, table
from tonelake.plans.settings import EVENTS, Settings
from tonelake.plans.signal_queries import ALL_BANDS_SQL, LEVEL_SQL, _db_sql
from tonelake.plans.text_queries import BASE, CONTENT, values
from tonelake.session import ready
from tonelake.sources import files, headers, playlists

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def pick(items: list, by: Column) -> Column:
    """The item that a whole number, from 0, counts to."""
    return F.element_at(F.array(*[F.lit(i) for i in items]), (by % len(items) + 1).cast("int"))


def picked(items: list, by: str) -> str:
    return f"[{', '.join('NULL' if i is None else repr(i) for i in items)}][1 + {by} % {len(items)}]"


# Curves, levels and bands over events.


@query("D2_volume_limits", f"WITH g AS (SELECT event_id, (event_id % 22)::DOUBLE AS v, (event_id // 22 % 33 - 16)::DOUBLE AS b FROM events) SELECT event_id, round({LEVEL_SQL} * pow(10.0, CASE WHEN b > 0 THEN -b ELSE 0 END / 20.0), 9) AS l, round({LEVEL_SQL} * pow(10.0, CASE WHEN b < 0 THEN b ELSE 0 END / 20.0), 9) AS r FROM g")
def volume_limits(spark, d):
    e = F.col("event_id")
    left, right = signal.volume_limits((e % 22).cast("double"), 21, (F.expr("event_id div 22") % 33 - 16).cast("double"))
    return table(spark, d, "events").select("event_id", F.round(left, 9).alias("l"), F.round(right, 9).alias("r"))


@query("D3_gain_ramp", "WITH g AS (SELECT event_id, event_id % 61 AS t, event_id // 61 % 22 AS g FROM events) SELECT event_id, round(5.0 + sign(g - 5.0) * least(t * 0.42::DOUBLE, abs(g - 5.0)), 9) AS volume FROM g")
def gain_ramp(spark, d):
    ramped = signal.ramped(F.lit(5.0), (F.expr("event_id div 61") % 22).cast("double"), (F.col("event_id") % 61).cast("int"))
    return table(spark, d, "events").select("event_id", F.round(ramped, 9).alias("volume"))


@query("D7_vu_curve", "SELECT event_id, round(255.0 * sqrt(event_id % 256 / 255.0))::INTEGER AS shown FROM events")
def vu_curve(spark, d):
    return table(spark, d, "events").select("event_id", signal.vu_curve(F.col("event_id") % 256).alias("shown"))


@query("D13_biquad_response", f"SELECT event_id, round({_db_sql()}, 6) AS db FROM (SELECT event_id, pi() * (event_id % 8192) / 8192 AS w FROM events)")
def biquad_response(spark, d):
    return table(spark, d, "events").select("event_id", F.round(signal.biquad_db(F.pi() * (F.col("event_id") % 8192) / 8192, equalizer.EXAMPLE), 6).alias("db"))


@query("G5_bins_to_bands", f"SELECT event_id, v.band::INTEGER AS band FROM events LEFT JOIN (VALUES {ALL_BANDS_SQL}) v(band, a, z) ON event_id % 257 BETWEEN a AND z")
def bins_to_bands(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") % 257).alias("bin"))
    return e.join(F.broadcast(spectrum.bands(spark)), F.col("bin").between(F.col("first_bin"), F.col("last_bin")), "left").select("event_id", "band")


@query(
    "J6_stream_info",
    """WITH s AS (SELECT o_orderkey AS id, 8000 * (1 + o_orderkey % 6) AS sample_rate, round(o_totalprice)::BIGINT * 10 AS data_size, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey * 480 END AS last_granule,
    CASE WHEN o_orderkey % 4 = 2 THEN o_orderkey * 441 END AS header_samples, CASE WHEN o_orderkey % 3 = 0 THEN 64000 END AS nominal_bitrate, CASE WHEN o_orderkey % 4 = 0 THEN 128000 END AS average_bitrate FROM orders),
    x AS (SELECT *, floor(coalesce(coalesce(last_granule, header_samples) / sample_rate::DOUBLE, data_size * 8 / coalesce(nominal_bitrate, average_bitrate)::DOUBLE))::BIGINT AS duration FROM s)
    SELECT id::VARCHAR AS stream_id, duration, coalesce(nominal_bitrate, floor(data_size * 8 / nullif(duration, 0)::DOUBLE)::BIGINT, average_bitrate)::BIGINT AS bitrate, coalesce(last_granule, header_samples, duration * sample_rate)::BIGINT AS total_samples FROM x""",
)
def stream_info(spark, d):
    rows = table(spark, d, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS stream_id", "'MP3' AS codec", "CAST(8000 * (1 + o_orderkey % 6) AS INT) AS sample_rate", "2 AS channels", "16 AS bits", "CAST(round(o_totalprice) AS BIGINT) * 10 AS data_size",
        "CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey * 480 END AS last_granule", "CASE WHEN o_orderkey % 4 = 2 THEN o_orderkey * 441 END AS header_samples",
        "CASE WHEN o_orderkey % 3 = 0 THEN 64000L END AS nominal_bitrate", "CASE WHEN o_orderkey % 4 = 0 THEN 128000L END AS average_bitrate",
    )
    return running.stream_info(rows).select("stream_id", "duration", "bitrate", "total_samples")


# Text functions over events and documents.


@query(
    "I8_to_int",
    """SELECT event_id, event_id - 500 AS ten, event_id AS sixteen, CASE WHEN event_id % 2 = 0 THEN event_id ELSE event_id - 500 END AS by_prefix, 0::BIGINT AS none FROM events""",
)
def to_int(spark, d):
    """A number in a text, ten to the base, sixteen, or as its prefix says."""
    e, hexed = F.col("event_id"), F.lower(F.hex("event_id"))
    plain = F.concat(F.lit("  "), (e - 500).cast("string"), F.lit("x"))
    own = F.when(e % 2 == 0, F.concat(F.lit("0x"), hexed)).otherwise(plain)
    return table(spark, d, "events").select("event_id", text.to_int(plain).alias("ten"), text.to_int(hexed, 16).alias("sixteen"), text.to_int(own, 0).alias("by_prefix"), text.to_int(F.col("event_type")).alias("none"))


@query("I11_is_utf8", "SELECT doc_id, n, n >= octet_length(encode(text)) OR list_contains(list_transform(range(0, 21), lambda k: strlen(left(text, k))), n) AS ok FROM (SELECT doc_id, coalesce(text, '') AS text, doc_id % 20 AS n FROM documents)")
def is_utf8(spark, d):
    """The first bytes of each text: sound unless cut within a character."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 20).alias("n"))
    return docs.select("doc_id", "n", F.is_valid_utf8(F.substring(F.encode("text", "UTF-8"), F.lit(1), F.col("n").cast("int")).cast("string")).alias("ok"))


def escaped(rows: DataFrame) -> DataFrame:
    r"""(doc_id, s): each character of a text beyond ASCII, of those with four hex digits, as \\uXXXX."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = ["".join(c if c < "\x80" or c > "￿" else f"\\u{ord(c):04x}" for c in t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string())], ["doc_id", "s"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, s string")


@query("I14_unicode_to_utf8", "SELECT doc_id, coalesce(text, '') AS plain FROM documents")
def unicode_to_utf8(spark, d):
    return escaped(table(spark, d, "documents")).select("doc_id", text.unicode_to_utf8(F.col("s")).alias("plain"))


@query("I22_lyric_ms", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE (event_id // 6000 % 100) * 60000 + (event_id // 100 % 60) * 1000 + (event_id % 100) * 10 END AS ms FROM events")
def lyric_ms(spark, d):
    e = F.col("event_id")
    at = F.format_string("[%02d:%02d.%02d] ", F.expr("event_id div 6000 % 100"), F.expr("event_id div 100 % 60"), e % 100)
    line = F.concat(F.when(e % 7 == 0, F.lit("")).otherwise(at), F.col("event_type"))
    return table(spark, d, "events").select("event_id", text.lyric_ms(line).alias("ms"))


@query(
    "I24_crc8",
    """WITH RECURSIVE bits AS (SELECT n AS i, n AS c, 0 AS k FROM range(256) t(n) UNION ALL SELECT i, CASE WHEN c & 128 = 128 THEN xor((c << 1) & 255, 7) ELSE c << 1 END, k + 1 FROM bits WHERE k < 8),
    crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8), x AS (SELECT event_id, hex(encode(props)) AS h FROM events WHERE props <> '')
    SELECT event_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || h[i:i + 1])::BIGINT)), lambda a, b: t[xor(a, b) + 1]) AS crc FROM x, crc""",
)
def crc8(spark, d):
    return table(spark, d, "events").where("props != ''").select("event_id", text.crc8(F.encode("props", "UTF-8")).cast("bigint").alias("crc"))


@query("G3_entities", f"SELECT p_partkey, v.c AS c, v.c || ' ' || p_name AS named FROM part JOIN (VALUES {values([(i, c) for i, (_, c) in enumerate(text.ENTITIES)])}) v(i, c) ON p_partkey % {len(text.ENTITIES)} = i")
def entities(spark, d):
    entity = F.concat(F.lit("&"), pick([n for n, _ in text.ENTITIES], F.col("p_partkey")), F.lit(";"))
    return table(spark, d, "part").select("p_partkey", text.html_to_utf8(entity).alias("c"), text.html_to_utf8(F.concat(entity, F.lit(" "), "p_name")).alias("named"))


TAG_ROWS = list(lookups.TAGS.items())
_TAGGED = f"(SELECT p_partkey, p_name, {picked([t for t, _ in TAG_ROWS] + ['NONE'], 'p_partkey')} AS tag FROM part)"


@query("G2_tag_labels", f"SELECT p_partkey, tag, label FROM {_TAGGED} LEFT JOIN (VALUES {values(TAG_ROWS)}) v(tag, label) USING (tag)")
def tag_labels(spark, d):
    tags = table(spark, d, "part").select("p_partkey", pick([t for t, _ in TAG_ROWS] + ["NONE"], F.col("p_partkey")).alias("tag"))
    return lookups.with_tag_labels(tags).select("p_partkey", "tag", "label")


@query("B8_tag_text", f"SELECT p_partkey, label || ': ' || p_name AS shown FROM {_TAGGED} JOIN (VALUES {values(TAG_ROWS)}) v(tag, label) USING (tag)")
def tag_text(spark, d):
    tags = table(spark, d, "part").select("p_partkey", "p_name", pick([t for t, _ in TAG_ROWS] + ["NONE"], F.col("p_partkey")).alias("tag"))
    return lookups.with_tag_labels(tags).where("label IS NOT NULL").select("p_partkey", F.concat("label", F.lit(": "), "p_name").alias("shown"))


# File names, content types and headers of pages.

NAMES = [("mp3", "MP3"), ("M4A", "M4A"), ("aac", "AAC"), ("wav", "WAV"), ("Flac", "FLAC"), ("opus", "OGG"), ("ogg", "OGG"), ("oga", "OGG"), ("txt", None), ("", None)]


@query("A1_extension_codec", f"SELECT page_id, {picked([c for _, c in NAMES], 'page_id')} AS codec FROM pages")
def extension_codec(spark, d):
    path = F.concat(F.regexp_replace("url", r"\?.*$", ""), F.lit("/f."), pick([n for n, _ in NAMES], F.col("page_id")))
    return table(spark, d, "pages").select("page_id", lookups.extension_codec(path).alias("codec"))


_KINDS = [("MP3", "MP3"), ("M3U", "M3U8"), ("TXT", "M3U8"), ("AAC", "MP3"), ("TXT", "M3U8"), (None, None), ("OGG", "OGG")]


@query("A12_content_types", f"SELECT page_id, {picked([k for k, _ in _KINDS], 'page_id')} AS kind, {picked([f for _, f in _KINDS], 'page_id')} AS final FROM pages")
def content_types(spark, d):
    pages = table(spark, d, "pages").select("page_id", pick([m for _, m in CONTENT], F.col("page_id")).alias("content_type"))
    return lookups.with_mime_kind(pages).select("page_id", "kind", lookups.content_kind(F.col("kind"), F.col("content_type"), F.lit("M3U8"), F.lit("MP3")).alias("final"))


def connections(spark, d) -> DataFrame:
    """(conn_id, line_no, line): by its number a page is a radio, a file, an error, a redirection or packed content."""
    k, n = F.col("page_id"), F.col("page_id").cast("string")
    radio = F.array(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: audio/mpeg"), F.concat(F.lit("icy-name: Radio "), n), F.concat(F.lit("icy-metaint:"), (k + 1).cast("string")), F.concat(F.lit("icy-br:"), (k % 320 + 1).cast("string")), F.lit("Transfer-Encoding: chunked"))
    file = F.array(F.lit("HTTP/1.1 200 OK"), F.lit("content-type: audio/flac; x"), F.concat(F.lit("Content-Length: "), (k + 1).cast("string")), F.concat(F.lit('content-disposition: attachment; filename="'), n, F.lit('.flac"')))
    lost = F.array(F.concat(F.lit("HTTP/1.1 "), (400 + k % 5).cast("string"), F.lit(" No")), F.lit("Content-Type: text/html"))
    moved = F.array(F.lit("HTTP/1.1 301 Moved"), F.concat(F.lit("Location: "), F.coalesce("url", F.lit("-"))))
    packed = F.array(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: audio/aac"), F.lit("Content-Encoding: gzip"))
    kind = F.when(k % 5 == 0, radio).when(k % 5 == 1, file).when(k % 5 == 2, lost).when(k % 5 == 3, moved).otherwise(packed)
    return table(spark, d, "pages").select(n.alias("conn_id"), F.posexplode(kind).alias("line_no", "line"))


@query(
    "A14_headers",
    """SELECT page_id::VARCHAR AS conn_id, [200, 200, 400 + page_id % 5, 301, 200][1 + page_id % 5] AS status, ['MP3', 'FLAC', 'TXT', NULL, 'AAC'][1 + page_id % 5] AS kind, CASE WHEN page_id % 5 = 0 THEN 'Radio ' || page_id END AS icy_name,
    CASE WHEN page_id % 5 = 0 THEN page_id + 1 END AS metaint, CASE WHEN page_id % 5 = 0 THEN (page_id % 320 + 1) * 1000 END AS nominal_bitrate, CASE WHEN page_id % 5 = 1 THEN page_id + 1 ELSE 0 END AS content_length,
    page_id % 5 = 0 AS chunked, CASE WHEN page_id % 5 = 1 THEN page_id || '.flac' END AS filename, ['ok', 'ok', 'error', 'redirect', 'error'][1 + page_id % 5] AS state FROM pages""",
)
def header_summary(spark, d):
    out = headers.summary(connections(spark, d))
    return out.select("conn_id", "status", "kind", "icy_name", "metaint", "nominal_bitrate", F.coalesce("content_length", F.lit(0)).alias("content_length"), F.coalesce("chunked", F.lit(False)).alias("chunked"), "filename", "state")


@query("A15_stream_type", "SELECT page_id::VARCHAR AS conn_id, CASE WHEN page_id % 5 = 1 THEN 'webfile' ELSE 'webstream' END AS stream_type FROM pages")
def stream_type(spark, d):
    return headers.summary(connections(spark, d)).select("conn_id", "stream_type")


@query("A17_play_order", "SELECT 'n' || c_nationkey || '/' || c_name || '.mp3' AS path, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name DESC) AS play_no FROM customer")
def play_order(spark, d):
    path = F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/"), "c_name", F.lit(".mp3"))
    return files.play_order(table(spark, d, "customer").select(path.alias("path"))).select("path", "play_no")


# Playlists and titles.


def playlist(spark, d, form: str) -> DataFrame:
    """(playlist_id, content) of each customer: ``form`` with {k} for the key, {name} and {seg}."""
    content = F.lit(form)
    for what, by in (("{k}", F.col("c_custkey").cast("string")), ("{name}", F.col("c_name")), ("{seg}", F.col("c_mktsegment"))):
        content = F.replace(content, F.lit(what), by)
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("playlist_id"), content.alias("content"))


def lines(spark, d, form: str) -> DataFrame:
    return playlists.lines(playlist(spark, d, form))


P = "c AS (SELECT c_custkey::VARCHAR AS playlist_id, c_name AS name, c_mktsegment AS seg FROM customer)"
M3U = "#EXTM3U\n#EXTINF:-1,{name}\r\n\nhttps://edge.example/{k}\nhttps://b/\n"


@query("A20_lines", f"WITH {P} SELECT playlist_id, unnest([0, 1, 3, 4]) AS line_no, unnest(['#EXTM3U', '#EXTINF:-1,' || name, 'https://edge.example/' || playlist_id, 'https://b/']) AS line FROM c UNION ALL SELECT 'p' || page_id, 0, url FROM pages WHERE url <> '' AND NOT regexp_matches(url, '(?i)<!doctype html|<html') AND NOT contains(url, chr(10))")
def playlist_lines(spark, d):
    """Playlists of customers, pages whose one line is their URL, and pages of HTML, which are rejected."""
    pages = table(spark, d, "pages").where("NOT contains(url, '\n') AND url != ''").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("playlist_id"), F.col("url").alias("content"))
    html = table(spark, d, "pages").select(F.concat(F.lit("h"), F.col("page_id").cast("string")).alias("playlist_id"), F.concat(F.lit("<HTML>\n"), F.coalesce("html", F.lit(""))).alias("content"))
    return playlists.lines(playlist(spark, d, M3U).unionByName(pages).unionByName(html))


@query("A21_m3u", f"WITH {P} SELECT playlist_id, 'https://edge.example/' || playlist_id AS url, name AS title FROM c")
def m3u(spark, d):
    rows = lines(spark, d, M3U)
    return playlists.m3u_url(rows).join(playlists.m3u_titles(rows).select("playlist_id", "title"), "playlist_id", "left")


@query("A22_pls", f"WITH {P} SELECT playlist_id, 'http://s.example/' || playlist_id AS url, name AS title FROM c")
def pls(spark, d):
    return playlists.pls_url(lines(spark, d, "[playlist]\nNumberOfEntries=2\nFile1=http://s.example/{k}\nTitle2=Second\nTitle1={name}\nFile2=http://t/{seg}\n"))


@query("A23_asx", f"WITH {P} SELECT playlist_id, 'http://e/' || playlist_id || '.wma' AS url, name AS title FROM c")
def asx(spark, d):
    form = '<asx version="3.0">\n<title>All</title>\n<entry>\n<title>One</title>\n</entry>\n<entry>\n<title>{name}</title>\n<author>{seg}</author>\n<ref href="http://e/{k}.wma" />\n</entry>\n</asx>'
    return playlists.asx_url(lines(spark, d, form))


HLS = "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:0\n#EXTINF:3.9,{name}\n#EXT-X-PROGRAM-DATE-TIME:2025\nhttp://h/{k}.mp3\n#EXTINF:3.9,B\n{k}-1.mp3\n#EXTINF:3.9,C\n/r/{k}.mp3\n"


@query("A24_segments", f"WITH {P} SELECT playlist_id, unnest([2, 5, 7]) AS line_no, unnest(['#EXTINF:3.9,' || name, '#EXTINF:3.9,B', '#EXTINF:3.9,C']) AS extinf, unnest(['http://h/' || playlist_id || '.mp3', playlist_id || '-1.mp3', '/r/' || playlist_id || '.mp3']) AS url FROM c")
def segments(spark, d):
    return playlists.m3u8_segments(lines(spark, d, HLS))


@query("A25_absolute", f"WITH {P} SELECT playlist_id, unnest(['http://h/' || playlist_id || '.mp3', 'https://host.example/live/' || playlist_id || '-1.mp3', 'https://host.example/r/' || playlist_id || '.mp3']) AS url FROM c")
def absolute(spark, d):
    return segments(spark, d).select("playlist_id", playlists.absolute(F.col("url"), F.lit(BASE)).alias("url"))


@query("A26_variants", f"WITH {P} SELECT playlist_id, 'AAC' AS codec, 'https://host.example/live/' || playlist_id || '/p.m3u8' AS url FROM c")
def variants(spark, d):
    form = '#EXTM3U\n#EXT-X-STREAM-INF:B=1,CODECS="mp4a.40.5"\n../64/p.m3u8\n#EXT-X-STREAM-INF:B=2,CODECS="mp4a.40.2"\n../{k}/p.m3u8\n#EXT-X-STREAM-INF:B=3,CODECS="mp4a.40.29"\n32/p.m3u8'
    rows = lines(spark, d, form)
    return playlists.variant(rows, rows.select("playlist_id").distinct().withColumn("base_url", F.lit(BASE)))


@query("A28_delta_request", "SELECT page_id, CASE WHEN page_id % 2 = 0 AND NOT contains(url, '_HLS_skip=YES') THEN url || '?_HLS_skip=YES' ELSE url END AS url FROM pages")
def delta_request(spark, d):
    said = F.when(F.col("page_id") % 2 == 0, "#EXTM3U\n#EXT-X-SERVER-CONTROL:CAN-SKIP-UNTIL=12").otherwise("#EXTM3U")
    return table(spark, d, "pages").select("page_id", playlists.delta_request(F.col("url"), said).alias("url"))


@query("B18_stream_titles", "SELECT user_id::VARCHAR AS stream_id, event_id AS seq, event_type AS title FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def stream_titles(spark, d):
    meta = F.concat(F.lit("StreamTitle='"), "event_type", F.lit("';StreamUrl='http://u';"))
    return titles.stream_titles(table(spark, d, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("seq"), meta.alias("meta")))


@query("A3_playable", "SELECT page_id, page_id % 4 = 2 AS ok FROM pages")
def playable(spark, d):
    from tonelake.sources import web

    n = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("http://host/"), n, F.lit(".m4s"))).when(F.col("page_id") % 4 == 1, F.concat(F.lit("http://host/"), n, F.lit(".m4s?x")))
    url = url.when(F.col("page_id") % 4 == 2, F.concat(F.lit("http://host/"), n, F.lit(".ts"))).otherwise(F.lit("http:"))
    return table(spark, d, "pages").select("page_id", web.playable(url).alias("ok"))


@query("A2_url_expectation", f"SELECT page_id, {picked(['M3U8', 'MP3', None, 'PLS', 'ASX', 'M3U', 'FLAC'], 'page_id')} AS kind FROM pages")
def url_expectation(spark, d):
    end = pick([".m3u8?x=1", ".mp3", "", ".PLS", ".asx?y", ".m3u", ".flac"], F.col("page_id"))
    url = F.concat(F.lit("http://host.example/p"), F.col("page_id").cast("string"), end)
    return table(spark, d, "pages").select("page_id", lookups.url_expectation(url).alias("kind"))


@query("I17_cases", "SELECT doc_id, replace(coalesce(text, ''), '+', ' ') || ' 100%' AS back FROM documents WHERE NOT contains(coalesce(text, ''), '%')")
def url_decode_cases(spark, d):
    """Spaces as plus signs, a percent sign that encodes nothing; other characters as they are."""
    s = F.concat(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("+")), F.lit("%20100%"))
    return table(spark, d, "documents").where("NOT contains(coalesce(text, ''), '%')").select("doc_id", text.url_decode(s).alias("back"))


@query("I13_cases", "SELECT p_partkey, '<b>' || p_name || '</b> & ' || CASE WHEN p_partkey % 2 = 0 THEN chr(65 + (p_partkey % 26)::INTEGER) ELSE '&#x' || to_hex(65 + p_partkey % 26) || ';' END || ' &nope; &' AS plain FROM part")
def html_cases(spark, d):
    """Entities by name and decimal number; hexadecimal ones, unknown names and a bare sign stay."""
    code = (F.col("p_partkey") % 26 + 65).cast("int")
    number = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("&#"), code.cast("string"), F.lit(";"))).otherwise(F.concat(F.lit("&#x"), F.hex(code), F.lit(";")))
    part = table(spark, d, "part").select("p_partkey", "p_name").repartition("p_partkey")
    return part.select("p_partkey", text.html_to_utf8(F.concat(F.lit("&lt;b&gt;"), "p_name", F.lit("&lt;/b&gt; &amp; "), number, F.lit(" &nope; &"))).alias("plain"))


@query("J4_wav_alignment", "SELECT event_id, event_id // (2 * (1 + event_id % 4)) * (2 * (1 + event_id % 4)) + 44 AS at FROM events")
def wav_alignment(spark, d):
    """Byte positions at the start of a frame of 2 to 8 bytes behind a header of 44."""
    width = (F.col("event_id") % 4 + 1) * 2
    at = F.coalesce(*[F.when(width == w, running.aligned(F.col("event_id"), 44, w)) for w in (2, 4, 6, 8)])
    return table(spark, d, "events").select("event_id", at.alias("at"))


@query("L3_event_types", f"SELECT event_id, e, s FROM (SELECT event_id, event_id % 17 AS e FROM events) LEFT JOIN (VALUES {values(EVENTS)}) v(e, s) USING (e)")
def event_types(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("event_id") % 17).cast("int").alias("e")).join(F.broadcast(lookups.events(spark)), "e", "left").select("event_id", "e", "s")


@query("L9_settings", "SELECT event_id, event_id // 2048 AS window_no, least(event_id % 256 + 200, 255) AS raised, greatest(event_id % 256 - 30, 0) AS bars, greatest(event_id % 256 - 10, 0) AS peak FROM events")
def settings(spark, d):
    """What the defaults make of an event's frame and of a level: its window, a rise, and both releases."""
    s, level = Settings(), F.col("event_id") % 256
    falls = {n: F.greatest(level - e.release, F.lit(0)) for n, e in (("bars", s.vu_bars), ("peak", s.vu_peak))}
    return table(spark, d, "events").select("event_id", F.expr(f"event_id div {s.window}").alias("window_no"), F.least(level + s.vu_bars.attack, F.lit(255)).alias("raised"), *[v.alias(n) for n, v in falls.items()])


@query("L9_checked_settings", "SELECT user_id, count(*) AS events, count(*) FILTER (event_id % 40 BETWEEN 0 AND 21) AS admitted FROM events GROUP BY user_id")
def checked_settings(spark, d):
    """Of the volumes that events ask for those that the checks admit, volume by volume."""
    admitted = []
    for volume in range(40):
        try:
            admitted.append(Settings(volume=volume).checked().volume)
        except ValueError:
            continue
    e = table(spark, d, "events").withColumn("ok", (F.col("event_id") % 40).isin(admitted))
    return e.groupBy("user_id").agg(F.count("*").alias("events"), F.count_if("ok").alias("admitted"))


@query(
    "H4_bounded_queue",
    """WITH RECURSIVE t AS (SELECT user_id, event_id // 20 AS tick, count(*) AS a FROM events GROUP BY ALL), g AS (SELECT u.user_id, k.range AS tick, coalesce(a, 0) AS a FROM (SELECT DISTINCT user_id FROM events) u
    CROSS JOIN range(coalesce((SELECT max(event_id) // 20 + 1 FROM events), 0)) k LEFT JOIN t ON t.user_id = u.user_id AND t.tick = k.range),
    q AS (SELECT user_id, -1::BIGINT AS tick, 0::BIGINT AS a, 0::BIGINT AS taken, 0::BIGINT AS dropped, 0::BIGINT AS drained, 0::BIGINT AS waiting FROM (SELECT DISTINCT user_id FROM events)
    UNION ALL SELECT g.user_id, g.tick, g.a, least(g.a, 3 - waiting), g.a - least(g.a, 3 - waiting), least(1, waiting + least(g.a, 3 - waiting)), waiting + least(g.a, 3 - waiting) - least(1, waiting + least(g.a, 3 - waiting))
    FROM q JOIN g ON g.user_id = q.user_id AND g.tick = q.tick + 1) SELECT user_id::VARCHAR AS stream_id, tick, a AS arrivals, taken, dropped, drained, waiting FROM q WHERE tick >= 0""",
)
def bounded_queue(spark, d):
    """Events of a user in ticks of 20, a queue of three and one drained a tick; all ticks count, also those without an event."""
    from tonelake.operators import queueing

    e = table(spark, d, "events").withColumn("tick", F.expr("(event_id - pmod(event_id, 20)) div 20"))
    last = e.agg(F.max("tick")).first()[0]
    own = e.where("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("stream_id"), "tick", F.lit(1).alias("arrivals"))
    return queueing.queued_throughout(own, -1 if last is None else last, 3, 1)


@query("E7_profile", "SELECT 'VU windows' AS name, 3 AS runs, count(*) AS rows, TRUE AS told FROM (SELECT event_id // 64 FROM events GROUP BY 1 HAVING count(*) = 64)")
def profile(spark, d):
    """Three runs of the level meter; the times themselves are only checked for sense."""
    from tonelake.operators import meters
    from tonelake.plans.profile import profiled

    pcm = table(spark, d, "events").select(F.lit("e").alias("stream_id"), F.col("event_id").alias("frame_no"), sample().alias("left"), sample().alias("right"))
    return profiled("VU windows", meters.vu_windows(pcm, 64), 3).select("name", "runs", "rows", F.expr("mean_us > 0 AND mean_us <= max_us").alias("told"))
