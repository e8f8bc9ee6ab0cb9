"""Queries over text: scalars, URLs, lookups, titles, headers and playlists, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import requests, text
from tonelake.operators import lookups, titles
from tonelake.plans.bindings import table
from tonelake.sources import headers, playlists

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def values(rows: list[tuple]) -> str:
    def one(v) -> str:
        return "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url", "html")


@query(
    "I1_affixes",
    """SELECT page_id, starts_with(url, 'https://') AS tls, starts_with(lower(url), 'http://m.') AS mobile, ends_with(url, '/') AS folder, ends_with(lower(html), '</html>') AS closed FROM pages""",
)
def affixes(spark, d):
    u, h = F.col("url"), F.col("html")
    return pages(spark, d).select("page_id", text.starts_with(u, "https://").alias("tls"), text.starts_with(u, "HTTP://M.", True).alias("mobile"), text.ends_with(u, "/").alias("folder"), text.ends_with(h, "</HTML>", True).alias("closed"))


@query("I2_equals", "SELECT event_id, event_type = 'click' AS same, lower(event_type) = 'click' AS folded FROM events")
def equals(spark, d):
    e = F.col("event_type")
    return table(spark, d, "events").select("event_id", text.equals(e, F.lit("click")).alias("same"), text.equals(e, F.lit("CLICK"), True).alias("folded"))


@query(
    "I3_index_of",
    """SELECT page_id, instr(url, '/') - 1 AS first, CASE WHEN instr(substr(url, 9), '/') = 0 THEN -1 ELSE instr(substr(url, 9), '/') + 7 END AS after, instr(lower(html), '<title') - 1 AS folded,
    CASE WHEN instr(url, '/') = 0 THEN -1 ELSE length(url) - instr(reverse(url), '/') END AS last FROM pages""",
)
def index_of(spark, d):
    u = F.col("url")
    cols = {"first": text.index_of(u, "/"), "after": text.index_of(u, "/", 8), "folded": text.index_of(F.col("html"), "<TITLE", 0, True), "last": text.last_index_of(u, "/")}
    return pages(spark, d).select("page_id", *[c.cast("bigint").alias(n) for n, c in cols.items()])


@query(
    "I4_bytes_index_of",
    """SELECT page_id, CASE WHEN contains(url, '://') THEN strlen(split_part(url, '://', 1)) ELSE -1 END AS at, CASE WHEN contains(url, '/') THEN strlen(url) - 1 - strlen(split_part(url, '/', -1)) ELSE -1 END AS last FROM pages WHERE url IS NOT NULL
    UNION ALL SELECT page_id, NULL, NULL FROM pages WHERE url IS NULL""",
)
def bytes_index_of(spark, d):
    b = F.encode("url", "UTF-8")
    return pages(spark, d).select("page_id", text.bytes_index_of(b, b"://").cast("bigint").alias("at"), text.bytes_index_of(b, b"/", True).cast("bigint").alias("last"))


@query(
    "I5_cutting",
    """SELECT page_id, substr(url, 5) AS rest, substr(url, 1, 4) || '+' || substr(url, 5) AS inserted, split_part(url, '?', 1) AS cut, CASE WHEN starts_with(url, 'https://') THEN substr(url, 9) ELSE url END AS bare,
    CASE WHEN instr(url, '#') = 0 THEN url ELSE substr(url, instr(url, '#')) END AS mark, translate(url, '/.', '') AS thin FROM pages""",
)
def cutting(spark, d):
    u = F.col("url")
    cols = {"rest": text.substr(u, 4), "inserted": text.insert(u, "+", 4), "cut": text.truncate_at(u, "?"), "bare": text.remove_prefix(u, "https://"), "mark": text.remove_before(u, "#"), "thin": text.remove_chars(u, "/.")}
    return pages(spark, d).select("page_id", *[c.alias(n) for n, c in cols.items()])


@query("I6_replace_trim", "SELECT doc_id, replace(text, 'the', 'THE') AS swapped, contains(text, 'and') AS has, contains(lower(text), 'on the') AS folded, trim(text, ' \t\n\r' || chr(11) || chr(12)) AS trimmed, lower(text) AS low FROM documents")
def replace_trim(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.replace(t, F.lit("the"), F.lit("THE")).alias("swapped"), text.contains(t, "and").alias("has"), text.contains(t, "ON THE", True).alias("folded"), text.trim(t).alias("trimmed"), F.lower(t).alias("low"))


@query("I7_lengths", "SELECT doc_id, strlen(text) AS bytes, length(text) AS points, length(regexp_replace(chr(27) || '[31m' || text, '\\x1b\\[[^@-~]*[@-~]?', '', 'g')) AS plain FROM documents")
def lengths(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", F.octet_length(t).cast("bigint").alias("bytes"), F.char_length(t).cast("bigint").alias("points"), text.utf8_length(F.concat(F.lit("\x1b[31m"), t)).cast("bigint").alias("plain"))


NUMBERS = [("12",), ("-7x",), ("0x1F",), ("  42 ",), ("ff",), ("",), ("abc",), ("+9",)]


@query(
    "I8_to_int",
    f"""SELECT s, coalesce(try_cast(nullif(regexp_extract(s, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), 0) AS ten,
    CASE s WHEN '12' THEN 18 WHEN '-7x' THEN -7 WHEN '0x1F' THEN 31 WHEN '  42 ' THEN 66 WHEN 'ff' THEN 255 WHEN 'abc' THEN 2748 WHEN '+9' THEN 9 ELSE 0 END::BIGINT AS sixteen,
    CASE s WHEN '0x1F' THEN 31 ELSE coalesce(try_cast(nullif(regexp_extract(s, '^\\s*([+-]?\\d+)', 1), '') AS BIGINT), 0) END AS by_prefix FROM (VALUES {values(NUMBERS)}) v(s)""",
)
def to_int(spark, d):
    s = F.col("s")
    return spark.createDataFrame(NUMBERS, "s string").select("s", text.to_int(s).alias("ten"), text.to_int(s, 16).alias("sixteen"), text.to_int(s, 0).alias("by_prefix"))


@query(
    "I9_endianness",
    """SELECT event_id, event_id % 16777216 AS big, (event_id % 256) * 65536 + (event_id // 256 % 256) * 256 + event_id // 65536 % 256 AS little,
    (event_id // 16777216 % 128) * 2097152 + (event_id // 65536 % 256) * 16384 + (event_id // 256 % 256) * 128 + event_id % 256 AS safe FROM events""",
)
def endianness(spark, d):
    b = F.unhex(F.lpad(F.hex(F.col("event_id")), 8, "0"))
    return table(spark, d, "events").select("event_id", text.big_endian(F.substring(b, 2, 3)).alias("big"), text.little_endian(F.substring(b, 2, 3)).alias("little"), text.syncsafe(b).alias("safe"))


@query("I10_latin_to_utf8", "SELECT doc_id, text AS utf, regexp_replace(text, '[^\\x00-\\xff]', '?', 'g') AS latin, TRUE AS valid FROM documents")
def latin_to_utf8(spark, d):
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xff]", "?"), "ISO-8859-1")
    return docs(spark, d).select("doc_id", text.latin_to_utf8(F.encode("text", "UTF-8")).alias("utf"), text.latin_to_utf8(latin).alias("latin"), F.is_valid_utf8("text").alias("valid"))


@query("I12_utf16", "SELECT doc_id, text AS little, text AS big, text AS marked FROM documents")
def utf16(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", text.from_utf16(F.encode(t, "UTF-16LE"), False).alias("little"), text.from_utf16(F.encode(t, "UTF-16BE"), True).alias("big"), text.from_utf16(F.encode(t, "UTF-16")).alias("marked"))


ENTITY_MAP = "MAP {" + ", ".join(f"'&{n};': '{c.replace(chr(39), chr(39) * 2)}'" for n, c in text.ENTITIES) + "}"
HTML_SQL = f"""list_aggregate(list_transform(regexp_extract_all(%s, '&#\\d+;|&[a-zA-Z]+;|[^&]+|&'), lambda t: coalesce({ENTITY_MAP}[t],
    CASE WHEN regexp_matches(t, '^&#\\d{{1,7}};$') THEN chr(substr(t, 3, length(t) - 3)::INTEGER) END, t)), 'string_agg', '')"""


@query("I13_html_to_utf8", f"SELECT page_id, {HTML_SQL % 'html'} AS plain FROM pages")
def html_to_utf8(spark, d):
    return pages(spark, d).select("page_id", text.html_to_utf8(F.col("html")).alias("plain"))


@query("I13_cases", "SELECT * FROM (VALUES ('&amp;lt;', '&lt;'), ('odcie&#324; x', 'odcień x'), ('&middot; &euro;', '&middot; €'), ('a & b', 'a & b'), ('', '')) v(s, plain)")
def html_cases(spark, d):
    rows = [("&amp;lt;",), ("odcie&#324; x",), ("&middot; &euro;",), ("a & b",), ("",)]
    return spark.createDataFrame(rows, "s string").select("s", text.html_to_utf8(F.col("s")).alias("plain"))


@query("I14_unicode_to_utf8", "SELECT * FROM (VALUES ('\\u042d\\u0442\\u043e', 'Это'), ('a\\u00e9b', 'aéb'), ('no \\ud83d pair', 'no \\ud83d pair'), ('back\\slash', 'back\\slash')) v(s, plain)")
def unicode_to_utf8(spark, d):
    rows = [("\\u042d\\u0442\\u043e",), ("a\\u00e9b",), ("no \\ud83d pair",), ("back\\slash",)]
    return spark.createDataFrame(rows, "s string").select("s", text.unicode_to_utf8(F.col("s")).alias("plain"))


@query("I15_is_json", "SELECT event_id, regexp_matches(props, '^\\s*\\{.*\\}\\s*$') AND json_valid(props) AS shape FROM events")
def is_json(spark, d):
    return table(spark, d, "events").select("event_id", text.is_json(F.col("props")).alias("shape"))


@query(
    "I16_url_encode",
    """SELECT doc_id, replace(text, ' ', '%20') AS spaces, list_aggregate(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9]+'), lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9]') THEN t
    ELSE regexp_replace(hex(encode(t)), '(..)', '%\\1', 'g') END), 'string_agg', '') AS every FROM documents""",
)
def url_encode(spark, d):
    return docs(spark, d).select("doc_id", text.url_encode(F.col("text"), True).alias("spaces"), text.url_encode(F.col("text")).alias("every"))


@query("I17_url_decode", "SELECT doc_id, text AS back FROM documents")
def url_decode(spark, d):
    return docs(spark, d).select("doc_id", text.url_decode(text.url_encode(F.col("text"))).alias("back"))


@query("I17_cases", "SELECT * FROM (VALUES ('a+b%20c', 'a b c'), ('100%', '100%'), ('%zz', '%zz'), ('%C3%A9', 'é')) v(s, back)")
def url_decode_cases(spark, d):
    return spark.createDataFrame([("a+b%20c",), ("100%",), ("%zz",), ("%C3%A9",)], "s string").select("s", text.url_decode(F.col("s")).alias("back"))


@query("I18_base64", "SELECT doc_id, base64(encode(text)) AS b64 FROM documents")
def base64(spark, d):
    return docs(spark, d).select("doc_id", F.translate(text.b64_encode(F.col("text")), "\r\n", "").alias("b64"))


URL_CASES = [(1, "https://host.example:8000/a/b.mp3;?user=x;&pwd=y"), (2, "http://h/p"), (3, "h.example"), (4, "https://h?x=1#f"), (5, "http://h:80"), (6, "http://h/p?q=a/b?c")]
URLS_SQL = f"(SELECT page_id AS id, url FROM pages UNION ALL SELECT id + 100000000, url FROM (VALUES {values(URL_CASES)}) v(id, url))"
PARTS_SQL = f"""SELECT id, starts_with(url, 'https://') AS ssl, regexp_extract(rest, '^([^:/?]*)', 1) AS host,
    CASE WHEN regexp_matches(rest, '^[^:/]*:') THEN coalesce(try_cast(regexp_extract(rest, '^[^:/]*:(\\d*)', 1) AS INTEGER), 0) WHEN starts_with(url, 'https://') THEN 443 ELSE 80 END AS port,
    regexp_extract(rest, '^[^/?]*/([^?]*)', 1) AS path, regexp_extract(rest, '(?s)\\?(.*)$', 1) AS query, regexp_matches(rest, '^[^:/]*:') AS given FROM (SELECT id, url, regexp_replace(url, '^https?://', '') AS rest FROM {URLS_SQL})"""


def _urls(spark, d):
    more = spark.createDataFrame([(100_000_000 + i, u) for i, u in URL_CASES], "id long, url string")
    return pages(spark, d).select(F.col("page_id").alias("id"), "url").unionByName(more)


@query("I19_url_parts", f"SELECT id, ssl, host, CASE WHEN given THEN host || ':' || port ELSE host END AS request_host, port, path, query FROM ({PARTS_SQL})")
def url_parts(spark, d):
    return _urls(spark, d).select("id", requests.url_parts(F.col("url")).alias("p")).select("id", "p.*")


@query("A3_same_connection", f"SELECT id, coalesce(host = lag(host) OVER w AND port = lag(port) OVER w AND ssl = lag(ssl) OVER w, FALSE) AS reuse FROM ({PARTS_SQL}) WINDOW w AS (PARTITION BY id % 10 ORDER BY id)")
def same_connection(spark, d):
    from pyspark.sql import Window

    p = _urls(spark, d).select("id", requests.url_parts(F.col("url")).alias("p"))
    before = F.lag("p").over(Window.partitionBy(F.col("id") % 10).orderBy("id"))
    return p.withColumn("b", before).select("id", F.coalesce(requests.same_connection(F.col("p"), F.col("b")), F.lit(False)).alias("reuse"))


HEAD = "\r\nIcy-MetaData:1\r\nPragma: no-cache\r\nCache-Control: no-cache\r\nRange: bytes=0-\r\nAccept: */*\r\nUser-Agent: tonelake/1.0\r\n"


@query(
    "A2_stream_request",
    f"""SELECT id, 'GET /' || replace(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, ' ', '%20') || ' HTTP/1.1{chr(13)}{chr(10)}Host: ' || CASE WHEN given THEN host || ':' || port ELSE host END || '{HEAD}'
    || 'Authorization: Basic dTpw{chr(13)}{chr(10)}Accept-Encoding: identity;q=1,*;q=0{chr(13)}{chr(10)}Connection: keep-alive{chr(13)}{chr(10)}{chr(13)}{chr(10)}' AS request FROM ({PARTS_SQL})""",
)
def stream_request(spark, d):
    return _urls(spark, d).select("id", requests.stream_request(F.col("url"), "u", "p").alias("request"))


@query("A4_range_request", "SELECT event_id, event_id * 1000 + 4096 AS last FROM events")
def range_request(spark, d):
    return table(spark, d, "events").select("event_id", requests.range_end(F.col("event_id") * 1000, F.lit(4096)).alias("last"))


ENCODED = ORACLE_SQL["I16_url_encode"]


@query("A5_speech_request", f"SELECT doc_id, 'GET /translate_tts?ie=UTF-8&tl=en&client=tw-ob&q=' || every || ' HTTP/1.1{chr(13)}{chr(10)}Host: tts.example{chr(13)}{chr(10)}User-Agent: tonelake/1.0{chr(13)}{chr(10)}Accept-Encoding: identity{chr(13)}{chr(10)}Accept: text/html{chr(13)}{chr(10)}Connection: close{chr(13)}{chr(10)}{chr(13)}{chr(10)}' AS request FROM ({ENCODED})")
def speech_request(spark, d):
    return docs(spark, d).select("doc_id", requests.speech_request(F.col("text"), "en", "tts.example").alias("request"))


@query(
    "A6_speech_body",
    """SELECT doc_id, '{"model":"m","stream":true,"input":"' || replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t'), chr(8), '\\b'), chr(12), '\\f')
    || '","instructions":"","voice":"v","response_format":"mp3","speed":1.0}' AS body FROM documents""",
)
def speech_body(spark, d):
    return docs(spark, d).select("doc_id", requests.speech_body("m", F.col("text"), F.lit(None).cast("string"), "v", "mp3", "1.0").alias("body"))


@query("I20_last_number", "SELECT page_id, try_cast(nullif(regexp_extract(replace(url, '/', ' '), '(?:^|\\s)([+-]?\\d+)\\s*$', 1), '') AS BIGINT) AS n FROM pages")
def last_number(spark, d):
    return pages(spark, d).select("page_id", text.last_number(F.translate("url", "/", " ")).alias("n"))


@query("I21_formatted", "SELECT event_id, lpad((event_id // 60)::VARCHAR, greatest(2, length((event_id // 60)::VARCHAR))::INTEGER, '0') || ':' || lpad((event_id % 60)::VARCHAR, 2, '0') || ' #' || upper(to_hex(event_id)) AS label FROM events")
def formatted(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", text.formatted("{:02}:{:02} #{:X}", F.expr("event_id div 60"), e % 60, e).alias("label"))


LYRICS = [("[01:02.03] la",), ("[00:00.00]",), ("no time",), ("[1:2.3]x",), ("[12:34]",)]


@query("I22_lyric_ms", "SELECT * FROM (VALUES ('[01:02.03] la', 62030), ('[00:00.00]', 0), ('no time', -1), ('[1:2.3]x', 62030), ('[12:34]', -1)) v(s, ms)")
def lyric_ms(spark, d):
    return spark.createDataFrame(LYRICS, "s string").select("s", text.lyric_ms(F.col("s")).alias("ms"))


@query("I24_crc8", "SELECT * FROM (VALUES ('313233343536373839', 244), ('', 0), ('FFF8C918000C', 100)) v(h, crc)")
def crc8(spark, d):
    rows = [("313233343536373839",), ("",), ("FFF8C918000C",)]
    return spark.createDataFrame(rows, "h string").select("h", text.crc8(F.unhex("h")).alias("crc"))


@query("I25_json_escape", "SELECT event_id, replace(replace(props, '\\', '\\\\'), '\"', '\\\"') AS escaped FROM events")
def json_escape(spark, d):
    return table(spark, d, "events").select("event_id", text.json_escape(F.col("props")).alias("escaped"))


MIME_ROWS = [(m, k) for k, of in lookups.MIME.items() for m in of]
TAG_ROWS = list(lookups.TAGS.items())
CONTENT = [(i, m) for i, m in enumerate(["Audio/MPEG; charset=x", "audio/mpegurl", "application/json", "video/mp2t", "text/html", "image/png", " audio/ogg "])]


@query("A12_content_types", "SELECT m.* FROM (VALUES (0, 'MP3', 'MP3'), (1, 'M3U', 'M3U8'), (2, 'TXT', 'M3U8'), (3, 'AAC', 'MP3'), (4, 'TXT', 'M3U8'), (5, NULL, NULL), (6, 'OGG', 'OGG')) m(id, kind, final)")
def content_types(spark, d):
    rows = lookups.with_mime_kind(spark.createDataFrame(CONTENT, "id int, content_type string"))
    return rows.select("id", "kind", lookups.content_kind(F.col("kind"), F.col("content_type"), F.lit("M3U8"), F.lit("MP3")).alias("final"))


@query("G1_mime_lookup", f"SELECT event_id, mime, kind FROM (SELECT event_id, (ARRAY[{', '.join(repr(m) for m, _ in MIME_ROWS)}, 'x/y'])[1 + event_id % 38] AS mime FROM events) LEFT JOIN (VALUES {values(MIME_ROWS)}) v(mime, kind) USING (mime)")
def mime_lookup(spark, d):
    names = F.array(*[F.lit(m) for m, _ in MIME_ROWS], F.lit("x/y"))
    return lookups.with_mime_kind(table(spark, d, "events").select("event_id", F.element_at(names, (1 + F.col("event_id") % 38).cast("int")).alias("mime")), "mime").select("event_id", "mime", "kind")


@query("G2_tag_labels", f"SELECT * FROM (VALUES {values(TAG_ROWS)}) v(tag, label)")
def tag_labels(spark, d):
    return lookups.with_tag_labels(lookups.tag_labels(spark).select("tag"))


@query("B8_tag_text", f"SELECT tag, label || ': ' || tag AS shown FROM (VALUES {values(TAG_ROWS)}) v(tag, label)")
def tag_text(spark, d):
    return lookups.with_tag_labels(lookups.tag_labels(spark).select("tag")).select("tag", F.concat("label", F.lit(": "), "tag").alias("shown"))


@query("G3_entities", "SELECT * FROM (VALUES " + values([(f"&{n};", c) for n, c in text.ENTITIES]) + ") v(entity, c)")
def entities(spark, d):
    return spark.createDataFrame([(f"&{n};",) for n, _ in text.ENTITIES], "entity string").select("entity", text.html_to_utf8(F.col("entity")).alias("c"))


PATHS = [("a/b.mp3", "MP3"), ("x.OGA", "OGG"), ("x.txt", None), ("noext", None), ("c.flac", "FLAC")]


@query("A1_extension_codec", f"SELECT * FROM (VALUES {values(PATHS)}) v(path, codec)")
def extension_codec(spark, d):
    return spark.createDataFrame([(p,) for p, _ in PATHS], "path string").select("path", lookups.extension_codec(F.col("path")).alias("codec"))


XML = "StreamTitle='<?xml version=\"1.0\"?><R><DB_DALET_TITLE_NAME>BOY</DB_DALET_TITLE_NAME><DB_LEAD_ARTIST_NAME>Dove</DB_LEAD_ARTIST_NAME></R>';StreamUrl='';"
META = [
    ("s", 0, "StreamTitle='Bielszy odcie&#324; bluesa';StreamUrl='http://u';", "Bielszy odcień bluesa"), ("s", 1, "StreamTitle='Bielszy odcie&#324; bluesa';", None), ("s", 2, XML, "BOY - Dove"),
    ("s", 3, "Grouping:Hits", "Hits"), ("s", 4, '#EXTINF:10,title="Dan",artist="zc1"', "Dan - zc1"), ("s", 5, '#EXTINF:10,title="text=\\"Spot\\" x",artist=" "', "Spot"),
    ("s", 6, "x;adw_ad='true';durationMilliseconds='10135';", None), ("t", 0, "StreamTitle='';", None), ("t", 1, "StreamTitle='{\"status\":1,\"result\":\"\\u042d ok\"}';", "Э ok"), ("t", 2, "StreamTitle='It's on';", "It's on"),
]


@query("B18_stream_titles", f"SELECT stream_id, seq, title FROM (VALUES {values([r[:2] + r[3:] for r in META])}) v(stream_id, seq, title) WHERE title IS NOT NULL")
def stream_titles(spark, d):
    return titles.stream_titles(spark.createDataFrame([r[:3] for r in META], "stream_id string, seq int, meta string"))


@query("F7_changes", "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def changes(spark, d):
    return titles.changes(table(spark, d, "events").select("user_id", "event_id", "event_type"), "event_type", ("user_id",), "event_id")


HEADER = [
    ("a", ["HTTP/1.1 200 OK", "Content-Type: audio/mpeg", "icy-name: Radio X", "icy-metaint:16000", "icy-br:128", "Transfer-Encoding: chunked"]),
    ("b", ["HTTP/1.1 200 OK", "content-type: audio/flac; x", "Content-Length: 12345", "Accept-Ranges: bytes", "content-disposition: attachment; filename=\"f.flac\""]),
    ("c", ["HTTP/1.1 404 Not Found", "Content-Type: text/html"]), ("d", ["HTTP/1.1 301 Moved", "Location: http://n/"]), ("e", ["HTTP/1.1 200 OK", "Content-Type: audio/aac", "Content-Encoding: gzip"]),
]
HEADER_ROWS = [(c, i, line) for c, of in HEADER for i, line in enumerate(of)]


@query(
    "A14_headers",
    """SELECT * FROM (VALUES ('a', 200, 'MP3', 'Radio X', 16000, 128000, 0, TRUE, NULL, 'ok', 'webstream'), ('b', 200, 'FLAC', NULL, NULL, NULL, 12345, FALSE, 'f.flac', 'ok', 'webfile'),
    ('c', 404, 'TXT', NULL, NULL, NULL, 0, FALSE, NULL, 'error', 'webstream'), ('d', 301, NULL, NULL, NULL, NULL, 0, FALSE, NULL, 'redirect', 'webstream'), ('e', 200, 'AAC', NULL, NULL, NULL, 0, FALSE, NULL, 'error', 'webstream'))
    v(conn_id, status, kind, icy_name, metaint, nominal_bitrate, content_length, chunked, filename, state, stream_type)""",
)
def header_summary(spark, d):
    out = headers.summary(spark.createDataFrame(HEADER_ROWS, "conn_id string, line_no int, line string"))
    return out.select("conn_id", "status", "kind", "icy_name", "metaint", "nominal_bitrate", F.coalesce("content_length", F.lit(0)).alias("content_length"), F.coalesce("chunked", F.lit(False)).alias("chunked"), "filename", "state", "stream_type")


@query("A15_stream_type", "SELECT * FROM (VALUES ('a', 'webstream'), ('b', 'webfile'), ('c', 'webstream'), ('d', 'webstream'), ('e', 'webstream')) v(conn_id, stream_type)")
def stream_type(spark, d):
    return headers.summary(spark.createDataFrame(HEADER_ROWS, "conn_id string, line_no int, line string")).select("conn_id", "stream_type")


M3U = [("m", "#EXTM3U\n#EXTINF:-1,DONAU 3 FM\nhttps://edge.example/donau\nhttps://b/\n"), ("n", "junk\nhttp://plain.example/x \r\n"), ("h", "<html>http://no/</html>")]


@query("A20_lines", "SELECT * FROM (VALUES ('m', 0, '#EXTM3U'), ('m', 1, '#EXTINF:-1,DONAU 3 FM'), ('m', 2, 'https://edge.example/donau'), ('m', 3, 'https://b/'), ('n', 0, 'junk'), ('n', 1, 'http://plain.example/x ')) v(playlist_id, line_no, line)")
def playlist_lines(spark, d):
    return playlists.lines(spark.createDataFrame(M3U, "playlist_id string, content string"))


@query("A21_m3u", "SELECT * FROM (VALUES ('m', 'https://edge.example/donau', 'DONAU 3 FM'), ('n', 'http://plain.example/x', NULL)) v(playlist_id, url, title)")
def m3u(spark, d):
    rows = playlists.lines(spark.createDataFrame(M3U, "playlist_id string, content string"))
    return playlists.m3u_url(rows).join(playlists.m3u_titles(rows).select("playlist_id", "title"), "playlist_id", "left")


PLS = [("p", "[playlist]\nNumberOfEntries=2\nTitle2=Second\nFile1=D:\\album.flac\nTitle1=Local\nFile2=http://s.example:80\n"), ("q", "File1=http://no.header/")]


@query("A22_pls", "SELECT * FROM (VALUES ('p', 'http://s.example:80', 'Second')) v(playlist_id, url, title)")
def pls(spark, d):
    return playlists.pls_url(playlists.lines(spark.createDataFrame(PLS, "playlist_id string, content string")))


ASX = [("x", '<asx version="3.0">\n<title>All</title>\n<entry>\n<title>One</title>\n</entry>\n<entry>\n<title>Two</title>\n<author>A</author>\n<ref href="http://e/s.wma" />\n</entry>\n</asx>')]


@query("A23_asx", "SELECT * FROM (VALUES ('x', 'http://e/s.wma', 'Two')) v(playlist_id, url, title)")
def asx(spark, d):
    return playlists.asx_url(playlists.lines(spark.createDataFrame(ASX, "playlist_id string, content string")))


HLS = [("k", "#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:0\n#EXTINF:3.9,A\n#EXT-X-PROGRAM-DATE-TIME:2025\nhttp://h/0.mp3\n#EXTINF:3.9,B\n1.mp3\n#EXTINF:3.9,C\n/r/2.mp3\n#EXTINF:3.9,D\n3.mp3\n")]
VAR = [
    ("v", '#EXTM3U\n#EXT-X-STREAM-INF:B=1,CODECS="mp4a.40.5"\n../64/p.m3u8\n#EXT-X-STREAM-INF:B=2,CODECS="mp4a.40.2"\n112/p.m3u8\n#EXT-X-STREAM-INF:B=3,CODECS="mp4a.40.29"\n32/p.m3u8'),
    ("w", "#EXTM3U\n#EXT-X-STREAM-INF:B=1\na.m3u8\n#EXT-X-STREAM-INF:B=2\nhttp://z/b.m3u8"), ("y", '#EXT-X-STREAM-INF:CODECS="mp4a.40.34"\nm.m3u8'),
]
BASE = "https://host.example/live/list.m3u8"


@query("A24_segments", "SELECT * FROM (VALUES ('k', 2, '#EXTINF:3.9,A', 'http://h/0.mp3'), ('k', 5, '#EXTINF:3.9,B', '1.mp3'), ('k', 7, '#EXTINF:3.9,C', '/r/2.mp3'), ('k', 9, '#EXTINF:3.9,D', '3.mp3')) v(playlist_id, line_no, extinf, url)")
def segments(spark, d):
    return playlists.m3u8_segments(playlists.lines(spark.createDataFrame(HLS, "playlist_id string, content string")))


@query("A25_absolute", "SELECT * FROM (VALUES ('http://h/0.mp3'), ('https://host.example/live/1.mp3'), ('https://host.example/r/2.mp3'), ('https://host.example/live/3.mp3')) v(url)")
def absolute(spark, d):
    return segments(spark, d).select(playlists.absolute(F.col("url"), F.lit(BASE)).alias("url"))


@query("A26_variants", "SELECT * FROM (VALUES ('v', 'AAC', 'https://host.example/live/112/p.m3u8'), ('w', 'AAC', 'http://z/b.m3u8'), ('y', 'MP3', 'https://host.example/live/m.m3u8')) v(playlist_id, codec, url)")
def variants(spark, d):
    rows = playlists.lines(spark.createDataFrame(VAR, "playlist_id string, content string"))
    return playlists.variant(rows, rows.select("playlist_id").distinct().withColumn("base_url", F.lit(BASE)))


@query("A27_fresh_segments", "SELECT user_id::VARCHAR AS playlist_id, event_id AS line_no FROM (SELECT *, coalesce(max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id), -1) AS upto FROM events) WHERE event_id > upto")
def fresh_segments(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("playlist_id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("url"))
    last = rows.select("playlist_id").distinct().withColumn("last_url", F.lit("click"))
    return playlists.fresh(rows, last).select("playlist_id", "line_no")


@query("A28_delta_request", "SELECT * FROM (VALUES (1, 'http://h/a.m3u8?_HLS_skip=YES'), (2, 'http://h/a.m3u8?_HLS_skip=YES'), (3, 'http://h/a.m3u8')) v(id, url)")
def delta_request(spark, d):
    rows = [(1, "http://h/a.m3u8", "#EXT-X-SERVER-CONTROL:X"), (2, "http://h/a.m3u8?_HLS_skip=YES", "#EXT-X-SERVER-CONTROL:X"), (3, "http://h/a.m3u8", "#EXTM3U")]
    return spark.createDataFrame(rows, "id int, u string, c string").select("id", playlists.delta_request(F.col("u"), F.col("c")).alias("url"))


@query("G7_pid_membership", "SELECT event_id, event_id % 256 IN (17, 34, 51, 68) AS listed FROM events")
def pid_membership(spark, d):
    pids = F.array(*[F.lit(p) for p in (17, 34, 51, 68)])
    return table(spark, d, "events").select("event_id", F.array_contains(pids, (F.col("event_id") % 256).cast("int")).alias("listed"))


@query("H1_best_variant", "SELECT user_id, arg_min(event_id, (value, event_id)) AS best FROM events GROUP BY user_id")
def best_variant(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_id", F.struct("value", "event_id")).alias("best"))


@query("H2_first_match", "SELECT user_id, min(event_id) AS first FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def first_match(spark, d):
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.min("event_id").alias("first"))


@query("H4_bounded_queue", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 50")
def bounded_queue(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, d, "events").select("user_id", "event_id", n.alias("n")).where("n <= 50").drop("n")
