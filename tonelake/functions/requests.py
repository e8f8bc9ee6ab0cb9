"""URLs taken apart, and the texts of requests. Nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tonelake.functions import text

AGENT = "tonelake/1.0"


def url_parts(url: Column) -> Column:
    """Struct of ssl, host, request_host (with the port if it is given), port, path and query of a URL.

    The host ends at a colon, slash or question mark; the query runs to the end, fragment included.
    """
    ssl = F.startswith(url, F.lit("https://"))
    rest = F.regexp_replace(url, "^https?://", "")
    host, port = F.regexp_extract(rest, "^([^:/?]*)", 1), F.regexp_extract(rest, r"^[^:/]*:(\d*)", 1)
    given = F.regexp_like(rest, F.lit("^[^:/]*:"))
    number = F.when(given, F.coalesce(port.try_cast("int"), F.lit(0))).otherwise(F.when(ssl, 443).otherwise(80))
    path = F.regexp_extract(rest, r"^[^/?]*/([^?]*)", 1)
    query = F.regexp_extract(rest, r"(?s)\?(.*)$", 1)
    full = F.when(given, F.concat(host, F.lit(":"), number.cast("string"))).otherwise(host)
    return F.struct(ssl.alias("ssl"), host.alias("host"), full.alias("request_host"), number.alias("port"), path.alias("path"), query.alias("query"))


def valid_url(url: Column) -> Column:
    """Whether a trimmed URL has 8 to 2048 characters."""
    return F.char_length(text.trim(url)).between(8, 2048)


def same_connection(a: Column, b: Column) -> Column:
    """Whether two URLs' parts can share a connection."""
    return (a["host"] == b["host"]) & (a["port"] == b["port"]) & (a["ssl"] == b["ssl"])


def stream_request(url: Column, user: str = "", password: str = "", first: int = 0, last: int | None = None) -> Column:
    """The GET request of a stream or file, asking for in-band titles and a byte range."""
    p = url_parts(text.trim(url))
    target = F.concat(p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(""))
    auth = [F.lit("Authorization: Basic "), text.b64_encode(F.lit(f"{user}:{password}")), F.lit("\r\n")] if user and password else []
    head = f"\r\nIcy-MetaData:1\r\nPragma: no-cache\r\nCache-Control: no-cache\r\nRange: bytes={first}-{'' if last is None else last}\r\nAccept: */*\r\nUser-Agent: {AGENT}\r\n"
    return F.concat(F.lit("GET /"), text.url_encode(target, True), F.lit(" HTTP/1.1\r\nHost: "), p["request_host"], F.lit(head), *auth, F.lit("Accept-Encoding: identity;q=1,*;q=0\r\nConnection: keep-alive\r\n\r\n"))


def range_end(seek: Column, length: Column) -> Column:
    """Last byte asked for when re-requesting from ``seek``."""
    return seek + length


def speech_request(words: Column, lang: str, host: str) -> Column:
    """The GET request of a text-to-speech service that takes its text in the URL."""
    return F.concat(F.lit(f"GET /translate_tts?ie=UTF-8&tl={lang}&client=tw-ob&q="), text.url_encode(words), F.lit(f" HTTP/1.1\r\nHost: {host}\r\nUser-Agent: {AGENT}\r\nAccept-Encoding: identity\r\nAccept: text/html\r\nConnection: close\r\n\r\n"))


def speech_body(model: str, words: Column, instructions: Column, voice: str, response_format: str, speed: str) -> Column:
    """The JSON body of a speech service's POST; null for an empty text."""
    e = text.json_escape
    body = F.concat(F.lit(f'{{"model":"{model}","stream":true,"input":"'), e(words), F.lit('","instructions":"'), e(F.coalesce(instructions, F.lit(""))), F.lit(f'","voice":"{voice}","response_format":"{response_format}","speed":{speed}}}'))
    return F.when(F.coalesce(words, F.lit("")) != "", body)


def speech_post(host: str, path: str, key: str, body: Column) -> Column:
    size = F.octet_length(body).cast("string")
    return F.concat(F.lit(f"POST {path} HTTP/1.1\r\nHost: {host}\r\nAuthorization: Bearer {key}\r\nAccept-Encoding: identity;q=1,*;q=0\r\nUser-Agent: {AGENT}\r\nContent-Type: application/json; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"), body, F.lit("\r\n"))


def speech_codec(response_format: Column) -> Column:
    return F.when(response_format.isin("mp3", "opus", "aac", "flac"), F.upper(response_format))
