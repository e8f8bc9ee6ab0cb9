"""HTTP media as a Spark data source: byte ranges of files in batch, and of growing streams as a stream.

Registered with ``register``; then ``spark.read.format("media_http").option("urls", "http://a http://b")``. A row is
(url, offset, data). Options: ``offset`` and ``length`` push a byte range down to the request, ``split`` is the size of a
range that one task fetches, ``retries`` (3) and ``timeout`` in seconds. A server without ranges is read in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tonelake.session import ready

PIECE = 1 << 16


def fetch(url: str, first: int, last: int | None, retries: int, timeout: float) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of a byte range; after a loss it goes on from where it was, ``retries`` times at most."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    at, left = first, retries
    while True:
        ask = Request(url, headers={"Range": f"bytes={at}-{'' if last is None else last}", "Icy-MetaData": "1"})
        try:
            with urlopen(ask, timeout=timeout) as r:  # noqa: S310
                said = r.headers.get("Content-Length")
                end = None if said is None else int(said) + (0 if r.status == 200 else at)
                if r.status == 200:  # the whole, ranges aren't known here
                    r.read(at)
                while data := r.read(PIECE if last is None else min(PIECE, last + 1 - at)):
                    yield at, data
                    at += len(data)
                if (end is None and last is None) or (last is not None and at > last) or (end is not None and at >= end):
                    return
                if left <= 0:
                    raise OSError(f"{url} ends at byte {at} of {end if last is None else last + 1}")
        except HTTPError as e:
            if e.code == 416:
                return
            if e.code < 500 or left <= 0:
                raise
        except OSError:
            if left <= 0:
                raise
        left -= 1


def extent(url: str, timeout: float) -> tuple[int | None, bool]:
    """Length of a resource and whether the server sends ranges."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, method="HEAD"), timeout=timeout) as r:  # noqa: S310
        n = r.headers.get("Content-Length")
        return int(n) if n else None, r.headers.get("Accept-Ranges", "").lower().endswith("bytes")


class Range(InputPartition):
    def __init__(self, url: str, first: int, last: int | None) -> None:
        self.url, self.first, self.last = url, first, last


class _Options:
    def __init__(self, options: dict) -> None:
        self.urls = options["urls"].split()
        if not all(8 <= len(u) <= 2048 for u in self.urls):
            raise ValueError("a URL has 8 to 2048 characters")
        self.offset, self.split = int(options.get("offset", 0)), int(options.get("split", 4 << 20))
        self.length = int(options["length"]) if "length" in options else None
        self.retries, self.timeout = int(options.get("retries", 3)), float(options.get("timeout", 10))

    def ranges(self, url: str, first: int, end: int | None) -> list[Range]:
        return [Range(url, first, None)] if end is None else [Range(url, a, min(a + self.split, end) - 1) for a in range(first, end, self.split)]


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.o = _Options(options)

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        for url in self.o.urls:
            n, ranged = extent(url, self.o.timeout)
            end = n if self.o.length is None else self.o.offset + self.o.length if n is None else min(n, self.o.offset + self.o.length)
            out += self.o.ranges(url, self.o.offset, end) if ranged else [Range(url, self.o.offset, None if end is None else end - 1)]
        return out

    def read(self, p: Range) -> Iterator[tuple]:
        for at, data in fetch(p.url, p.first, p.last, self.o.retries, self.o.timeout):
            yield p.url, at, data


class StreamReader(DataSourceStreamReader):
    """Offsets are bytes of each URL; each trigger takes what the servers have gained, ``split`` a URL at most."""

    def __init__(self, options: dict) -> None:
        self.o, self.at = _Options(options), {}

    def initialOffset(self) -> dict:
        return {u: self.o.offset for u in self.o.urls}

    def latestOffset(self) -> dict:
        have = {u: extent(u, self.o.timeout)[0] or 0 for u in self.o.urls}
        self.at = {u: max(self.at.get(u, self.o.offset), min(have[u], self.at.get(u, self.o.offset) + self.o.split)) for u in self.o.urls}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = {u: max(self.at.get(u, 0), end[u]) for u in end}
        return [Range(u, start.get(u, 0), end[u] - 1) for u in end if end[u] > start.get(u, 0)]

    def read(self, p: Range) -> Iterator[tuple]:
        for at, data in fetch(p.url, p.first, p.last, self.o.retries, self.o.timeout):
            yield p.url, at, data

    def commit(self, end: dict) -> None:
        pass


class HttpSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_http"

    def schema(self) -> str:
        return "url string, offset long, data binary"

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    ready(spark).dataSource.register(HttpSource)
