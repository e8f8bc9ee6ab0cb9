"""Live HLS playlists as a stream: each poll gives the segments that are new, tasks fetch them, and a restart goes on.

The reader's offset is the URL of the last segment, and the rows of the batch that it ends: a playlist is a window that
slides, so what a batch held can't be asked for again, and after a failure it is read from the offset log. A playlist of
variants is followed to its best one at each poll. Playlists are short lists read by the driver; segments, which are the data,
are fetched by tasks.

Registered with ``register``; then ``spark.readStream.format("live_hls").option("url", ..)``: rows (playlist_id, seq, extinf,
url), ``seq`` counting from the playlist's media sequence. Options: ``retries`` and ``timeout`` in seconds. A poll that fails
after its retries gives nothing new; the next one goes on from the same segment.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

from tonelake.session import ready
from tonelake.sources import http, playlists
from tonelake.streaming.stateful import Transport


def body(url: str, retries: int, timeout: float) -> bytes:
    return b"".join(data for _, data in http.fetch(url, 0, None, retries, timeout))


def best_variant(text: str, url: str) -> str | None:
    """The URL of the variant with the best codec, the first of equals, else the last one; none in a list of segments."""
    found = []
    lines = [x for x in text.splitlines() if x]
    for i, (line, after) in enumerate(zip(lines, lines[1:])):
        if line.startswith("#EXT-X-STREAM-INF"):
            rank = next((r for r, c in enumerate(playlists.VARIANT_CODECS) if c in line), None) if 'CODECS="mp4a' in line else None
            found.append(((100, -i) if rank is None else (rank, i), re.sub(r"^(\.\./)+", "", after)))
    return urljoin(url, min(found)[1]) if found else None


def segments(text: str, url: str) -> list[tuple[int, str, str]]:
    """(seq, extinf, url) of a playlist's segments, their URLs absolute; fragments of fragmented MP4 can't be played."""
    lines = [x for x in text.splitlines() if x and not x.startswith("#EXT-X-PROGRAM-DATE-TIME:")]
    first = re.search(r"#EXT-X-MEDIA-SEQUENCE:(\d+)", text)
    pairs = [(a, urljoin(url, b)) for a, b in zip(lines, lines[1:]) if a.startswith("#EXTINF:")]
    return [(int(first[1]) + i if first else i, a, u) for i, (a, u) in enumerate(pairs) if not u.split("?")[0].endswith(".m4s")]


def fresh(found: list[tuple[int, str, str]], last: str) -> list[tuple[int, str, str]]:
    """Those after the last occurrence of the segment played last; all, if it isn't there any more."""
    at = max((i for i, s in enumerate(found) if s[2] == last), default=-1)
    return found[at + 1 :]


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.url, self.retries, self.timeout = options["url"], int(options.get("retries", 3)), float(options.get("timeout", 10))

    def initialOffset(self) -> dict:
        return {"last": "", "rows": "[]"}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        try:
            url = self.url
            text = body(url, self.retries, self.timeout).decode("utf-8", "replace")
            if better := best_variant(text, url):
                url, text = better, body(better, self.retries, self.timeout).decode("utf-8", "replace")
        except OSError:
            return iter(()), start
        rows = [(self.url, *s) for s in fresh(segments(text, url), start["last"])]
        return iter(rows), {"last": rows[-1][3], "rows": json.dumps(rows)} if rows else start

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([tuple(r) for r in json.loads(end["rows"])] if start != end else [])

    def commit(self, end: dict) -> None:
        pass


class LivePlaylist(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_hls"

    def schema(self) -> str:
        return "playlist_id string, seq long, extinf string, url string"

    def simpleStreamReader(self, schema: StructType) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    ready(spark).dataSource.register(LivePlaylist)


def live_segments(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """A streaming DataFrame of a live playlist's segments."""
    register(spark)
    return spark.readStream.format("live_hls").options(url=url, **options).load()


def fetched(rows: DataFrame, retries: int = 3, timeout: float = 10) -> DataFrame:
    """Adds ``content`` to rows with a ``url``, null where it can't be had; tasks fetch, rows are dealt by URL."""
    ready(rows.sparkSession)
    names = [*rows.columns, "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, url in enumerate(batch.column("url").to_pylist()):  # one at a time: segments are large
                try:
                    content = body(url, retries, timeout)
                except (OSError, ValueError):
                    content = None
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([content], pa.binary())], names)

    return rows.repartition("url").mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("content binary").fields]))


def segment_audio(rows: DataFrame) -> DataFrame:
    """(playlist_id, seq, packet_no, data) of fetched segments: audio out of MPEG-TS, each by its own tables; others whole."""
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for playlist, seq, content in zip(*(batch.column(c).to_pylist() for c in ("playlist_id", "seq", "content"))):
                found = [(0, 0, content)]
                if content[:1] == b"\x47":
                    ts = Transport({**Transport.new(), "at": len(content)})
                    found = ts.packets(content)
                yield pa.RecordBatch.from_arrays([pa.array([playlist] * len(found), pa.string()), pa.array([seq] * len(found), pa.int64()), pa.array([n for n, _, _ in found], pa.int32()), pa.array([d for _, _, d in found], pa.binary())], ["playlist_id", "seq", "packet_no", "data"])

    return rows.where("content IS NOT NULL").mapInArrow(run, "playlist_id string, seq long, packet_no int, data binary")


def live_audio(spark: SparkSession, url: str, **options: str) -> DataFrame:
    """A streaming DataFrame of the audio of a live playlist, segment by segment."""
    return segment_audio(fetched(live_segments(spark, url, **options)))
