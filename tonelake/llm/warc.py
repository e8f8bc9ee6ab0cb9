"""WARC archives: writing, normalising monolithic gzip streams, and reading by offset.

``write_monolithic`` writes records as WARC/1.1 into files that are one gzip member each, as poor crawlers do.
``normalise`` inflates such a file once, as a stream (several members are fine too), writes every record as a member of
its own into a new file, and beside it a sidecar index with a line of JSON per record: offset, length, type, target,
record id. ``read_indexed`` reads records through that index, each by its own byte range.

Of records with equal payloads the one with the largest page_id is a response; the others are revisits, which carry the
HTTP header, the payload's digest and length, and whom they refer to, but not the payload. Null html counts as empty. A
null page_id is written as such and never referred to, unless all of its payload are null, which then are responses; so
are rows that repeat the largest page_id. An empty table gives no rows. Columns other than the three named are ignored.

A task names its files anew and returns them with its rows, so files of lost or repeated tasks are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import fresh_path, in_arrow, partitions, table, written

READ = 1 << 20
#: Digests that several rows share, of which as many may be broadcast: 60 bytes each.
MOST_BROADCAST = 200_000


def _opened(path: str, write: bool = False):
    fs, local = FileSystem.from_uri(path)
    if write:
        fs.create_dir(local.rpartition("/")[0], recursive=True)
        return fs.open_output_stream(local, compression=None)
    return fs.open_input_file(local)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record with an HTTP response; a revisit's ends after the HTTP header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that begins with white space goes on with the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode()).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def inflated(file) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of one or more members, in parts of READ bytes at most."""
    d, data, open_ = zlib.decompressobj(31), b"", False
    while data or (data := file.read(READ)):
        if not open_ and not data.strip(b"\0"):  # zeros may follow the last member
            data = b""
            continue
        part = d.decompress(data, READ)
        open_ = True
        if part:
            yield part
        data = d.unconsumed_tail
        if d.eof:
            data, d, open_ = d.unused_data, zlib.decompressobj(31), False
        elif not data and len(part) == READ:  # more may wait inside
            while part := d.decompress(b"", READ):
                yield part
            if d.eof:
                data, d, open_ = d.unused_data, zlib.decompressobj(31), False
    if open_:
        raise ValueError("a gzip stream breaks off")


def records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, whole record) in turn; one record and a part are held at a time."""
    have = bytearray()

    def more(n: int) -> bool:
        while len(have) < n:
            part = next(parts, None)
            if part is None:
                return False
            have.extend(part)
        return True

    while more(1):
        while (end := have.find(b"\r\n\r\n")) < 0:
            if not more(len(have) + 1):
                raise ValueError("a WARC header breaks off")
        head = fields(bytes(have[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        if not more(size):
            raise ValueError("a WARC record breaks off")
        yield head, bytes(have[:size])
        del have[:size]


def write_monolithic(rows: DataFrame, folder: str) -> DataFrame:
    """Writes (page_id, url, html, refers_to, revisit) below ``folder``; returns (path, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, out, n, deflate = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0, zlib.compressobj(6, zlib.DEFLATED, 31)
        for batch in batches:
            out = out or _opened(path, True)
            page, url, refers, revisit = (batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit"))
            for i, html in enumerate(batch.column("html").cast(pa.binary()).to_pylist()):
                out.write(deflate.compress(record(page[i], url[i], html or b"", refers[i], revisit[i])))
                n += 1
        if out:
            out.write(deflate.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n])], names=["path", "records"])

    return written(in_arrow(rows.select("page_id", "url", "html", "refers_to", "revisit"), run, "path string, records long"), "archives")[0]


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each file of (path) with a member per record and a sidecar; returns (path, index, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("path").to_pylist():
                to, at, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                with _opened(source) as file, _opened(to, True) as out, _opened(f"{to}.idx", True) as index:
                    for head, whole in records(inflated(file)):
                        member = gzip.compress(whole, 6, mtime=0)
                        out.write(member)
                        index.write(json.dumps({"offset": at, "length": len(member), "type": head["warc-type"], "uri": head.get("warc-target-uri", ""), "id": head["warc-record-id"]}).encode() + b"\n")
                        at, n = at + len(member), n + 1
                yield pa.RecordBatch.from_arrays([pa.array([to]), pa.array([f"{to}.idx"]), pa.array([n])], names=["path", "index", "records"])

    spread = files.select("path").repartition(partitions(files.sparkSession), "path")
    return written(in_arrow(spread, run, "path string, index string, records long"), "normal")[0]


def read_indexed(files: DataFrame) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes, payload) of each record, by the sidecars.

    The digest of a response is computed anew from its payload and must agree with its header.
    """

    def page(urn: str | None) -> int | None:
        return int(n) if urn and (n := urn[len("<urn:page:") : -1]) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist()):
                rows: list[tuple] = []
                with _opened(path) as file, _opened(index) as lines:
                    for line in _lines(lines):
                        place = json.loads(line)
                        whole = gzip.decompress(file.read_at(place["length"], place["offset"]))
                        head, _, rest = whole.partition(b"\r\n\r\n")
                        f = fields(head)
                        http, _, payload = rest[: int(f["content-length"])].partition(b"\r\n\r\n")
                        size, said = int(fields(http)["content-length"]), f["warc-payload-digest"].removeprefix("sha1:")
                        if f["warc-type"] == "response" and (len(payload) != size or digest(payload) != said):
                            raise ValueError(f"record {place['id']} of {path} is damaged")
                        rows.append((page(f["warc-record-id"]), f["warc-type"], page(f.get("warc-refers-to")), said, size, payload if f["warc-type"] == "response" else None))
                        if len(rows) == 100:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    spread = files.select("path", "index").repartition(partitions(files.sparkSession), "path")
    return in_arrow(spread, run, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


def _lines(file) -> Iterator[bytes]:
    rest = b""
    while part := file.read(READ):
        *whole, rest = (rest + part).split(b"\n")
        yield from whole


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])


def with_revisits(pages: DataFrame) -> DataFrame:
    """Adds refers_to and revisit. Only digests that several rows share are joined back, so html isn't shuffled while they are few."""
    pages = pages.withColumn("_sha", F.sha1(F.coalesce("html", F.lit("")))).withColumn("_len", F.octet_length(F.coalesce("html", F.lit(""))))
    shared, _ = written(pages.groupBy("_sha", "_len").agg(F.max("page_id").alias("_max"), F.count("*").alias("_n")).where("_n > 1 AND _max IS NOT NULL").drop("_n"), "shared")
    few = shared.count() <= MOST_BROADCAST
    pages = pages.join(F.broadcast(shared) if few else shared, ["_sha", "_len"], "left")
    revisit = F.col("_max").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_max"))
    return pages.withColumn("revisit", revisit).withColumn("refers_to", F.when(revisit, F.col("_max"))).drop("_sha", "_len", "_max")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = with_revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    files = normalise(write_monolithic(pages, fresh_path(spark, "warc")), fresh_path(spark, "warc"))
    return read_indexed(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex, best FROM p)
SELECT page_id, payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
        ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> best THEN best END AS refers_to FROM d
"""
