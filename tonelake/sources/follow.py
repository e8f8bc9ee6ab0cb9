"""Following streams that stall: what a request brought decides the next one, from the byte after the last that came.

A table of requests (url, offset, attempt) is read as a stream of files; tasks ask the servers, each for one piece, and take what
comes until the piece is full, the body ends, the connection breaks or the server has been quiet for ``idle`` seconds. The
result is written, and from it each stream's next request: bytes reset its attempts, a request without any counts one,
and after ``attempts`` of them in a row the stream is given up. A stream's state is thus its latest request, a row; a
restart goes on from the requests that were not answered, and a batch that is run again overwrites its own files.
"""

from __future__ import annotations

import socket
from collections.abc import Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tonelake.session import ready

REQUEST = "url string, offset long, attempt int"
PIECE = "url string, offset long, data binary, attempt int, said string"
READ = 1 << 14


def pull(url: str, offset: int, piece: int, idle: float) -> tuple[bytes, str]:
    """Bytes from an offset on, and how it ended: ``more`` (the piece is full), ``ended``, ``lost`` or ``quiet``."""
    data = b""
    try:
        with urlopen(Request(url, headers={"Range": f"bytes={offset}-", "Icy-MetaData": "1"}), timeout=idle) as r:  # noqa: S310
            said = r.headers.get("Content-Length")
            end = None if said is None else int(said) + (0 if r.status == 200 else offset)
            if r.status == 200 and end is not None:  # the whole, ranges aren't known here; an endless stream has no places
                r.read(offset)
            while len(data) < piece:
                more = r.read1(min(READ, piece - len(data)))
                if not more:
                    return data, "ended" if end is None or offset + len(data) >= end else "lost"
                data += more
        return data, "ended" if end is not None and offset + len(data) >= end else "more"
    except HTTPError as e:
        return data, "ended" if e.code == 416 else "lost"
    except (TimeoutError, socket.timeout):
        return data, "quiet"
    except OSError as e:
        return data, "quiet" if "timed out" in str(e) else "lost"


def follow(spark: SparkSession, urls: list[str], folder: str, idle: float = 2.0, attempts: int = 5, piece: int = 1 << 20) -> StreamingQuery:
    """Starts following ``urls`` in a folder that all executors share, or goes on with what is there; returns the query."""
    ready(spark)
    begun = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/requests/first")
    if not begun.getFileSystem(spark._jsc.hadoopConfiguration()).exists(begun):
        spark.createDataFrame([(u, 0, 0) for u in urls], REQUEST).write.parquet(f"{folder}/requests/first")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for url, offset, attempt in zip(*(batch.column(c).to_pylist() for c in ("url", "offset", "attempt"))):
                data, said = pull(url, offset, piece, idle)
                yield pa.RecordBatch.from_arrays([pa.array([url]), pa.array([offset]), pa.array([data], pa.binary()), pa.array([attempt], pa.int32()), pa.array([said])], ["url", "offset", "data", "attempt", "said"])

    def step(batch: DataFrame, n: int) -> None:
        own = batch.sparkSession
        batch.repartition("url").mapInArrow(ask, PIECE).write.mode("overwrite").parquet(f"{folder}/pieces/batch={n}")
        answered = own.read.schema(PIECE).parquet(f"{folder}/pieces/batch={n}").where("said != 'ended'")
        came = F.octet_length("data")
        following = answered.select("url", (F.col("offset") + came).alias("offset"), F.when(came > 0, 0).otherwise(F.col("attempt") + 1).cast("int").alias("attempt")).where(F.col("attempt") < attempts)
        if following.limit(1).count():
            following.write.mode("overwrite").parquet(f"{folder}/requests/after-{n}")

    requests = spark.readStream.schema(REQUEST).option("recursiveFileLookup", "true").parquet(f"{folder}/requests")
    return requests.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state").start()


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """(url, offset, data) of what has come so far."""
    return spark.read.schema(PIECE).parquet(f"{folder}/pieces").where(F.octet_length("data") > 0).select("url", "offset", "data")


def events(spark: SparkSession, folder: str, attempts: int = 5) -> DataFrame:
    """(url, offset, event, attempt): 'slow stream' and 'connection lost' where a request ended so, 'given up' at the last."""
    rows = spark.read.schema(PIECE).parquet(f"{folder}/pieces").where("said IN ('quiet', 'lost')")
    last = (F.octet_length("data") == 0) & (F.col("attempt") + 1 >= attempts)
    event = F.when(last, "given up").when(F.col("said") == "quiet", "slow stream").otherwise("connection lost")
    return rows.select("url", (F.col("offset") + F.octet_length("data")).alias("offset"), event.alias("event"), "attempt")
