"""What a session needs before Python tasks run, and the folder that all its executors share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, unless it is installed for them."""
    env, home = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), home]))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Where it is unset, a local session (tests) gets a temporary folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"file://{tempfile.mkdtemp(prefix='tonelake-')}"
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes of a batch that a function gets at a time, one row at least.
BATCH_ROWS, BATCH_BYTES = 128, 16 << 20


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows and bytes, since texts can be very long."""
    for batch in batches:
        size = batch.nbytes / max(1, len(batch))
        step = max(1, min(BATCH_ROWS, int(BATCH_BYTES / max(1.0, size))))
        for i in range(0, len(batch), step):
            yield batch.slice(i, step)


def _give_back() -> None:
    """Returns what a task freed to the system: workers are reused, and would hold their largest task's memory for the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def in_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow whose function gets small slices; Spark bounds the batches themselves by rows and bytes."""
    ready(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(sliced(batches))
        finally:
            _give_back()

    return df.mapInArrow(run, schema)
