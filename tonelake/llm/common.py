"""What several operators share: the shared folder, written tables, words, and order over many partitions."""

from __future__ import annotations

import contextlib
import gc
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tonelake.session import fresh_path, in_arrow, shared_dir  # noqa: F401

#: What separates words: space and the ASCII controls tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """What is written inside hands its texts to Python in batches of about ``most`` bytes; then the session is as it was.

    Spark's default, 64 MB, lies in an executor twice for each task: in the worker, and as a buffer that grows by doubling.
    A session that has a setting of its own keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key in spark.conf.getAll:
        yield
        return
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.unset(key)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, read again: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def counted(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, str, dict]:
    """As ``written``, with the number of rows ``n`` and other aggregates, taken down while writing."""
    seen = Observation()
    table, path = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in sums.items()]), name)
    return table, path, seen.get


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that nothing reads any more."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished rounds: it does once the driver collects what referred to them."""
    gc.collect()
    spark._jvm.System.gc()


def shrink(spark: SparkSession) -> None:
    """Executors collect their garbage at once, so that heap which earlier steps filled returns to the system before Python
    workers need it. Spark deals the tasks, so an executor that is busy may get none; no result depends on it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def chars(text: Column | str) -> Column:
    """Code points of a text; null counts as empty."""
    return F.char_length(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, lengthened where a column already has one; Spark's names ignore case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out
