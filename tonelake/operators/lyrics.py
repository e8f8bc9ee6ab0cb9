"""Time-aligned lyrics: as-of matching of lines and decoded blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def due(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(stream_id, line_no, ts_ms, text, block_no): the first block whose time is strictly past the line's.

    ``lines`` has (stream_id, line_no, ts_ms, text), ``blocks`` (stream_id, block_no, time_ms), times rising with
    block_no. A union sorted by time, read backwards, stands for the missing as-of join.
    """
    t = "bigint"
    a = lines.select("stream_id", F.col("ts_ms").cast(t).alias("at"), F.lit(1).alias("kind"), "line_no", "ts_ms", "text", F.lit(None).cast(t).alias("block_no"))
    b = blocks.select("stream_id", F.col("time_ms").cast(t).alias("at"), F.lit(0).alias("kind"), *[F.lit(None).cast(c).alias(n) for n, c in lines.select("line_no", "ts_ms", "text").dtypes], F.col("block_no").cast(t).alias("block_no"))
    # backwards, so that the running value is carried along instead of looked up from every row
    back = Window.partitionBy("stream_id").orderBy(F.desc("at"), F.desc("kind"), F.desc("block_no")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return a.unionByName(b).withColumn("block_no", F.last("block_no", ignorenulls=True).over(back)).where("kind = 1").select("stream_id", "line_no", "ts_ms", "text", "block_no")


def shown(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """As ``due``, but a block shows one line at most: later lines wait for the next block.

    Lines' places are folded in order: each takes the larger of its due block and the one after its predecessor's.
    Blocks must be numbered without gaps within a stream.
    """
    rank = Window.partitionBy("stream_id").orderBy("line_no")
    ahead = due(lines, blocks).withColumn("_k", F.row_number().over(rank))
    last = blocks.groupBy("stream_id").agg(F.max("block_no").alias("_last"))
    # max over predecessors of (due - rank), plus own rank: the closed form of the fold
    place = F.max(F.col("block_no") - F.col("_k")).over(rank.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_k")
    out = ahead.where("block_no IS NOT NULL").withColumn("block_no", place).join(last, "stream_id")
    return out.where("block_no <= _last").drop("_k", "_last")


def resumed(lines: DataFrame, seeks: DataFrame) -> DataFrame:
    """(stream_id, seek_ms, line_no): after a seek, the last line at or before the time, else the first line."""
    order = Window.partitionBy("stream_id").orderBy("at", "kind", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    a = lines.select("stream_id", F.col("ts_ms").alias("at"), F.lit(0).alias("kind"), "line_no", F.lit(None).cast("bigint").alias("seek_ms"))
    b = seeks.select("stream_id", F.col("seek_ms").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("line_no"), "seek_ms")
    return a.unionByName(b).withColumn("line_no", F.coalesce(F.last("line_no", ignorenulls=True).over(order), F.lit(0))).where("kind = 1").select("stream_id", "seek_ms", "line_no")
