"""How the test tables, which hold no audio, stand in for signals: an adaptation by convention.

One stream: an event's value is a sample, even and odd event_ids are left and right of a frame. Many streams: each user is
one, both channels equal. Signal frames: an embedding is one frame of 64 samples. Blocks: an event is a decoded block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample(value: str = "value") -> Column:
    s = F.round(F.col(value) * 100).cast("bigint") - 24501
    return (F.greatest(F.least(s, F.lit(32767)), F.lit(-32768)) * 65536).cast("int")


SAMPLE_SQL = "(greatest(least(round(value * 100)::BIGINT - 24501, 32767), -32768) * 65536)::INTEGER"


def one_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, frame_no, left, right) of all events."""
    e = table(spark, sf_dir, "events").select("event_id", sample().alias("s"))
    side = F.col("event_id") % 2
    frames = e.groupBy(F.expr("event_id div 2").alias("frame_no")).agg(F.max(F.when(side == 0, F.col("s"))).alias("left"), F.max(F.when(side == 1, F.col("s"))).alias("right"))
    return frames.where("left IS NOT NULL AND right IS NOT NULL").select(F.lit("events").alias("stream_id"), "frame_no", "left", "right")


ONE_SQL = f"""pcm AS (SELECT 'events' AS stream_id, event_id // 2 AS frame_no, max(CASE WHEN event_id % 2 = 0 THEN {SAMPLE_SQL} END) AS l,
    max(CASE WHEN event_id % 2 = 1 THEN {SAMPLE_SQL} END) AS r FROM events GROUP BY event_id // 2 HAVING l IS NOT NULL AND r IS NOT NULL)"""


def many_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, frame_no, left, right): a stream per user."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint") - 1
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), rank.alias("frame_no"), sample().alias("left"))
    return e.withColumn("right", F.col("left"))


MANY_SQL = f"""pcm AS (SELECT user_id::VARCHAR AS stream_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_no,
    {SAMPLE_SQL} AS l, {SAMPLE_SQL} AS r FROM events)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, block_no, bytes_in, samples_out) of decoded blocks."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("block_no"), (1 + F.col("event_id") % 997).cast("int").alias("bytes_in"), F.lit(1152).alias("samples_out"))


BLOCKS_SQL = "blocks AS (SELECT user_id::VARCHAR AS stream_id, event_id AS block_no, (1 + event_id % 997)::INTEGER AS bytes_in, 1152 AS samples_out FROM events)"
