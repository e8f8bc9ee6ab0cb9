"""Running totals, bitrates, times and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Numbers of a stream that one task adds up.
CHUNK = 1 << 16


def running_sums(rows: DataFrame, sums: dict[str, str], order: str, key: str = "stream_id", chunk: int | None = None) -> DataFrame:
    """Adds for each (name: column) the sum up to and including the row, in ``order`` (a number) within ``key``.

    A stream is cut into chunks by that number. Chunks are summed, their sums added up (a row per chunk), and each chunk
    goes on from what came before it, so a long stream spreads over tasks. The rows are read twice, for the sums of chunks
    (which shrink before they are shuffled) and for themselves, and shuffled once.
    """
    rows = rows.withColumn("_chunk", F.expr(f"{order} div {chunk or CHUNK}"))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(key, "_chunk").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    base = whole.select(key, "_chunk", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    upto = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = rows.join(base, [key, "_chunk"])
    return joined.withColumns({n: F.sum(c).over(upto) + F.col(f"_{n}") for n, c in sums.items()}).drop("_chunk", *[f"_{n}" for n in sums])


def average_bitrate(blocks: DataFrame, rate: int) -> DataFrame:
    """Adds sum_bytes, sum_samples, average and bitrate to (stream_id, block_no, bytes_in, samples_out).

    ``average`` is bits per second so far; ``bitrate`` is 0 until it has moved by less than 100 for eleven blocks.
    The average one block ago follows from the sums without this block.
    """
    rows = running_sums(blocks, {"sum_bytes": "bytes_in", "sum_samples": "samples_out"}, "block_no")

    def average(size: str, samples: str) -> Column:
        return F.expr(f"CASE WHEN {samples} > 0 THEN {size} * 8 * {rate} div {samples} ELSE 0 END")

    rows = rows.withColumn("average", average("sum_bytes", "sum_samples"))
    moved_by = F.col("average") - average("(sum_bytes - bytes_in)", "(sum_samples - samples_out)")
    rows = running_sums(rows.withColumn("_still", (F.abs(moved_by) < 100).cast("int")), {"_calm": "_still"}, "block_no")
    return rows.withColumn("bitrate", F.when(F.col("_calm") > 10, F.col("average")).otherwise(0)).drop("_still", "_calm")


def audio_time(rated: DataFrame, rate: int, data_size: Column | int) -> DataFrame:
    """Adds seconds played, and the file's estimated duration and samples once there is a bitrate."""
    size = data_size if isinstance(data_size, Column) else F.lit(data_size)
    duration = F.when(F.col("bitrate") > 0, F.round(size * 8 / F.col("bitrate")).cast("bigint"))
    return rated.withColumn("seconds", F.expr(f"sum_samples div {rate}")).withColumn("duration", duration).withColumn("total_samples", F.col("duration") * rate)


def frame_averages(frames: DataFrame, rate: int) -> DataFrame:
    """(stream_id, frames, bytes, samples, bitrate): sums over scanned frames (stream_id, bytes_in, samples_out)."""
    sums = frames.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum("bytes_in").alias("bytes"), F.sum("samples_out").alias("samples"))
    return sums.withColumn("bitrate", F.expr(f"bytes * 8 * {rate} div samples"))


def sample_offset(sizes: DataFrame, target: str = "target") -> DataFrame:
    """(stream_id, sample_no, offset): the first cumulative offset at or past ``target``, from a table of sample sizes."""
    placed = running_sums(sizes, {"_end": "size"}, "sample_no").withColumn("offset", F.col("_end") - F.col("size")).where(F.col("offset") >= F.col(target))
    return placed.groupBy("stream_id").agg(F.min(F.struct("sample_no", "offset")).alias("m")).select("stream_id", "m.sample_no", "m.offset")


def samples_at(position: Column, start: Column, size: Column, total: Column) -> Column:
    """Samples played at a byte position, by proportion."""
    return F.floor(total * ((position - start) / size)).cast("bigint")


def position_at(seconds: Column, start: Column, bitrate: Column) -> Column:
    """The byte at which a time is."""
    return start + F.floor(bitrate * seconds / 8).cast("bigint")


def moved(position: Column, seconds: Column, bitrate: Column, start: Column, end: Column) -> Column:
    """A byte position moved by seconds, no lower than the data's start; null past its end, where playing stops."""
    to = F.greatest(position + F.floor(seconds * bitrate / 8).cast("bigint"), start)
    return F.when(to <= end, to)


def aligned(position: Column, start: int, block: int) -> Column:
    """A position within data, moved back to the start of its block, from the file's beginning."""
    return position - position % block + start


def next_frame(frames: DataFrame, targets: DataFrame) -> DataFrame:
    """(stream_id, target, offset): the first frame of (stream_id, offset) at or past each (stream_id, target).

    A union of both sorted by place and read backwards: no pairs are formed.
    """
    both = frames.select("stream_id", F.col("offset").alias("at"), F.col("offset"), F.lit(None).cast("bigint").alias("target")).unionByName(targets.select("stream_id", F.col("target").alias("at"), F.lit(None).cast("bigint").alias("offset"), "target"))
    back = Window.partitionBy("stream_id").orderBy(F.desc("at"), F.col("target").isNull().desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("offset", F.last("offset", ignorenulls=True).over(back)).where("target IS NOT NULL").select("stream_id", "target", "offset")


def stream_info(streams: DataFrame) -> DataFrame:
    """Reconciles what headers, page positions and averages say of each stream.

    Needs codec, sample_rate, channels, bits, data_size, last_granule, header_samples, nominal_bitrate, average_bitrate (null where unknown).
    """
    total = F.coalesce("last_granule", "header_samples")
    duration = F.coalesce(F.expr("try_divide(coalesce(last_granule, header_samples), sample_rate)"), F.expr("try_divide(data_size * 8, coalesce(nominal_bitrate, average_bitrate))"))
    df = streams.withColumn("duration", F.floor(duration).cast("bigint"))
    df = df.withColumn("bitrate", F.coalesce("nominal_bitrate", F.expr("CAST(floor(try_divide(data_size * 8, duration)) AS BIGINT)"), "average_bitrate"))
    return df.withColumn("total_samples", F.coalesce(total, F.col("duration") * F.col("sample_rate")))
