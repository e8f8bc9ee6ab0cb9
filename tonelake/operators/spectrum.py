"""Spectra: overlapped frames, Fourier power and band levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import signal
from tonelake.session import ready

SIZE, HOP = 512, 256
DB_MIN, DB_MAX = 90.0, 120.0

# First bin, last bin and weight of the sixteen bands of a 512-point spectrum.
BANDS = [
    (1, 1, 0.10), (3, 3, 0.20), (5, 7, 0.30), (8, 11, 0.40), (12, 16, 0.50), (17, 23, 0.70), (24, 32, 1.0), (33, 44, 1.0),
    (45, 60, 1.0), (61, 80, 1.0), (81, 104, 1.1), (105, 132, 1.2), (133, 164, 1.3), (165, 200, 1.4), (201, 228, 1.5), (229, 255, 1.6),
]


def bands(spark: SparkSession, of: list[tuple[int, int, float]] = BANDS) -> DataFrame:
    """(band, first_bin, last_bin, weight); a weight is shared out over the band's bins."""
    return spark.createDataFrame([(i, a, b, w / (b - a + 1)) for i, (a, b, w) in enumerate(of)], "band int, first_bin int, last_bin int, weight double")


def frames(pcm: DataFrame, size: int = SIZE, hop: int = HOP) -> DataFrame:
    """(stream_id, fft_no, pos, x): every sample in each frame that covers it, Hann-weighted.

    A sample belongs to size / hop frames; whole frames are kept by ``whole`` further on.
    """
    back = F.sequence(F.lit(0), F.lit(size // hop - 1))
    mix = pcm.select("stream_id", "frame_no", signal.spectrum_mix(F.col("left"), F.col("right")).alias("x"))
    spread = mix.withColumn("fft_no", F.explode(F.transform(back, lambda k: F.expr(f"frame_no div {hop}") - k))).where("fft_no >= 0")
    pos = (F.col("frame_no") - F.col("fft_no") * hop).cast("int")
    hann = 0.5 * (1 - F.cos(2 * np.pi * F.col("pos") / (size - 1)))
    return spread.withColumn("pos", pos).withColumn("hann", hann).select("stream_id", "fft_no", "pos", "x", "hann")


def power_by_join(signals: DataFrame, size: int) -> DataFrame:
    """(stream_id, fft_no, bin, power) of (stream_id, fft_no, pos, x) by joining the twiddle factors: for small sizes.

    The factor table has size * size / 2 rows whatever the data, and is broadcast.
    """
    if size > 128:
        raise ValueError("use band_levels for long frames")
    spark = signals.sparkSession
    turn = 2 * np.pi * F.col("pos") * F.col("bin") / size
    factors = spark.range(size).select(F.col("id").cast("int").alias("pos")).select("pos", F.explode(F.sequence(F.lit(0), F.lit(size // 2))).alias("bin")).select("pos", "bin", F.cos(turn).alias("c"), F.sin(turn).alias("s"))
    sums = signals.join(F.broadcast(factors), "pos").groupBy("stream_id", "fft_no", "bin").agg(F.sum(F.col("x") * F.col("c")).alias("re"), F.sum(F.col("x") * F.col("s")).alias("im"))
    return sums.select("stream_id", "fft_no", "bin", (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def band_energy(power: DataFrame, of: DataFrame) -> DataFrame:
    """(stream_id, fft_no, band, energy): weighted sums of power over the bins of each band (a broadcast interval join)."""
    hit = power.join(F.broadcast(of), F.col("bin").between(F.col("first_bin"), F.col("last_bin")))
    return hit.groupBy("stream_id", "fft_no", "band").agg((F.sum("power") * F.first("weight")).alias("energy"))


def level(energy) -> object:
    """Energy in dB, held to 90..120 and scaled to 0..255."""
    db = signal.clamp(10.0 * F.log10(energy + 1.0), DB_MIN, DB_MAX)
    return F.floor((db - DB_MIN) / (DB_MAX - DB_MIN) * 255.0 + 0.5).cast("int")


def band_levels(pcm: DataFrame, size: int = SIZE, hop: int = HOP, every: int = 2048, of: list[tuple[int, int, float]] = BANDS) -> DataFrame:
    """(stream_id, fft_no, band, level) of the frames that end each run of ``every`` samples.

    Samples are gathered in chunks of one frame, Fourier-transformed by numpy in Arrow batches, and banded there.
    """
    ready(pcm.sparkSession)
    keep = every // hop
    x = frames(pcm, size, hop).where((F.col("fft_no") + 1) % keep == 0)
    whole = x.groupBy("stream_id", "fft_no").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("s")).where(F.size("s") == size)
    rows = whole.select("stream_id", "fft_no", F.transform("s", lambda v: v["x"].cast("float")).alias("x"))
    window = 0.5 * (1 - np.cos(2 * np.pi * np.arange(size) / (size - 1)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for part in parts:
            if part.empty:
                continue
            power = np.abs(np.fft.rfft(np.stack(part["x"].to_numpy()) * window, axis=1)) ** 2
            for band, (a, b, w) in enumerate(of):
                energy = power[:, a : b + 1].sum(axis=1) * w / (b - a + 1)
                db = np.clip(10 * np.log10(energy + 1), DB_MIN, DB_MAX)
                shown = ((db - DB_MIN) / (DB_MAX - DB_MIN) * 255 + 0.5).astype(np.int32)
                yield pd.DataFrame({"stream_id": part["stream_id"], "fft_no": part["fft_no"], "band": np.int32(band), "level": shown})

    return rows.mapInPandas(run, "stream_id string, fft_no long, band int, level int")
