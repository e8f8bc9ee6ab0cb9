"""Sample-rate conversion by output index: every output frame finds its inputs by arithmetic, so nothing runs in turn."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonelake.operators.recurrence import per_stream

_Q = 1 << 32
#: Frames of a stream that one task handles together.
CHUNK = 1 << 16


def _indexed(pcm: DataFrame, step: int, taps: range, point: Callable[[list[Column], Column], Column]) -> DataFrame:
    """For each input frame i, the outputs k whose position k * step lies in [i, i + 1), in 32-bit fixed point.

    Neighbours come from lead and lag over chunks of a stream, each with the few frames beyond its ends that it needs,
    so that a long stream spreads over tasks; the outputs of a frame are a short sequence. One shuffle, no join.
    Frames must be numbered without gaps.
    """
    ends = [F.expr(f"(frame_no - {t}) div {CHUNK}") for t in (taps[0], taps[-1])]
    pcm = pcm.withColumn("_chunk", F.explode(F.array_distinct(F.array(*ends))))
    order = Window.partitionBy("stream_id", "_chunk").orderBy("frame_no")
    near = {(c, t): F.lead(c, t).over(order) if t > 0 else F.lag(c, -t).over(order) if t < 0 else F.col(c) for c in ("left", "right") for t in taps}
    at = pcm.select("stream_id", "frame_no", "_chunk", *[v.cast("bigint").alias(f"{c}_{t + 9}") for (c, t), v in near.items()])
    at = at.where(" AND ".join(f"{c}_{t + 9} IS NOT NULL" for c, t in near)).where(F.expr(f"frame_no div {CHUNK}") == F.col("_chunk"))
    first = F.expr(f"(frame_no * {_Q} + {step - 1}) div {step}")
    after = F.expr(f"((frame_no + 1) * {_Q} + {step - 1}) div {step}")
    ks = at.withColumn("_a", first).withColumn("_b", after).where("_b > _a").withColumn("k", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)))
    frac = F.col("k") * step - F.col("frame_no") * _Q
    return ks.select("stream_id", F.col("k").alias("frame_no"), *[point([F.col(f"{c}_{t + 9}") for t in taps], frac).cast("int").alias(c) for c in ("left", "right")])


def step_of(rate: int, to: int) -> int:
    """Input frames per output frame in 32-bit fixed point."""
    return (rate << 32) // to


def linear(pcm: DataFrame, rate: int, to: int) -> DataFrame:
    """Linear interpolation; the product with the 32-bit fraction is formed in two halves, so it stays within 64 bits."""

    def point(x: list[Column], f: Column) -> Column:
        d, high, low = x[1] - x[0], F.shiftright(f, 16), f.bitwiseAND(F.lit(0xFFFF).cast("bigint"))
        return x[0] + F.shiftright(d * high + F.shiftright(d * low, 16), 16)

    return _indexed(pcm, step_of(rate, to), range(0, 2), point)


def catmull_rom(pcm: DataFrame, rate: int, to: int = 44_100) -> DataFrame:
    """Cubic interpolation over four neighbours of 16-bit samples, clipped to 16 bits."""

    def point(x: list[Column], f: Column) -> Column:
        t = f / float(_Q)
        y = 0.5 * (2 * x[1] + (x[2] - x[0]) * t + (2 * x[0] - 5 * x[1] + 4 * x[2] - x[3]) * t * t + (3 * x[1] - x[0] - 3 * x[2] + x[3]) * t * t * t)
        return F.greatest(F.least(y, F.lit(32767.0)), F.lit(-32768.0))

    return _indexed(pcm, step_of(rate, to), range(-1, 3), point)


def low_pass(rate: int) -> tuple[float, float, float, float, float]:
    """b0, b1, b2, a1, a2 of a second-order Butterworth low-pass at 0.45 of the rate, 3 to 20 kHz."""
    w = 2 * np.pi * min(max(0.45 * rate, 3000.0), 20_000.0) / rate
    alpha = np.sin(w) / np.sqrt(2)
    b, a0 = (1 - np.cos(w)) / 2, 1 + alpha
    return b / a0, 2 * b / a0, b / a0, -2 * np.cos(w) / a0, (1 - alpha) / a0


def smoothed(pcm: DataFrame, rate: int) -> DataFrame:
    """The low-pass after interpolation, designed at the source rate, in double precision."""
    return per_stream(pcm, [low_pass(rate)], 1.0)
