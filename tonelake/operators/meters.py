"""Level meters: count windows, attack-hold-release envelopes, delays and fade-out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.functions import signal
from tonelake.operators.scan import scanned
from tonelake.plans.settings import Envelope, Settings

#: Windows of a stream that a task goes through at a time.
CHUNK = 1 << 12


def vu_windows(pcm: DataFrame, frames: int | None = None) -> DataFrame:
    """(stream_id, window_no, left_mean, right_mean, left_max, right_max) of whole windows; a partial tail gives none.

    One shuffle by stream and window; partial aggregation shrinks it to a row per window and task.
    """
    n = frames or Settings().window
    level = {"left": signal.vu(F.col("left")), "right": signal.vu(F.col("right"))}
    windows = pcm.groupBy("stream_id", F.expr(f"frame_no div {n}").alias("window_no")).agg(
        F.count("*").alias("n"), *[F.sum(level[c]).alias(f"{c}_sum") for c in level], *[F.max(level[c]).alias(f"{c}_max") for c in level]
    )
    means = [F.expr(f"{c}_sum div n").cast("int").alias(f"{c}_mean") for c in level]
    return windows.where(F.col("n") == n).select("stream_id", "window_no", *means, "left_max", "right_max")


def envelope(values: Column, e: Envelope, cap: int | None = None) -> Column:
    """Display values for a short ordered array of measured ones, as an expression; ``enveloped`` serves long streams.

    A louder value starts the hold and raises the display by ``attack`` up to ``cap`` (or the value itself without
    one); otherwise the hold runs down and then the display falls by ``release`` at most.
    """
    start = F.struct(F.lit(0).alias("display"), F.lit(0).alias("hold"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        up = x > a["display"]
        ceiling = F.lit(cap) if cap is not None else x
        down = a["display"] - F.when(a["hold"] == 0, F.least(a["display"] - x, F.lit(e.release))).otherwise(0)
        display = F.when(up, F.least(a["display"] + e.attack, ceiling)).otherwise(down).cast("int")
        hold = F.when(up, F.lit(e.hold)).when(a["hold"] > 0, a["hold"] - 1).otherwise(0).cast("int")
        return F.struct(display.alias("display"), hold.alias("hold"), F.concat(a["out"], F.array(display)).alias("out"))

    return F.aggregate(values, start, step, lambda a: a["out"])


def _step(x: int, display: int, hold: int, e: Envelope, cap: int | None) -> tuple[int, int]:
    if x > display:
        return min(display + e.attack, x if cap is None else cap), e.hold
    if hold == 0:
        return display - min(display - x, e.release), 0
    return display, hold - 1


def _all_states(values: list[int], e: Envelope, cap: int | None, most: int) -> np.ndarray:
    """Where the values lead from each display 0 to ``most`` and hold 0 to ``e.hold``: rows of display and hold.

    States soon coincide; from when few are left each goes its own way.
    """
    display, hold = (m.ravel() for m in np.meshgrid(np.arange(most + 1), np.arange(e.hold + 1), indexing="ij"))
    of = np.arange(len(display))
    for i in range(0, len(values), 16):
        if len(display) <= 8:
            ends = []
            for d, h in zip(display.tolist(), hold.tolist()):
                for x in values[i:]:
                    d, h = _step(x, d, h, e, cap)
                ends.append((d, h))
            return np.array(ends, np.int32)[of]
        for x in values[i : i + 16]:
            up, raised = x > display, np.minimum(display + e.attack, x if cap is None else cap)
            fallen = display - np.where(hold == 0, np.minimum(display - x, e.release), 0)
            display, hold = np.where(up, raised, fallen), np.where(up, e.hold, np.maximum(hold - 1, 0))
        both, at = np.unique(display * (e.hold + 1) + hold, return_inverse=True)
        display, hold, of = both // (e.hold + 1), both % (e.hold + 1), at[of]
    return np.stack([display, hold], axis=1).astype(np.int32)[of]


def enveloped(
    windows: DataFrame, value: str, e: Envelope, cap: int | None = None, keys: tuple[str, ...] = ("stream_id",), order: str = "window_no", out: str = "display", most: int = 255, chunk: int = CHUNK,
) -> DataFrame:
    """(keys, order, value, out): the envelope over each stream's windows in order.

    Values, and ``cap``, lie within 0 to ``most``; others raise. A chunk of windows (never samples) maps every display and
    hold before it to those after it, a table of (most + 1) * (e.hold + 1) states; tables are composed along the stream and
    the chunks of one stream run in as many tasks as there are: see ``scan``.
    """

    def held(table: pa.Table) -> list[int]:
        values = table.column(value).to_pylist()
        if values and not 0 <= min(values) <= max(values) <= most or (cap or 0) > most:
            raise ValueError(f"levels must lie within 0 to {most}")
        return values

    def advance(state: bytes | None, summary: bytes) -> bytes:
        display, hold = np.frombuffer(state, np.int32).tolist() if state else (0, 0)
        return np.frombuffer(summary, np.int32).reshape(-1, 2)[display * (e.hold + 1) + hold].tobytes()

    def run(table: pa.Table, start: bytes | None) -> list[pa.Array]:
        display, hold = np.frombuffer(start, np.int32).tolist() if start else (0, 0)
        shown = []
        for x in held(table):
            display, hold = _step(x, display, hold, e, cap)
            shown.append(display)
        return [pa.array(shown, pa.int32())]

    rows = windows.select(*keys, order, F.col(value).cast("int").alias(value))
    return scanned(rows, keys, order, chunk, lambda table: _all_states(held(table), e, cap, most).tobytes(), advance, run, T.StructType([T.StructField(out, T.IntegerType())]))


def with_fade_out(windows: DataFrame, value: str, e: Envelope, order: str = "window_no", keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    """Appends as many silent windows per stream as any display needs to fall to zero, the delay included."""
    extra = 255 // e.release + e.hold + 4
    last = windows.groupBy(*keys).agg(F.max(order).alias("_last"))
    silent = last.select(*keys, F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + extra)).alias(order), F.lit(0).alias(value))
    return windows.select(*keys, order, value).unionByName(silent)


def delayed(rows: DataFrame, value: str, by: int = 2, keys: tuple[str, ...] = ("stream_id",), order: str = "window_no", out: str = "delayed") -> DataFrame:
    """Adds the value of ``by`` windows before, 0 where there is none."""
    return rows.withColumn(out, F.lag(value, by, 0).over(Window.partitionBy(*keys).orderBy(order)))
