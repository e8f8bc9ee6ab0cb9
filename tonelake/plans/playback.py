"""The playback pipeline as one plan: resample, raw hook, meters, spectrum, equaliser, mono, gain, output hook."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions import signal
from tonelake.operators import equalizer, meters, resample, spectrum
from tonelake.plans.settings import EVENTS, Settings

Hook = Callable[[DataFrame], DataFrame]

EVENT = "stream_id string, seq bigint, e int, s string, msg string, arg1 int, arg2 int, i2s_num int, vec1 array<bigint>, vec2 array<bigint>"


@dataclass
class Played:
    """What playing gives: samples, and the side outputs that were asked for."""

    samples: DataFrame
    vu: DataFrame | None = None
    bands: DataFrame | None = None


def play(pcm: DataFrame, rate: int, s: Settings = Settings(), raw_hook: Hook | None = None, output_hook: Hook | None = None, curve=None) -> Played:
    """Stages that settings turn off leave no trace in the plan.

    A hook takes and returns samples; the output hook may add a boolean column ``keep``, false where it vetoes a frame.
    """
    s = s.checked()
    if s.output_rate and s.output_rate != rate:
        pcm = resample.linear(pcm, rate, s.output_rate)
        rate = s.output_rate
    if raw_hook:
        pcm = raw_hook(pcm)
    vu = meters.vu_windows(pcm, s.window) if s.vu_level else None
    bands = spectrum.band_levels(pcm) if s.spectrum else None
    if s.equalizer and any(s.tone_db):
        pcm = equalizer.equalized(pcm, rate, s)
    if s.force_mono:
        m = signal.mono(F.col("left"), F.col("right"))
        pcm = pcm.withColumns({"left": m, "right": m})
    if s.volume_control:
        left, right = signal.volume_limits(F.lit(0.0 if s.mute else float(s.volume)), s.volume_steps, F.lit(s.balance), curve)
        pcm = pcm.withColumns({"left": signal.gain(F.col("left"), left), "right": signal.gain(F.col("right"), right)})
    if output_hook:
        pcm = output_hook(pcm)
        if "keep" in pcm.columns:
            pcm = pcm.where(F.coalesce("keep", F.lit(True))).drop("keep")
    return Played(pcm, vu, bands)


def events(rows: DataFrame, kind: str, seq: str, msg=None, vec1=None, vec2=None) -> DataFrame:
    """Rows of one kind as events."""
    number = {s: e for e, s in EVENTS}[kind]
    none = F.lit(None)
    return rows.select(
        "stream_id", F.col(seq).cast("bigint").alias("seq"), F.lit(number).alias("e"), F.lit(kind).alias("s"), (none if msg is None else msg).cast("string").alias("msg"), none.cast("int").alias("arg1"), none.cast("int").alias("arg2"),
        F.lit(0).alias("i2s_num"), (none if vec1 is None else vec1).cast("array<bigint>").alias("vec1"), (none if vec2 is None else vec2).cast("array<bigint>").alias("vec2"),
    )


def vu_events(windows: DataFrame) -> DataFrame:
    """Meter windows as events: means and peaks of both sides."""
    return events(windows, "VU", "window_no", vec1=F.array("left_mean", "right_mean"), vec2=F.array("left_max", "right_max"))


def picture_events(pictures: DataFrame) -> DataFrame:
    """Byte ranges of pictures as events, all of a stream in one."""
    one = pictures.groupBy("stream_id").agg(F.flatten(F.array_sort(F.collect_list(F.array("pos", "len")))).alias("v"), F.lit(0).alias("seq"))
    return events(one, "cover_image", "seq", vec1=F.col("v"))
