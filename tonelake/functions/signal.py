"""Sample-level scalars over left-justified 32-bit PCM columns. All are native expressions that fuse in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MAX, INT_MIN = 2**31 - 1, -(2**31)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def gain(sample: Column, factor: Column | float) -> Column:
    """A sample times a factor, truncated toward zero and held within 32 bits."""
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return clamp(sample * factor, float(INT_MIN), float(INT_MAX)).cast("bigint").cast("int")


def volume_db(volume: Column, steps: Column | int) -> Column:
    """The default volume curve in dB: a cubic of volume / steps, between -60 and 0."""
    t = clamp(volume.cast("double") / steps, 0.0, 1.0)
    return clamp(-112.0 * t * t * t + 172.0 * t * t - 60.0, -60.0, 0.0)


def linear(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20.0)


def volume_limits(volume: Column, steps: Column | int, balance: Column, curve=None) -> tuple[Column, Column]:
    """Left and right factors: silence at volume 0; balance (-16..16) takes up to 16 dB from the other side.

    ``curve`` maps the share of full volume to dB in place of the default.
    """
    db = volume_db(volume, steps) if curve is None else clamp(curve(clamp(volume.cast("double") / steps, 0.0, 1.0)), -60.0, 0.0)
    level = F.when(volume <= 0, 0.0).otherwise(linear(db))
    left = level * linear(F.when(balance > 0, balance.cast("double") * -1.0).otherwise(0.0))
    return left, level * linear(F.when(balance < 0, balance.cast("double")).otherwise(0.0))


def ramped(start: Column, target: Column, tick: Column, steps: int = 21, speed: float = 50.0) -> Column:
    """Volume after ``tick`` equal steps from start toward a constant target."""
    step = steps / min(max(speed, 1.0), 100.0)
    diff = target - start
    return start + F.signum(diff) * F.least(tick * F.lit(step), F.abs(diff))


def mono(left: Column, right: Column) -> Column:
    """The mean of both channels, rounded down."""
    return F.shiftright(left.cast("bigint") + right.cast("bigint"), 1).cast("int")


def vu(sample: Column) -> Column:
    """Level 0..255 of the magnitude's top bits."""
    return F.least(F.shiftright(F.abs(sample.cast("bigint")), 23), F.lit(255)).cast("int")


def vu_curve(level: Column) -> Column:
    """Square-root display curve over 0..255."""
    return F.round(255.0 * F.sqrt(level / 255.0)).cast("int")


def spectrum_mix(left: Column, right: Column) -> Column:
    """Both channels in one 16-bit sample, for spectra."""
    return F.shiftright(left, 17) + F.shiftright(right, 17)


def narrow16(sample: Column) -> Column:
    """The top 16 bits."""
    return clamp(F.shiftright(sample, 16), -32768, 32767).cast("int")


def widen(value: Column, bits: int) -> Column:
    """A raw PCM value of 8 (unsigned), 16, 24 or 32 bits, left-justified to 32."""
    shifted = (value.cast("bigint") - 128) * (1 << 24) if bits == 8 else value.cast("bigint") * (1 << (32 - bits))
    return shifted.cast("int")


def biquad_db(omega: Column, sections: list[tuple[list[float], list[float]]]) -> Column:
    """Magnitude in dB of a biquad cascade at angular frequency omega."""
    c1, s1, c2, s2 = F.cos(omega), F.sin(omega), F.cos(2 * omega), F.sin(2 * omega)

    def power(c: list[float]) -> Column:
        re, im = c[0] + c[1] * c1 + c[2] * c2, c[1] * s1 + c[2] * s2
        return re * re + im * im

    total = F.lit(0.0)
    for b, a in sections:
        total = total + 10.0 * F.log10(power(b) / power(a))
    return total
