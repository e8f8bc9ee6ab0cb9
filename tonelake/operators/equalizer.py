"""Three-band equaliser: low shelf, peak and high shelf in cascade, with headroom taken first."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from tonelake.operators.recurrence import per_stream
from tonelake.plans.settings import Settings

# The sections of the documented example response, numerator and denominator.
EXAMPLE = [
    ([1.026721, -1.919612, 0.901093], [1.0, -1.922258, 0.925168]),
    ([0.802626, -1.424665, 0.670208], [1.0, -1.424665, 0.472834]),
    ([2.092489, -2.262849, 0.808592], [1.0, -0.597000, 0.235232]),
]


def peaking(freq: float, db: float, q: float) -> tuple:
    """The audio-EQ cookbook's peak; its gain is a whole number of dB, cut toward zero."""
    a, w = 10 ** (math.trunc(db) / 40), 2 * math.pi * freq
    alpha, c = math.sin(w) / (2 * q), math.cos(w)
    a0 = 1 + alpha / a
    return (1 + alpha * a) / a0, -2 * c / a0, (1 - alpha * a) / a0, -2 * c / a0, (1 - alpha / a) / a0


def shelf(freq: float, db: float, q: float, high: bool) -> tuple:
    """The audio-EQ cookbook's low or high shelf."""
    a, w = 10 ** (db / 40), 2 * math.pi * freq
    c, beta = math.cos(w) * (-1 if high else 1), 2 * math.sqrt(a) * math.sin(w) / (2 * q)
    flip = -1 if high else 1
    b = a * ((a + 1) - (a - 1) * c + beta), flip * 2 * a * ((a - 1) - (a + 1) * c), a * ((a + 1) - (a - 1) * c - beta)
    d = (a + 1) + (a - 1) * c + beta, flip * -2 * ((a - 1) + (a + 1) * c), (a + 1) + (a - 1) * c - beta
    return b[0] / d[0], b[1] / d[0], b[2] / d[0], d[1] / d[0], d[2] / d[0]


def sections(rate: int, s: Settings) -> list[tuple]:
    low, peak, high = s.tone_db
    return [shelf(s.freq_low_hz / rate, low, s.slope, False), peaking(s.freq_peak_hz / rate, peak, s.slope), shelf(s.freq_high_hz / rate, high, s.slope, True)]


def pre_gain(s: Settings) -> float:
    """Takes off the largest boost, so that no band can clip."""
    return 10 ** (-max(0.0, *s.tone_db) / 20)


def equalized(pcm: DataFrame, rate: int, s: Settings = Settings()) -> DataFrame:
    return per_stream(pcm, sections(rate, s), pre_gain(s))
