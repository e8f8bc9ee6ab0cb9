"""Recurrences and spectra against plain models written from their description."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.operators import equalizer, meters, resample, running, spectrum
from tonelake.plans import playback
from tonelake.plans.settings import Envelope, Settings


def pcm(spark, samples, stream="s"):
    return spark.createDataFrame([(stream, i, int(a), int(b)) for i, (a, b) in enumerate(samples)], "stream_id string, frame_no long, left int, right int")


def model(values, e, cap):
    display, hold, out = 0, 0, []
    for x in values:
        if x > display:
            hold, display = e.hold, min(display + e.attack, x if cap is None else cap)
        elif hold == 0:
            display -= min(display - x, e.release)
        else:
            hold -= 1
        out.append(display)
    return out


@pytest.mark.parametrize("cap", [255, None])
@pytest.mark.parametrize("e", [Envelope(200, 30, 1), Envelope(40, 7, 3)])
def test_envelope(spark, e, cap):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 256, 80).tolist() + [0] * 20
    rows = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "stream_id string, window_no long, v int")
    got = [r.display for r in meters.enveloped(rows, "v", e, cap).orderBy("window_no").collect()]
    assert got == model(values, e, cap)
    one = spark.createDataFrame([(values,)], "v array<int>").select(meters.envelope(F.col("v"), e, cap).alias("d")).first().d
    assert one == got


def test_fade_out_reaches_zero(spark):
    rows = spark.createDataFrame([("s", 0, 255)], "stream_id string, window_no long, v int")
    e = Envelope(255, 30, 1)
    shown = meters.delayed(meters.enveloped(meters.with_fade_out(rows, "v", e), "v", e, 255), "display").orderBy("window_no").collect()
    assert shown[-1].display == shown[-1].delayed == 0 and max(r.delayed for r in shown) == 255


def test_partial_window_is_dropped(spark):
    assert meters.vu_windows(pcm(spark, [(1 << 30, -(1 << 31))] * 10), 4).count() == 2
    top = meters.vu_windows(pcm(spark, [(-(1 << 31), (1 << 31) - 1)] * 4), 4).first()
    assert top.left_mean == top.left_max == 255 and top.right_mean == 255


def test_equalizer_flat_is_identity_and_boost_has_headroom(spark):
    x = [(int(1e8 * math.sin(i / 7)), i * 1000) for i in range(400)]
    flat = equalizer.equalized(pcm(spark, x), 44_100).orderBy("frame_no").collect()
    assert max(abs(r.left - a) for r, (a, _) in zip(flat, x)) <= 1
    s = Settings(tone_db=(6.0, 0.0, 0.0))
    z = np.zeros((3, 2))
    want = []
    for a, _ in x:
        y = a * equalizer.pre_gain(s)
        for k, (b0, b1, b2, a1, a2) in enumerate(equalizer.sections(44_100, s)):
            v = b0 * y + z[k, 0]
            z[k] = b1 * y - a1 * v + z[k, 1], b2 * y - a2 * v
            y = v
        want.append(int(y))
    got = [r.left for r in equalizer.equalized(pcm(spark, x), 44_100, s).orderBy("frame_no").collect()]
    assert max(abs(a - b) for a, b in zip(got, want)) <= 1


def test_low_pass_has_unit_gain_at_zero():
    b0, b1, b2, a1, a2 = resample.low_pass(48_000)
    assert abs((b0 + b1 + b2) / (1 + a1 + a2) - 1) < 1e-12


@pytest.mark.parametrize("chunk", [1 << 16, 16])
def test_resample_loop_model(spark, chunk, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", chunk)
    rng = np.random.default_rng(2)
    x = [(int(a), int(b)) for a, b in rng.integers(-(2**31), 2**31, (200, 2))]
    step = resample.step_of(22_050, 48_000)
    want, k = [], 0
    while (at := k * step) >> 32 < len(x) - 1:
        i, f = at >> 32, at & 0xFFFFFFFF
        want.append(tuple(x[i][c] + ((x[i + 1][c] - x[i][c]) * f >> 32) for c in (0, 1)))
        k += 1
    got = [(r.left, r.right) for r in resample.linear(pcm(spark, x), 22_050, 48_000).orderBy("frame_no").collect()]
    assert got == want


def test_band_levels_match_numpy(spark):
    n = 4096
    t = np.arange(n)
    x = (1e9 * np.sin(2 * np.pi * 1000 * t / 44_100)).astype(np.int64)
    got = {(r.fft_no, r.band): r.level for r in spectrum.band_levels(pcm(spark, [(v, v) for v in x])).collect()}
    mix = (x >> 17) * 2
    w = 0.5 * (1 - np.cos(2 * np.pi * np.arange(512) / 511))
    for fft in (7,):
        p = np.abs(np.fft.rfft(mix[fft * 256 : fft * 256 + 512] * w)) ** 2
        for band, (a, b, weight) in enumerate(spectrum.BANDS):
            db = min(max(10 * math.log10(p[a : b + 1].sum() * weight / (b - a + 1) + 1), 90), 120)
            assert abs(got[(fft, band)] - int((db - 90) / 30 * 255 + 0.5)) <= 1


def test_play_runs_all_stages(spark):
    s = Settings(vu_level=True, spectrum=True, force_mono=True, tone_db=(3.0, 0.0, -3.0), volume=10, output_rate=48_000)
    out = playback.play(pcm(spark, [(1 << 28, -(1 << 28))] * 5000), 44_100, s)
    assert out.samples.count() > 5000 and out.vu.count() == 2 and out.bands.count() == 32
    assert playback.vu_events(out.vu).where("s = 'VU' AND e = 14").count() == 2
    with pytest.raises(ValueError):
        Settings(output_rate=96_000).checked()


def test_plans_stay_native(spark):
    p = playback.play(pcm(spark, [(1, 1)]), 44_100, Settings(force_mono=True)).samples._jdf.queryExecution().toString()
    assert "Python" not in p and "MapIn" not in p
    rows = pcm(spark, [(1, 1)]).where(F.lit(True))
    assert meters.vu_windows(rows, 4)._jdf.queryExecution().toString().count("Exchange hashpartitioning") <= 1


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_running_sums_over_chunks(spark, chunk):
    rng = np.random.default_rng(3)
    rows = [(s, i * 3, int(rng.integers(0, 100))) for s in "ab" for i in range(50)]
    got = running.running_sums(spark.createDataFrame(rows, "stream_id string, n long, v long"), {"total": "v"}, "n", chunk=chunk).collect()
    assert len(got) == 100
    for s in "ab":
        own = sorted((r for r in got if r.stream_id == s), key=lambda r: r.n)
        assert [r.total for r in own] == np.cumsum([r.v for r in own]).tolist()
