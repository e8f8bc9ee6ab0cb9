"""Filters in blocks against the recurrence sample by sample, and windows of streams that lose frames."""

import numpy as np

from tonelake.operators import equalizer, recurrence, resample
from tonelake.plans.settings import Settings


def one_by_one(x, c, z):
    b0, b1, b2, a1, a2 = c
    y = np.empty_like(x)
    for i in range(len(x)):
        y[i] = b0 * x[i] + z[0]
        z[0] = b1 * x[i] - a1 * y[i] + z[1]
        z[1] = b2 * x[i] - a2 * y[i]
    return y


def test_blocks_equal_the_recurrence():
    rng = np.random.default_rng(3)
    for c in [*equalizer.sections(44_100, Settings(tone_db=(6.0, -3.0, 4.0))), resample.low_pass(48_000)]:
        for n in (0, 1, 2, 63, 64, 65, 700):
            x, a, b = rng.normal(size=(n, 2)) * 2**31, rng.normal(size=(2, 2)), None
            b = a.copy()
            assert np.allclose(recurrence.biquad(x, c, a), one_by_one(x, c, b), rtol=1e-9, atol=1e-2) and np.allclose(a, b, rtol=1e-9, atol=1e-2)


def test_streams_keep_their_own_state(spark):
    rng = np.random.default_rng(4)
    rows = [(f"s{k}", i, int(v), int(-v)) for k in range(5) for i, v in enumerate(rng.integers(-(2**30), 2**30, 90 + k))]
    c = resample.low_pass(48_000)
    got = {(r.stream_id, r.frame_no): (r.left, r.right) for r in recurrence.per_stream(spark.createDataFrame(rows, "stream_id string, frame_no long, left int, right int").repartition(3), [c], 0.5).collect()}
    for k in range(5):
        x = np.array([r[2:] for r in rows if r[0] == f"s{k}"], float) * 0.5
        want = one_by_one(x, c, np.zeros((2, 2)))
        assert all(np.abs(np.array(got[(f"s{k}", i)]) - want[i]).max() <= 1 for i in range(len(x)))
