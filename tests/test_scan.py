"""Filters and envelopes over chunks of one stream against one pass in turn."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.operators import equalizer, meters, recurrence, resample
from tonelake.plans.settings import Envelope, Settings

PCM = "stream_id string, frame_no long, left int, right int"


def in_turn(x, sections):
    for b0, b1, b2, a1, a2 in sections:
        z, y = np.zeros((2, x.shape[1])), np.empty_like(x)
        for i in range(len(x)):
            y[i] = b0 * x[i] + z[0]
            z[0], z[1] = b1 * x[i] - a1 * y[i] + z[1], b2 * x[i] - a2 * y[i]
        x = y
    return x


@pytest.mark.parametrize("chunk", [1, 7, 100, 1 << 16])
def test_filter_by_chunks(spark, chunk):
    rng, n = np.random.default_rng(chunk), 500 if chunk > 1 else 60
    sections = [*equalizer.sections(44_100, Settings(tone_db=(6.0, -3.0, 4.0))), resample.low_pass(48_000)]
    rows = [(s, i + 40 * (i > 200), int(v), int(w)) for s in ("a", None) for i, (v, w) in enumerate(rng.integers(-(2**28), 2**28, (n, 2)))]  # a gap in frame numbers
    got = recurrence.per_stream(spark.createDataFrame(rows, PCM).repartition(5), sections, 0.7, chunk)
    for s in ("a", None):
        x = np.array([r[2:] for r in rows if r[0] == s], float) * 0.7
        own = got.where(F.col("stream_id").eqNullSafe(F.lit(s))).orderBy("frame_no").collect()
        assert [r.frame_no for r in own] == [r[1] for r in rows if r[0] == s]
        assert np.abs(np.array([r[2:] for r in own]) - in_turn(x, sections)).max() <= 1


@pytest.mark.parametrize("e, cap", [(Envelope(200, 30, 1), 255), (Envelope(100, 20, 1), None), (Envelope(3, 1, 9), 200), (Envelope(1, 1, 0), None)])
def test_envelope_by_chunks(spark, e, cap):
    rng = np.random.default_rng(8)
    rows = [(s, int(i), int(v)) for s in "ab" for i, v in enumerate(np.abs(rng.normal(0, 60, 700)).clip(0, 255))]
    df = spark.createDataFrame(rows, "stream_id string, window_no long, v int").repartition(3)
    got = sorted(map(tuple, meters.enveloped(df, "v", e, cap, chunk=50).collect()))
    want = []
    for s in "ab":
        d = h = 0
        for _, i, x in [r for r in rows if r[0] == s]:
            if x > d:
                d, h = min(d + e.attack, x if cap is None else cap), e.hold
            elif h == 0:
                d -= min(d - x, e.release)
            else:
                h -= 1
            want.append((s, i, x, d))
    assert got == want


def test_one_stream_spreads_over_tasks(spark):
    df = spark.range(4000).select(F.lit("s").alias("stream_id"), F.col("id").alias("frame_no"), F.lit(1 << 20).alias("left"), F.lit(0).alias("right"))
    out = recurrence.per_stream(df, [resample.low_pass(48_000)], 1.0, 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a small table would be one task's
    try:
        assert out.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_levels_out_of_range_raise(spark):
    df = spark.createDataFrame([("s", 0, 300)], "stream_id string, window_no long, v int")
    with pytest.raises(Exception, match="0 to 255"):
        meters.enveloped(df, "v", Envelope(1, 1, 1)).collect()
    assert meters.enveloped(df, "v", Envelope(500, 1, 1), most=1000).first()["display"] == 300
    assert meters.enveloped(df.limit(0), "v", Envelope(1, 1, 1)).count() == 0
