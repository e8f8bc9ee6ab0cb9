"""Queries over signals: levels, gains, resampling, envelopes, spectra, running totals, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import signal
from tonelake.operators import equalizer, lyrics, meters, resample, running, spectrum
from tonelake.plans.bindings import BLOCKS_SQL, MANY_SQL, ONE_SQL, blocks, many_streams, one_stream, table
from tonelake.plans.settings import EVENTS, Settings

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

N = 64  #: frames in a window of the one stream; the pipeline's own default is Settings().window
MANY_N = 4
S = Settings()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


VU_SQL = "least(abs({0}::BIGINT) >> 23, 255)"
VU_L, VU_R = VU_SQL.format("l"), VU_SQL.format("r")


def _windows_sql(n: int) -> str:
    return f"""win AS (SELECT stream_id, frame_no // {n} AS window_no, (sum({VU_L})::BIGINT // count(*))::INTEGER AS left_mean, (sum({VU_R})::BIGINT // count(*))::INTEGER AS right_mean,
    max({VU_L})::INTEGER AS left_max, max({VU_R})::INTEGER AS right_max FROM pcm GROUP BY stream_id, frame_no // {n} HAVING count(*) = {n})"""


@query("E1_vu_windows", f"WITH {ONE_SQL}, {_windows_sql(N)} SELECT * FROM win")
def vu_windows(spark, d):
    return meters.vu_windows(one_stream(spark, d), N)


@query("K1_default_windows", f"WITH {ONE_SQL}, {_windows_sql(2048)} SELECT * FROM win")
def default_windows(spark, d):
    return meters.vu_windows(one_stream(spark, d), S.window)


@query("F3_delayed", f"WITH {ONE_SQL}, {_windows_sql(N)} SELECT stream_id, window_no, lag(left_mean, 2, 0) OVER (PARTITION BY stream_id ORDER BY window_no)::INTEGER AS delayed FROM win")
def delayed(spark, d):
    return meters.delayed(meters.vu_windows(one_stream(spark, d), N), "left_mean").select("stream_id", "window_no", "delayed")


@query("D7_vu_curve", "SELECT range::INTEGER AS level, round(255.0 * sqrt(range / 255.0))::INTEGER AS shown FROM range(256)")
def vu_curve(spark, d):
    return spark.range(256).select(F.col("id").cast("int").alias("level"), signal.vu_curve(F.col("id")).alias("shown"))


GAIN_SQL = "greatest(least(trunc({0}::DOUBLE * {1}), 2147483647.0), -2147483648.0)::BIGINT::INTEGER"


@query("D1_gain", f"WITH {ONE_SQL} SELECT frame_no, {GAIN_SQL.format('l', '0.7071')} AS l, {GAIN_SQL.format('r', '1.4142')} AS r FROM pcm")
def gain(spark, d):
    return one_stream(spark, d).select("frame_no", signal.gain(F.col("left"), 0.7071).alias("l"), signal.gain(F.col("right"), 1.4142).alias("r"))


LEVEL_SQL = "(CASE WHEN v <= 0 THEN 0.0::DOUBLE ELSE pow(10.0::DOUBLE, greatest(least(-112.0::DOUBLE * (v / 21.0) ** 3 + 172.0::DOUBLE * (v / 21.0) ** 2 - 60.0, 0.0), -60.0) / 20.0) END)"


@query(
    "D2_volume_limits",
    f"""WITH g AS (SELECT v.range::DOUBLE AS v, b.range::DOUBLE - 16 AS b FROM range(22) v, range(33) b)
    SELECT v, b, round({LEVEL_SQL} * pow(10.0, CASE WHEN b > 0 THEN -b ELSE 0 END / 20.0), 9) AS l, round({LEVEL_SQL} * pow(10.0, CASE WHEN b < 0 THEN b ELSE 0 END / 20.0), 9) AS r FROM g""",
)
def volume_limits(spark, d):
    grid = spark.range(22 * 33).select(F.expr("id div 33").cast("double").alias("v"), (F.col("id") % 33 - 16).cast("double").alias("b"))
    left, right = signal.volume_limits(F.col("v"), 21, F.col("b"))
    return grid.select("v", "b", F.round(left, 9).alias("l"), F.round(right, 9).alias("r"))


@query("D3_gain_ramp", "SELECT t.range::INTEGER AS tick, g.range::INTEGER AS target, round(5.0 + sign(g.range - 5.0) * least(t.range * 0.42::DOUBLE, abs(g.range - 5.0)), 9) AS volume FROM range(61) t, range(22) g")
def gain_ramp(spark, d):
    grid = spark.range(61 * 22).select(F.expr("id div 22").cast("int").alias("tick"), (F.col("id") % 22).cast("int").alias("target"))
    return grid.select("tick", "target", F.round(signal.ramped(F.lit(5.0), F.col("target").cast("double"), F.col("tick")), 9).alias("volume"))


@query("D4_mono", f"WITH {ONE_SQL} SELECT frame_no, ((l::BIGINT + r::BIGINT) >> 1)::INTEGER AS m FROM pcm")
def mono(spark, d):
    return one_stream(spark, d).select("frame_no", signal.mono(F.col("left"), F.col("right")).alias("m"))


@query("D5_vu", f"WITH {ONE_SQL} SELECT frame_no, {VU_L}::INTEGER AS l, {VU_R}::INTEGER AS r FROM pcm")
def vu(spark, d):
    return one_stream(spark, d).select("frame_no", signal.vu(F.col("left")).alias("l"), signal.vu(F.col("right")).alias("r"))


@query("D6_spectrum_mix", f"WITH {ONE_SQL} SELECT frame_no, ((l >> 17) + (r >> 17))::INTEGER AS x FROM pcm")
def spectrum_mix(spark, d):
    return one_stream(spark, d).select("frame_no", signal.spectrum_mix(F.col("left"), F.col("right")).alias("x"))


@query("D12_narrow16", f"WITH {ONE_SQL} SELECT frame_no, (l >> 16)::INTEGER AS l, (r >> 16)::INTEGER AS r FROM pcm")
def narrow16(spark, d):
    return one_stream(spark, d).select("frame_no", signal.narrow16(F.col("left")).alias("l"), signal.narrow16(F.col("right")).alias("r"))


def _db_sql() -> str:
    def power(c):
        return f"(pow({c[0]} + {c[1]} * cos(w) + {c[2]} * cos(2 * w), 2) + pow({c[1]} * sin(w) + {c[2]} * sin(2 * w), 2))"

    return " + ".join(f"10 * log10({power(b)} / {power(a)})" for b, a in equalizer.EXAMPLE)


@query("D13_biquad_response", f"SELECT range::INTEGER AS i, round({_db_sql()}, 6) AS db FROM (SELECT range, pi() * range / 8192 AS w FROM range(8192))")
def biquad_response(spark, d):
    return spark.range(8192).select(F.col("id").cast("int").alias("i"), F.round(signal.biquad_db(F.pi() * F.col("id") / 8192, equalizer.EXAMPLE), 6).alias("db"))


STEP = resample.step_of(44_100, 48_000)


@query(
    "D9_resample",
    f"""WITH {ONE_SQL}, near AS (SELECT frame_no AS i, l::BIGINT AS l0, r::BIGINT AS r0, lead(l) OVER (ORDER BY frame_no)::BIGINT AS l1, lead(r) OVER (ORDER BY frame_no)::BIGINT AS r1 FROM pcm),
    k AS (SELECT i, l0, r0, l1, r1, unnest(range((i * 4294967296 + {STEP - 1}) // {STEP}, ((i + 1) * 4294967296 + {STEP - 1}) // {STEP})) AS k FROM near WHERE l1 IS NOT NULL),
    f AS (SELECT *, k::HUGEINT * {STEP} - i::HUGEINT * 4294967296 AS f FROM k)
    SELECT k AS frame_no, (l0 + floor((l1 - l0)::HUGEINT * f / 4294967296::DOUBLE))::BIGINT AS l, (r0 + floor((r1 - r0)::HUGEINT * f / 4294967296::DOUBLE))::BIGINT AS r FROM f""",
)
def resampled(spark, d):
    return resample.linear(one_stream(spark, d), 44_100, 48_000).select("frame_no", F.col("left").cast("bigint").alias("l"), F.col("right").cast("bigint").alias("r"))


CSTEP = resample.step_of(48_000, 44_100)


@query(
    "D11_catmull_rom",
    f"""WITH {ONE_SQL}, near AS (SELECT frame_no AS i, lag(l >> 16) OVER w AS a, l >> 16 AS b, lead(l >> 16) OVER w AS c, lead(l >> 16, 2) OVER w AS d FROM pcm WINDOW w AS (ORDER BY frame_no)),
    k AS (SELECT *, unnest(range((i * 4294967296 + {CSTEP - 1}) // {CSTEP}, ((i + 1) * 4294967296 + {CSTEP - 1}) // {CSTEP})) AS k FROM near WHERE a IS NOT NULL AND d IS NOT NULL),
    f AS (SELECT *, (k * {CSTEP} - i * 4294967296) / 4294967296.0::DOUBLE AS t FROM k)
    SELECT k AS frame_no, trunc(greatest(least(0.5::DOUBLE * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t * t + (3 * b - a - 3 * c + d) * t * t * t), 32767.0), -32768.0))::INTEGER AS l FROM f""",
)
def cubic(spark, d):
    pcm = one_stream(spark, d).withColumns({c: signal.narrow16(F.col(c)) for c in ("left", "right")})
    return resample.catmull_rom(pcm, 48_000).select("frame_no", F.col("left").alias("l"))


def _filtered_sql(n: int, x: str) -> str:
    """CTEs u{n}, y{n}: a section of the table ``sec`` over (stream_id, frame_no, x) rows, in direct form, a frame of all streams a step."""
    return f"""u{n} AS MATERIALIZED (SELECT stream_id, frame_no, a1, a2, b0 * x + b1 * lag(x, 1, 0) OVER w + b2 * lag(x, 2, 0) OVER w AS u FROM ({x}), sec WHERE i = {n} WINDOW w AS (PARTITION BY stream_id ORDER BY frame_no)),
    y{n} AS (SELECT stream_id, frame_no, u AS x, 0::DOUBLE AS past FROM u{n} WHERE frame_no = 0
        UNION ALL SELECT n.stream_id, n.frame_no, n.u - n.a1 * p.x - n.a2 * p.past, p.x FROM y{n} p JOIN u{n} n ON n.stream_id = p.stream_id AND n.frame_no = p.frame_no + 1)"""


def _held_sql(y: str) -> str:
    """Samples cut toward zero, held within 32 bits, of which the upper 24."""
    held = "floor(trunc(greatest(least(x, 2147483647), -2147483648)) / 256)::INTEGER"
    return f'SELECT stream_id, frame_no, {held} AS "left", {held} AS "right" FROM {y}'


def _upper(pcm):
    """The upper 24 of 32 bits: the lowest depend on the order in which a filter's products are rounded."""
    return pcm.select("stream_id", "frame_no", *[F.shiftright(c, 8).alias(c) for c in ("left", "right")])


TONE = Settings(tone_db=(6.0, -3.0, 4.0))
SECTIONS_SQL = f"""bands AS (SELECT i, kind, 2 * pi() * freq / 44100 AS w, pow(10, db / 40) AS a FROM (VALUES (0, 'low', {TONE.freq_low_hz}, {TONE.tone_db[0]}::DOUBLE), (1, 'peak', {TONE.freq_peak_hz}, {TONE.tone_db[1]}), (2, 'high', {TONE.freq_high_hz}, {TONE.tone_db[2]})) v(i, kind, freq, db)),
    parts AS (SELECT *, cos(w) AS c, sin(w) / (2 * {TONE.slope}) AS alpha, 2 * sqrt(a) * sin(w) / (2 * {TONE.slope}) AS s FROM bands),
    raw AS (SELECT i, a * (a + 1 - (a - 1) * c + s) AS n0, 2 * a * (a - 1 - (a + 1) * c) AS n1, a * (a + 1 - (a - 1) * c - s) AS n2, a + 1 + (a - 1) * c + s AS d0, -2 * (a - 1 + (a + 1) * c) AS d1, a + 1 + (a - 1) * c - s AS d2 FROM parts WHERE kind = 'low'
        UNION ALL SELECT i, 1 + alpha * a, -2 * c, 1 - alpha * a, 1 + alpha / a, -2 * c, 1 - alpha / a FROM parts WHERE kind = 'peak'
        UNION ALL SELECT i, a * (a + 1 + (a - 1) * c + s), -2 * a * (a - 1 + (a + 1) * c), a * (a + 1 + (a - 1) * c - s), a + 1 - (a - 1) * c + s, 2 * (a - 1 - (a + 1) * c), a + 1 - (a - 1) * c - s FROM parts WHERE kind = 'high'),
    sec AS (SELECT i, n0 / d0 AS b0, n1 / d0 AS b1, n2 / d0 AS b2, d1 / d0 AS a1, d2 / d0 AS a2 FROM raw)"""


@query(
    "D8_equalizer",
    f"""WITH RECURSIVE {MANY_SQL}, {SECTIONS_SQL}, {_filtered_sql(0, f"SELECT stream_id, frame_no, l * pow(10, -{max(TONE.tone_db)} / 20) AS x FROM pcm")},
    {_filtered_sql(1, "SELECT stream_id, frame_no, x FROM y0")}, {_filtered_sql(2, "SELECT stream_id, frame_no, x FROM y1")} {_held_sql("y2")}""",
)
def equalized(spark, d):
    return _upper(equalizer.equalized(many_streams(spark, d), 44_100, TONE))


LOW_PASS_SQL = """ang AS (SELECT 2 * pi() * 0.45 AS w), sec AS (SELECT 0 AS i, (1 - cos(w)) / 2 / (1 + sin(w) / sqrt(2)) AS b0, (1 - cos(w)) / (1 + sin(w) / sqrt(2)) AS b1, (1 - cos(w)) / 2 / (1 + sin(w) / sqrt(2)) AS b2,
    -2 * cos(w) / (1 + sin(w) / sqrt(2)) AS a1, (1 - sin(w) / sqrt(2)) / (1 + sin(w) / sqrt(2)) AS a2 FROM ang)"""


@query("D10_low_pass", f"WITH RECURSIVE {MANY_SQL}, {LOW_PASS_SQL}, {_filtered_sql(0, 'SELECT stream_id, frame_no, l::DOUBLE AS x FROM pcm')} {_held_sql('y0')}")
def low_pass(spark, d):
    return _upper(resample.smoothed(many_streams(spark, d), 44_100))


RATED_SQL = """rated AS (SELECT *, sum(bytes_in) OVER w AS sum_bytes, sum(samples_out) OVER w AS sum_samples FROM blocks WINDOW w AS (PARTITION BY stream_id ORDER BY block_no ROWS UNBOUNDED PRECEDING)),
    avgs AS (SELECT *, (sum_bytes::BIGINT * 8 * 44100) // sum_samples::BIGINT AS average FROM rated),
    still AS (SELECT *, CASE WHEN abs(average - lag(average, 1, 0) OVER (PARTITION BY stream_id ORDER BY block_no)) < 100 THEN 1 ELSE 0 END AS st FROM avgs),
    br AS (SELECT *, CASE WHEN sum(st) OVER (PARTITION BY stream_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) > 10 THEN average ELSE 0 END AS bitrate FROM still)"""


@query("E2_average_bitrate", f"WITH {BLOCKS_SQL}, {RATED_SQL} SELECT stream_id, block_no, average, bitrate FROM br")
def average_bitrate(spark, d):
    return running.average_bitrate(blocks(spark, d), 44_100).select("stream_id", "block_no", "average", "bitrate")


@query(
    "E3_audio_time",
    f"""WITH {BLOCKS_SQL}, {RATED_SQL} SELECT stream_id, block_no, sum_samples::BIGINT // 44100 AS seconds, CASE WHEN bitrate > 0 THEN round(40000000::DOUBLE / bitrate)::BIGINT END AS duration,
    CASE WHEN bitrate > 0 THEN round(40000000::DOUBLE / bitrate)::BIGINT * 44100 END AS total_samples FROM br""",
)
def audio_time(spark, d):
    return running.audio_time(running.average_bitrate(blocks(spark, d), 44_100), 44_100, 5_000_000).select("stream_id", "block_no", "seconds", "duration", "total_samples")


@query("E5_frame_averages", f"WITH {BLOCKS_SQL} SELECT stream_id, count(*) AS frames, sum(bytes_in)::BIGINT AS bytes, sum(samples_out)::BIGINT AS samples, (sum(bytes_in)::BIGINT * 8 * 44100) // sum(samples_out)::BIGINT AS bitrate FROM blocks GROUP BY stream_id")
def frame_averages(spark, d):
    return running.frame_averages(blocks(spark, d), 44_100)


@query(
    "E6_sample_offset",
    f"""WITH {BLOCKS_SQL}, p AS (SELECT stream_id, block_no, coalesce(sum(bytes_in) OVER (PARTITION BY stream_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offs FROM blocks)
    SELECT stream_id, arg_min(block_no, block_no) AS sample_no, arg_min(offs, block_no) AS "offset" FROM p WHERE offs >= 3000 GROUP BY stream_id""",
)
def sample_offset(spark, d):
    sizes = blocks(spark, d).select("stream_id", F.col("block_no").alias("sample_no"), F.col("bytes_in").alias("size"), F.lit(3000).alias("target"))
    return running.sample_offset(sizes)


@query(
    "F8_running_totals",
    f"WITH {BLOCKS_SQL}, {RATED_SQL} SELECT stream_id, block_no, sum_bytes::BIGINT AS sum_bytes, sum_samples::BIGINT AS sum_samples FROM rated",
)
def running_totals(spark, d):
    return running.average_bitrate(blocks(spark, d), 44_100).select("stream_id", "block_no", "sum_bytes", "sum_samples")


SEEK_SQL = "SELECT event_id, event_id * 37 % 900000 AS pos, 1000 AS start, 900000 AS size, 40000000 AS total, 128000 AS br, event_id % 61 - 30 AS sec FROM events"


def _seeks(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", (e * 37 % 900_000).alias("pos"), F.lit(1000).alias("start"), F.lit(900_000).alias("size"), F.lit(40_000_000).alias("total"), F.lit(128_000).alias("br"), (e % 61 - 30).alias("sec"))


@query("J1_samples_at", f"SELECT event_id, floor(total * ((pos - start) / size::DOUBLE))::BIGINT AS samples FROM ({SEEK_SQL})")
def samples_at(spark, d):
    return _seeks(spark, d).select("event_id", running.samples_at(F.col("pos"), F.col("start"), F.col("size"), F.col("total")).alias("samples"))


@query("J2_position_at", f"SELECT event_id, start + floor(br * (event_id % 500) / 8.0)::BIGINT AS at FROM ({SEEK_SQL})")
def position_at(spark, d):
    return _seeks(spark, d).select("event_id", running.position_at(F.col("event_id") % 500, F.col("start"), F.col("br")).alias("at"))


@query("J3_moved", f"SELECT event_id, CASE WHEN t <= 901000 THEN t END AS at FROM (SELECT event_id, greatest(pos + floor(sec * br / 8.0)::BIGINT, start) AS t FROM ({SEEK_SQL}))")
def moved(spark, d):
    return _seeks(spark, d).select("event_id", running.moved(F.col("pos"), F.col("sec"), F.col("br"), F.col("start"), F.lit(901_000)).alias("at"))


@query(
    "J4_next_frame",
    f"""WITH {BLOCKS_SQL}, f AS (SELECT stream_id, coalesce(sum(bytes_in) OVER (PARTITION BY stream_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS o FROM blocks),
    t AS (SELECT stream_id, range * 1500 AS target FROM (SELECT DISTINCT stream_id FROM blocks), range(8))
    SELECT t.stream_id, t.target, min(f.o) AS "offset" FROM t LEFT JOIN f ON f.stream_id = t.stream_id AND f.o >= t.target GROUP BY ALL""",
)
def next_frame(spark, d):
    from pyspark.sql import Window

    before = Window.partitionBy("stream_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    frames = blocks(spark, d).select("stream_id", F.coalesce(F.sum("bytes_in").over(before), F.lit(0)).alias("offset"))
    targets = blocks(spark, d).select("stream_id").distinct().withColumn("target", F.explode(F.expr("sequence(0L, 10500L, 1500L)")))
    return running.next_frame(frames, targets)


INFO_VALUES = [("a", "MP3", 44100, 2, 16, 4_000_000, None, None, None, 128_000), ("b", "OGG", 48000, 2, 16, 900_000, 4_800_000, None, None, None), ("c", "WAV", 44100, 1, 16, 882_000, None, 441_000, 705_600, None), ("d", "AAC", 22050, 1, 16, 0, None, None, None, None)]
INFO_SQL = ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in row) + ")" for row in INFO_VALUES)


@query(
    "J6_stream_info",
    f"""WITH s AS (SELECT * FROM (VALUES {INFO_SQL}) v(stream_id, codec, sample_rate, channels, bits, data_size, last_granule, header_samples, nominal_bitrate, average_bitrate)),
    x AS (SELECT *, floor(coalesce(coalesce(last_granule, header_samples) / nullif(sample_rate, 0)::DOUBLE, data_size * 8 / nullif(coalesce(nominal_bitrate, average_bitrate), 0)::DOUBLE))::BIGINT AS duration FROM s)
    SELECT stream_id, duration, coalesce(nominal_bitrate, floor(data_size * 8 / nullif(duration, 0)::DOUBLE)::BIGINT, average_bitrate)::BIGINT AS bitrate, coalesce(last_granule, header_samples, duration * sample_rate)::BIGINT AS total_samples FROM x""",
)
def stream_info(spark, d):
    rows = spark.createDataFrame(INFO_VALUES, "stream_id string, codec string, sample_rate int, channels int, bits int, data_size long, last_granule long, header_samples long, nominal_bitrate long, average_bitrate long")
    return running.stream_info(rows).select("stream_id", "duration", "bitrate", "total_samples")


@query("J5_getters", f"WITH {BLOCKS_SQL}, {RATED_SQL} SELECT stream_id, max(sum_samples)::BIGINT AS samples, max(sum_bytes)::BIGINT AS position, max(sum_samples)::BIGINT // 44100 AS seconds, arg_max(average, block_no) AS bitrate FROM avgs GROUP BY stream_id")
def getters(spark, d):
    rated = running.average_bitrate(blocks(spark, d), 44_100)
    return rated.groupBy("stream_id").agg(F.max("sum_samples").alias("samples"), F.max("sum_bytes").alias("position"), F.expr("max(sum_samples) div 44100").alias("seconds"), F.max_by("average", "block_no").alias("bitrate"))


def _fold_sql(source: str, keys: str, order: str, value: str, e, cap: int | None) -> str:
    """The envelope as a fold over each stream's list."""
    ceiling = cap if cap is not None else "x.v"
    step = f"""CASE WHEN x.v > a.d THEN {{'v': 0, 'd': least(a.d + {e.attack}, {ceiling}), 'h': {e.hold}, 'o': list_append(a.o, least(a.d + {e.attack}, {ceiling}))}}
        WHEN a.h = 0 THEN {{'v': 0, 'd': a.d - least(a.d - x.v, {e.release}), 'h': 0, 'o': list_append(a.o, a.d - least(a.d - x.v, {e.release}))}}
        ELSE {{'v': 0, 'd': a.d, 'h': a.h - 1, 'o': list_append(a.o, a.d)}} END"""
    item = f"{{'v': {value}::BIGINT, 'd': 0::BIGINT, 'h': 0::BIGINT, 'o': []::BIGINT[]}}"
    start = "{'v': 0::BIGINT, 'd': 0::BIGINT, 'h': 0::BIGINT, 'o': []::BIGINT[]}"
    return f"""folded AS (SELECT {keys}, list({order} ORDER BY {order}) AS os, list({value} ORDER BY {order}) AS vs, list_reduce(list({item} ORDER BY {order}), lambda a, x: {step}, {start}).o AS ds FROM {source} GROUP BY {keys}),
    shown AS (SELECT {keys}, unnest(os) AS {order}, unnest(vs)::INTEGER AS {value}, unnest(ds)::INTEGER AS display FROM folded)"""


@query("F1_vu_bars", f"WITH {MANY_SQL}, {_windows_sql(MANY_N)}, {_fold_sql('win', 'stream_id', 'window_no', 'left_mean', S.vu_bars, 255)} SELECT * FROM shown")
def vu_bars(spark, d):
    return meters.enveloped(meters.vu_windows(many_streams(spark, d), MANY_N), "left_mean", S.vu_bars, 255)


@query("F1_vu_peak", f"WITH {MANY_SQL}, {_windows_sql(MANY_N)}, {_fold_sql('win', 'stream_id', 'window_no', 'left_mean', S.vu_peak, 255)} SELECT * FROM shown")
def vu_peak(spark, d):
    return meters.enveloped(meters.vu_windows(many_streams(spark, d), MANY_N), "left_mean", S.vu_peak, 255)


FADE = 255 // S.vu_bars.release + S.vu_bars.hold + 4


@query(
    "F4_fade_out",
    f"""WITH {MANY_SQL}, {_windows_sql(MANY_N)}, more AS (SELECT stream_id, window_no, left_mean FROM win UNION ALL SELECT stream_id, last + 1 + range, 0 FROM (SELECT stream_id, max(window_no) AS last FROM win GROUP BY stream_id), range({FADE})),
    {_fold_sql('more', 'stream_id', 'window_no', 'left_mean', S.vu_bars, 255)}
    SELECT stream_id, window_no, round(255.0 * sqrt(lag(display, 2, 0) OVER (PARTITION BY stream_id ORDER BY window_no) / 255.0))::INTEGER AS shown FROM shown""",
)
def fade_out(spark, d):
    faded = meters.with_fade_out(meters.vu_windows(many_streams(spark, d), MANY_N), "left_mean", S.vu_bars)
    shown = meters.delayed(meters.enveloped(faded, "left_mean", S.vu_bars, 255), "display")
    return shown.select("stream_id", "window_no", signal.vu_curve(F.col("delayed")).alias("shown"))


HANN_SQL = "0.5 * (1 - cos(2 * pi() * pos / {0}))"


@query(
    "F5_fft_frames",
    f"""WITH {ONE_SQL}, x AS (SELECT frame_no, (l >> 17) + (r >> 17) AS x, frame_no // 32 - k.range AS fft_no FROM pcm, range(2) k),
    p AS (SELECT fft_no, (frame_no - fft_no * 32)::INTEGER AS pos, x::INTEGER AS x FROM x WHERE fft_no >= 0) SELECT fft_no, pos, x, round({HANN_SQL.format(63)}, 9) AS hann FROM p""",
)
def fft_frames(spark, d):
    return spectrum.frames(one_stream(spark, d), 64, 32).select("fft_no", "pos", "x", F.round("hann", 9).alias("hann"))


SMALL_BANDS = [(1, 1, 0.1), (2, 3, 0.4), (4, 7, 1.0), (8, 15, 1.0), (16, 31, 1.5)]
SMALL_SQL = ", ".join(f"({i}, {a}, {b}, {w / (b - a + 1)!r}::DOUBLE)" for i, (a, b, w) in enumerate(SMALL_BANDS))
POWER_SQL = """x AS (SELECT vec_id AS fft_no, unnest(range(64)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
    pw AS (SELECT fft_no, bin.range::INTEGER AS bin, pow(sum(x * cos(2 * pi() * pos * bin.range / 64)), 2) + pow(sum(x * sin(2 * pi() * pos * bin.range / 64)), 2) AS power FROM x, range(33) bin GROUP BY fft_no, bin.range)"""


def _vectors(spark, d):
    rows = table(spark, d, "embeddings").select(F.lit("vectors").alias("stream_id"), F.col("vec_id").alias("fft_no"), F.posexplode("embedding").alias("pos", "x"))
    return rows.withColumn("x", F.col("x").cast("double"))


@query("F6_power", f"WITH {POWER_SQL} SELECT fft_no, bin, round(power, 6) AS power FROM pw")
def power(spark, d):
    return spectrum.power_by_join(_vectors(spark, d), 64).select("fft_no", "bin", F.round("power", 6).alias("power"))


@query("E4_band_energy", f"WITH {POWER_SQL}, b AS (SELECT * FROM (VALUES {SMALL_SQL}) v(band, a, z, w)) SELECT fft_no, band::INTEGER AS band, round(sum(power) * any_value(w), 6) AS energy FROM pw JOIN b ON bin BETWEEN a AND z GROUP BY fft_no, band")
def band_energy(spark, d):
    return spectrum.band_energy(spectrum.power_by_join(_vectors(spark, d), 64), spectrum.bands(spark, SMALL_BANDS)).select("fft_no", "band", F.round("energy", 6).alias("energy"))


ALL_BANDS_SQL = ", ".join(f"({i}, {a}, {b})" for i, (a, b, _) in enumerate(spectrum.BANDS))


@query("G5_bins_to_bands", f"SELECT range::INTEGER AS bin, v.band::INTEGER AS band FROM range(257) LEFT JOIN (VALUES {ALL_BANDS_SQL}) v(band, a, z) ON range BETWEEN a AND z")
def bins_to_bands(spark, d):
    bins = spark.range(257).select(F.col("id").cast("int").alias("bin"))
    return bins.join(F.broadcast(spectrum.bands(spark)), F.col("bin").between(F.col("first_bin"), F.col("last_bin")), "left").select("bin", "band")


FRAMES_SQL = f"""hann AS (SELECT range AS pos, 0.5 * (1 - cos(2 * pi() * range / 511)) AS h FROM range(512)), kept AS (SELECT 8 * range + 7 AS fft_no FROM range((SELECT count(*) FROM events) // 4096 + 1)),
    x AS (SELECT stream_id, fft_no, pos, ((floor(l / 131072.0) + floor(r / 131072.0)) * h) AS x FROM kept, hann, pcm WHERE frame_no = fft_no * 256 + pos AND fft_no IN (SELECT fft_no FROM kept k, pcm WHERE frame_no // 256 - k.fft_no BETWEEN 0 AND 1 GROUP BY fft_no HAVING count(*) = 512)),
    pw AS (SELECT stream_id, fft_no, bin, pow(sum(x * cos(2 * pi() * (pos * bin % 512) / 512)), 2) + pow(sum(x * sin(2 * pi() * (pos * bin % 512) / 512)), 2) AS power FROM x, (SELECT range AS bin FROM range(257)) GROUP BY stream_id, fft_no, bin),
    en AS (SELECT stream_id, fft_no, band, 10 * log10(sum(power) * any_value(w) / count(*) + 1) AS db FROM pw JOIN (VALUES {", ".join(f"({i}, {a}, {b}, {w})" for i, (a, b, w) in enumerate(spectrum.BANDS))}) v(band, a, z, w) ON bin BETWEEN a AND z GROUP BY stream_id, fft_no, band)"""


@query("F6_band_levels", f"WITH {ONE_SQL}, {FRAMES_SQL} SELECT stream_id, fft_no, band::INTEGER AS band, floor((greatest(least(db, 120), 90) - 90) / 30 * 255 + 0.5)::INTEGER AS level FROM en")
def band_levels(spark, d):
    return spectrum.band_levels(one_stream(spark, d))


def _levels(spark, d):
    energy = spectrum.band_energy(spectrum.power_by_join(_vectors(spark, d), 64), spectrum.bands(spark, SMALL_BANDS))
    return energy.select("band", (F.col("fft_no") % 50).alias("stream_id"), F.col("fft_no").alias("window_no"), F.floor(F.round(F.col("energy") * 100, 3) % 256).cast("int").alias("level"))


LEVELS_SQL = f"""b AS (SELECT * FROM (VALUES {SMALL_SQL}) v(band, a, z, w)), en AS (SELECT fft_no, band, sum(power) * any_value(w) AS energy FROM pw JOIN b ON bin BETWEEN a AND z GROUP BY fft_no, band),
    lv AS (SELECT band::INTEGER AS band, fft_no % 50 AS stream_id, fft_no AS window_no, floor(round(energy * 100, 3) % 256)::INTEGER AS level FROM en)"""


@query("F2_spectrum_bars", f"WITH {POWER_SQL}, {LEVELS_SQL}, {_fold_sql('lv', 'band, stream_id', 'window_no', 'level', S.spectrum_bars, None)} SELECT * FROM shown")
def spectrum_bars(spark, d):
    return meters.enveloped(_levels(spark, d), "level", S.spectrum_bars, None, ("band", "stream_id"))



def _lines(spark, d):
    rows = many_streams(spark, d).select("stream_id", F.col("frame_no").cast("int").alias("line_no"), (F.col("frame_no") * 700 + F.col("stream_id").cast("bigint") % 7 * 100).alias("ts_ms"))
    return rows.withColumn("text", F.concat(F.lit("line "), F.col("line_no").cast("string")))


def _block_times(spark, d):
    return many_streams(spark, d).select("stream_id", F.col("frame_no").alias("block_no"), F.expr("(frame_no + 1) * 1152 * 20 div 44100 * 1000").alias("time_ms"))


LYRICS_SQL = f"""{MANY_SQL}, ln AS (SELECT stream_id, frame_no::INTEGER AS line_no, frame_no * 700 + stream_id::BIGINT % 7 * 100 AS ts_ms FROM pcm),
    bl AS (SELECT stream_id, frame_no AS block_no, ((frame_no + 1) * 1152 * 20 // 44100) * 1000 AS time_ms FROM pcm)"""


@query("G4_lyrics_due", f"WITH {LYRICS_SQL} SELECT ln.stream_id, line_no, ts_ms, min(block_no) AS block_no FROM ln LEFT JOIN bl ON bl.stream_id = ln.stream_id AND time_ms > ts_ms GROUP BY ln.stream_id, line_no, ts_ms")
def lyrics_due(spark, d):
    return lyrics.due(_lines(spark, d), _block_times(spark, d)).drop("text")


@query(
    "G4_lyrics_shown",
    f"""WITH {LYRICS_SQL}, du AS (SELECT ln.stream_id, line_no, min(block_no) AS due FROM ln JOIN bl ON bl.stream_id = ln.stream_id AND time_ms > ts_ms GROUP BY ln.stream_id, line_no),
    pl AS (SELECT stream_id, line_no, max(due - line_no) OVER (PARTITION BY stream_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) + line_no AS block_no FROM du)
    SELECT pl.* FROM pl JOIN (SELECT stream_id, max(block_no) AS last FROM bl GROUP BY stream_id) m USING (stream_id) WHERE block_no <= last""",
)
def lyrics_shown(spark, d):
    return lyrics.shown(_lines(spark, d), _block_times(spark, d)).select("stream_id", "line_no", "block_no")


@query("G4_lyrics_resumed", f"WITH {LYRICS_SQL}, sk AS (SELECT DISTINCT stream_id, 1500 AS seek_ms FROM pcm) SELECT sk.stream_id, seek_ms::BIGINT AS seek_ms, coalesce(max(line_no), 0)::INTEGER AS line_no FROM sk LEFT JOIN ln ON ln.stream_id = sk.stream_id AND ts_ms <= seek_ms GROUP BY ALL")
def lyrics_resumed(spark, d):
    seeks = many_streams(spark, d).select("stream_id").distinct().withColumn("seek_ms", F.lit(1500).cast("bigint"))
    return lyrics.resumed(_lines(spark, d), seeks)


@query("L3_event_types", "SELECT * FROM (VALUES " + ", ".join(f"({e}, '{s}')" for e, s in EVENTS) + ") v(e, s)")
def event_types(spark, d):
    return spark.createDataFrame(EVENTS, "e int, s string")


@query("L9_settings", "SELECT 2048 AS \"window\", 200 AS bars_attack, 30 AS bars_release, 10 AS peak_release, 500 AS low_hz, 1800 AS peak_hz, 6000 AS high_hz")
def settings(spark, d):
    return spark.createDataFrame([(S.window, S.vu_bars.attack, S.vu_bars.release, S.vu_peak.release, S.freq_low_hz, S.freq_peak_hz, S.freq_high_hz)], "window int, bars_attack int, bars_release int, peak_release int, low_hz int, peak_hz int, high_hz int")
