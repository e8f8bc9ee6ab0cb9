"""Queries that run Structured Streaming over the test tables or fixtures, to the end of what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions import text
from tonelake.operators import meters
from tonelake.plans import fixtures
from tonelake.plans.bindings import SAMPLE_SQL, sample, table
from tonelake.plans.settings import Settings
from tonelake.session import fresh_path
from tonelake.sources import web
from tonelake.streaming import stateful

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def run(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream until all input is read, into a table of the shared folder; returns that table."""
    spark = stream.sparkSession
    out = fresh_path(spark, name)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def from_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def from_rows(rows: DataFrame, name: str, parts: int = 2) -> DataFrame:
    """Rows as a stream of so many files, one a trigger."""
    spark = rows.sparkSession
    path = fresh_path(spark, name)
    rows.repartition(parts).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


WINDOWS = f"""WITH s AS (SELECT event_id AS frame_no, least(abs({SAMPLE_SQL}::BIGINT) >> 23, 255) AS v FROM events),
w AS (SELECT frame_no // 64 AS window_no, (sum(v)::BIGINT // count(*))::INTEGER AS left_mean, max(v)::INTEGER AS left_max FROM s GROUP BY frame_no // 64 HAVING count(*) = 64) SELECT * FROM w"""


@query("K1_stream_windows", WINDOWS)
def stream_windows(spark, d):
    pcm = from_table(spark, d, "events").select(F.lit("events").alias("stream_id"), F.col("event_id").alias("frame_no"), sample().alias("left"), sample().alias("right"))
    return run(stateful.vu_windows(pcm, 64), "windows").select("window_no", "left_mean", "left_max")


@query("K2_sliding_frames", "SELECT fft_no, count(*) AS samples FROM (SELECT event_id // 256 - k.range AS fft_no FROM events, range(2) k) WHERE fft_no >= 0 GROUP BY fft_no")
def sliding_frames(spark, d):
    from tonelake.operators import spectrum

    pcm = table(spark, d, "events").select(F.lit("events").alias("stream_id"), F.col("event_id").alias("frame_no"), sample().alias("left"), sample().alias("right"))
    return spectrum.frames(pcm).groupBy("fft_no").agg(F.count("*").alias("samples"))


@query("K7_resumed_titles", "SELECT * FROM (VALUES (10, 'StreamTitle=''one'';'), (30, 'StreamTitle=''two'';')) v(audio_pos, meta)")
def resumed_titles(spark, d):
    body = fixtures.icy(10, [b"a" * 10] * 3, [b"StreamTitle='one';", b"", b"StreamTitle='two';"])
    rows = spark.createDataFrame([("s", a, bytearray(body[a : a + 7])) for a in range(0, len(body), 7)], "stream_id string, offset long, data binary")
    return run(stateful.icy_titles(from_rows(rows, "pieces"), 10), "titles").select("audio_pos", "meta")


@query("K8_state_per_stream", "SELECT * FROM (VALUES ('a', 0, 10), ('b', 0, 20)) v(stream_id, window_no, left_mean)")
def state_per_stream(spark, d):
    rows = spark.createDataFrame([(s, i, v << 23, 0) for s, v in (("a", 10), ("b", 20)) for i in range(8)], "stream_id string, frame_no long, left int, right int")
    return run(stateful.vu_windows(from_rows(rows, "two"), 8), "states").select("stream_id", "window_no", "left_mean")


@query("A27_stream_fresh", "SELECT * FROM (VALUES (0, 'a'), (0, 'b'), (1, 'c')) v(fetch_no, url)")
def stream_fresh(spark, d):
    rows = [("p", n, i, u) for n, of in enumerate((["a", "b"], ["a", "b", "c"])) for i, u in enumerate(of)]
    stream = from_rows(spark.createDataFrame(rows, "playlist_id string, fetch_no long, line_no int, url string"), "fetches", 1)
    return run(stateful.fresh_segments(stream), "fresh").select("fetch_no", "url")


@query("K5_bounded_trigger", "SELECT 4 AS triggers, count(*) AS n FROM events")
def bounded_trigger(spark, d):
    """The table as four files, of which a trigger admits one: how many triggers had rows, and all rows."""
    out = fresh_path(spark, "bounded")
    stream = from_rows(table(spark, d, "events").select("event_id"), "bounded", 4)
    asked = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    asked.awaitTermination()
    triggers = sum(p["numInputRows"] > 0 for p in asked.recentProgress)
    return spark.read.schema(stream.schema).parquet(out).agg(F.lit(triggers).alias("triggers"), F.count("*").alias("n"))


@query("A10_chunked_titles", "SELECT * FROM (VALUES (8, 'aaa.....', 'StreamTitle=''x'';'), (16, 'bbb.....', NULL)) v(audio_pos, audio, meta)")
def chunked_titles(spark, d):
    body = fixtures.icy(8, [b"aaa", b"bbb"], [b"StreamTitle='x';", b""])
    rows = spark.createDataFrame([("c", bytearray(fixtures.chunked([body[:5], body[5:20], body[20:]])))], "stream_id string, content binary")
    return web.chunked_titles(rows, 8).select("audio_pos", F.decode("audio", "UTF-8").alias("audio"), "meta")


@query("A3_playable", "SELECT * FROM (VALUES ('http://h/a.m4s', FALSE), ('http://h/a.m4s?x', FALSE), ('http://h/a.ts', TRUE), ('http:', FALSE)) v(url, ok)")
def playable(spark, d):
    return spark.createDataFrame([("http://h/a.m4s",), ("http://h/a.m4s?x",), ("http://h/a.ts",), ("http:",)], "url string").select("url", web.playable(F.col("url")).alias("ok"))


@query("E7_profile", "SELECT count(*) AS runs, round(avg(value), 6) AS mean, max(value) AS most FROM events")
def profile(spark, d):
    """Mean and largest of a measure, as an aggregate over runs."""
    return table(spark, d, "events").agg(F.count("*").alias("runs"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))


@query("I11_is_utf8", "SELECT * FROM (VALUES ('616263', TRUE), ('C3A9', TRUE), ('E9', FALSE), ('C0AF', FALSE), ('', TRUE)) v(h, ok)")
def is_utf8(spark, d):
    return spark.createDataFrame([("616263",), ("C3A9",), ("E9",), ("C0AF",), ("",)], "h string").select("h", F.is_valid_utf8(F.unhex("h").cast("string")).alias("ok"))


@query("I23_trim_min", "SELECT event_id, trim('  ' || event_type || ' ') AS t, least(event_id, user_id, 77) AS least3 FROM events")
def trim_min(spark, d):
    return table(spark, d, "events").select("event_id", text.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("t"), F.least(F.col("event_id"), F.col("user_id"), F.lit(77)).alias("least3"))


@query("I26_math", "SELECT event_id, CASE WHEN value > 0 THEN round(20 * log10(CASE WHEN value > 0 THEN value END), 6) END AS db, round(pow(10, value / 1000), 6) AS p, event_id >> 3 AS s FROM events")
def math(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(20 * F.log10(F.when(v > 0, v)), 6).alias("db"), F.round(F.pow(F.lit(10.0), v / 1000), 6).alias("p"), F.shiftright("event_id", 3).alias("s"))


@query("I27_fifo", "SELECT user_id, event_id, lag(event_id, 2, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS popped FROM events")
def fifo(spark, d):
    return meters.delayed(table(spark, d, "events").select("user_id", "event_id"), "event_id", 2, ("user_id",), "event_id", "popped")


@query("G6_segment_dedup", "SELECT event_id FROM events WHERE event_id > coalesce((SELECT max(event_id) FROM events WHERE event_type = 'click'), -1)")
def segment_dedup(spark, d):
    from tonelake.sources import playlists

    rows = table(spark, d, "events").select(F.lit("p").alias("playlist_id"), F.col("event_id").alias("line_no"), F.col("event_type").alias("url"))
    last = spark.createDataFrame([("p", "click")], "playlist_id string, last_url string")
    return playlists.fresh(rows, last).select(F.col("line_no").alias("event_id"))


@query("L1_sample_table", "SELECT event_id AS frame_no, " + SAMPLE_SQL + " AS l FROM events")
def sample_table(spark, d):
    """Samples written as a table stand for output hardware."""
    from tonelake.sources import sinks

    pcm = table(spark, d, "events").select(F.lit("e").alias("stream_id"), F.col("event_id").alias("frame_no"), sample().alias("left"), sample().alias("right"))
    path = fresh_path(spark, "pcm")
    sinks.write_table(pcm, path)
    return spark.read.parquet(path).select("frame_no", F.col("left").alias("l"))


@query("L7_recorded_wav", "SELECT 'e' AS stream_id, count(*) AS frames FROM events")
def recorded_wav(spark, d):
    from tonelake.sources import sinks

    pcm = table(spark, d, "events").select(F.lit("e").alias("stream_id"), F.col("event_id").alias("frame_no"), sample().alias("left"), sample().alias("right"))
    return sinks.record_wav(pcm, fresh_path(spark, "wav"), 44_100).select("stream_id", "frames")


@query("L9_checked_settings", "SELECT 2048 AS frames, 21 AS volume")
def checked_settings(spark, d):
    s = Settings().checked()
    return spark.createDataFrame([(s.window, s.volume)], "frames int, volume int")
