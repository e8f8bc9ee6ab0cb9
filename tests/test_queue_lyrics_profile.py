"""Bounded queues against a model, lyrics in streams against batch, and figures of runs."""

import random

import pytest
from pyspark.sql import functions as F
from tests_support import run_stream  # noqa: I001
from tonelake.operators import lyrics, queueing
from tonelake.plans import profile
from tonelake.streaming import stateful


def model(arrivals, limit, drain):
    waiting, out = 0, []
    for a in arrivals:
        taken = min(a, limit - waiting)
        drained = min(drain, waiting + taken)
        waiting += taken - drained
        out.append((taken, a - taken, drained, waiting))
    return out


@pytest.mark.parametrize("limit, drain", [(10, 3), (1, 1), (1000, 0), (7, 20)])
def test_queue_by_chunks_equals_the_model(spark, limit, drain):
    rng = random.Random(limit)
    arrivals = {s: [rng.choice([0, 0, 1, 2, 5, 30]) for _ in range(300)] for s in "ab"}
    rows = [(s, t, a if a else None) for s, of in arrivals.items() for t, a in enumerate(of)]
    got = queueing.queued(spark.createDataFrame(rows, "stream_id string, tick long, arrivals int").repartition(3), limit, drain, 40).orderBy("stream_id", "tick").collect()
    assert [(r.taken, r.dropped, r.drained, r.waiting) for r in got] == [x for s in "ab" for x in model(arrivals[s], limit, drain)]


@pytest.mark.parametrize("limit, drain, chunk", [(10, 3, 40), (1, 1, 7), (1000, 0, 5000), (7, 20, None), (50, 1, None)])
def test_queue_over_ticks_without_rows_equals_the_model(spark, limit, drain, chunk):
    rng = random.Random(limit)
    last = 9000  # gaps beyond a block of ticks as well
    arrivals = {s: {rng.randrange(span): rng.choice([1, 2, 5, 30]) for _ in range(80)} for s, span in (("a", 200), ("b", 9001), ("c", 4100))} | {"d": {}}
    rows = [(s, t, a) for s, of in arrivals.items() for t, a in of.items()] + [("d", None, 1), ("d", -3, 1), ("d", last + 1, 1), ("a", 5, None)]
    made = queueing.queued_throughout(spark.createDataFrame(rows, "stream_id string, tick long, arrivals int").repartition(3), last, limit, drain, chunk)
    got = made.orderBy("stream_id", "tick").collect()
    full = {s: [of.get(t, 0) for t in range(last + 1)] for s, of in arrivals.items()}
    assert [(r.stream_id, r.tick, r.arrivals) for r in got] == [(s, t, a) for s, of in full.items() for t, a in enumerate(of)]
    assert [(r.taken, r.dropped, r.drained, r.waiting) for r in got] == [x for of in full.values() for x in model(of, limit, drain)]


def test_bounded_queue_makes_no_row_of_a_tick_before_the_queue_has_run(spark, sf_dir):
    """Python and its shuffles get a row per event and stream; ticks between are added behind them."""
    from tonelake.plans import catalog

    shape = catalog.QUERIES["H4_bounded_queue"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in shape and shape.rindex("Generate") < shape.index("CoGroup")


def test_rows_of_all_ticks_take_little_disk_and_even_tasks(spark, tmp_path):
    """Two bytes a row and more where every file holds all ticks: streams share stretches of ticks, which are named once."""
    streams, last = 60, 30_000
    rows = spark.createDataFrame([(f"s{i}", (i * 7919 + k * 104_729) % (last + 1), 2) for i in range(streams) for k in range(5)], "stream_id string, tick long, arrivals int")
    queueing.queued_throughout(rows, last, 3, 1).write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 0.6 * streams * (last + 1)
    counts = [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy(F.input_file_name()).count().collect()]
    assert sum(counts) == streams * (last + 1) and len(counts) == 4 and max(counts) < 1.5 * sum(counts) / 4


def test_queue_without_ticks(spark):
    assert queueing.queued_throughout(spark.createDataFrame([("a", None, None)], "stream_id string, tick long, arrivals int"), -1).count() == 0


def test_queue_over_triggers(spark, tmp_path):
    batches = [[("s", i, 13, f"e{i}") for i in range(7)], [("s", i, 13, f"e{i}") for i in range(7, 8)], [("s", i, None, None) for i in range(8, 20)], [("t", 0, 1, "x")]]
    got = run_stream(spark, tmp_path, "queue", batches, "stream_id string, seq long, e int, s string", lambda s: stateful.event_queue(s, 5, 2))
    want, waiting, dropped = [], [], 0
    for batch in batches[:3]:
        room = 5 - len(waiting)
        waiting, dropped = waiting + batch[:room], dropped + max(0, len(batch) - room)
        want += [(*r, dropped) for r in waiting[:2]]
        waiting = waiting[2:]
    assert sorted(map(tuple, got)) == sorted([*want, ("t", 0, 1, "x", 0)])


def test_lyrics_in_triggers_equal_batch(spark, tmp_path):
    rng = random.Random(2)
    lines = [(s, i, 700 * i + rng.randint(0, 500), f"{s}{i}") for s in "ab" for i in range(40)]
    blocks = [(s, k, (k + 1) * 1000, False) for s in "ab" for k in range(30)]
    song = spark.createDataFrame(lines, "stream_id string, line_no int, ts_ms long, text string")
    schema = "stream_id string, block_no long, time_ms long, seek boolean"
    want = lyrics.due(song, spark.createDataFrame(blocks, schema)).where("block_no IS NOT NULL").collect()
    cuts = sorted(rng.sample(range(1, 30), 3))
    batches = [[b for b in blocks if lo <= b[1] < hi] for lo, hi in zip([0, *cuts], [*cuts, 30])]
    got = run_stream(spark, tmp_path, "lyrics", batches, schema, lambda s: stateful.lyrics_due(s, song))
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 60


def test_lyrics_after_a_seek(spark, tmp_path):
    song = spark.createDataFrame([("s", i, 1000 * i, str(i)) for i in range(6)], "stream_id string, line_no int, ts_ms long, text string")
    batches = [[("s", 0, 3500, False)], [("s", 1, 1200, True), ("s", 2, 2500, False)], [("s", 3, 100, True)], [("s", 4, 9000, True)]]
    got = run_stream(spark, tmp_path, "lyrics_seek", batches, "stream_id string, block_no long, time_ms long, seek boolean", lambda s: stateful.lyrics_due(s, song))
    assert sorted((r.block_no, r.line_no) for r in got) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]


def test_profile_of_a_query(spark):
    df = spark.range(1000).where("id % 3 = 0")
    r = profile.profiled("thirds", df, 4).first()
    assert (r.name, r.runs, r["rows"]) == ("thirds", 4, 334) and 0 < r.mean_us <= r.max_us


def test_profile_of_triggers(spark, tmp_path):
    listener = profile.TriggerProfile(2)
    listener.add("q", 5, 100)
    listener.add("q", 7, 300)
    listener.add("q", 1, 1)
    assert listener.lines == [("q", 2, 12, 200, 300)] and listener.table(spark).first().max_us == 300
    spark.streams.addListener(listener)
    try:
        run_stream(spark, tmp_path, "profiled_stream", [[(1,)], [(2,)], [(3,)], [(4,)]], "x int", lambda s: s.where("x > 0"))
        for _ in range(50):
            if sum(line[0] == "profiled_stream" for line in listener.lines) == 2:
                break
            __import__("time").sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    own = [line for line in listener.lines if line[0] == "profiled_stream"]
    assert [line[1:3] for line in own] == [(2, 2), (2, 2)] and all(0 < line[3] <= line[4] for line in own)


def test_entities_in_one_pass(spark):
    from tonelake.functions import text

    cases = {"&amp;lt;": "&lt;", "&amp;#65;": "&#65;", "&#38;amp;": "&amp;", "&l&#116;;": "&lt;", "&a&#109;p;": "&amp;", "&#65;&lt;&#0;&#55296;&#12345678;": "A<&#0;&#55296;&#12345678;", "&&gt;&#322;&#128512;": "&>ł😀", "": "", "x": "x"}
    rows = spark.createDataFrame(list(cases.items()), "s string, want string")
    assert [r.got for r in rows.select(text.html_to_utf8(F.col("s")).alias("got")).collect()] == list(cases.values())


def test_entities_are_cheap(spark):
    """In one task 60,000 texts with entities take a fraction of the 30 seconds and more that an array of pieces for each took."""
    import time

    from tonelake.functions import text

    s = F.concat(F.lit("&lt;b&gt;"), F.col("id").cast("string"), F.lit("&lt;/b&gt; &amp; &#65; &nope; &"))
    began = time.perf_counter()
    spark.range(0, 60_000, 1, 1).select(text.html_to_utf8(s).alias("s")).write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - began < 15


def test_titles_resolve_entities_once(spark):
    from tonelake.operators import titles

    meta = spark.createDataFrame([("a", 0, "StreamTitle='&lt;x';"), ("a", 1, None), ("a", 2, "StreamTitle='&lt;x';"), ("a", 3, "StreamTitle='y';")], "stream_id string, seq int, meta string")
    found = titles.stream_titles(meta)
    assert [(r.seq, r.title) for r in found.orderBy("seq").collect()] == [(0, "<x"), (3, "y")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("&euro;") <= 4
