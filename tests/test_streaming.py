"""Streaming against batch: the same rows, whatever the batches."""

import time

import pytest
from pyspark.sql import functions as F

from tonelake.operators import meters
from tonelake.plans import fixtures
from tonelake.plans.settings import Envelope
from tonelake.sources import containers
from tonelake.streaming import stateful


def run(spark, tmp_path, name, batches, schema, build, mode="append"):
    """Feeds each batch as a file of its own, one per trigger; returns the rows that came out."""
    folder = tmp_path / name
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.02)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = build(source).writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_windows_equal_batch(spark, tmp_path):
    schema = "stream_id string, frame_no long, left int, right int"
    rows = [(s, i, (i * 7919 % 256) << 23 if i % 3 else -(i % 256 << 23), i << 20) for s in "ab" for i in range(50)]
    order = sorted(rows, key=lambda r: (r[1] * 31 % 17, r[0]))  # out of order, across batches too
    got = run(spark, tmp_path, "vu_stream", [order[:30], order[30:70], order[70:]], schema, lambda s: stateful.vu_windows(s, 8, Envelope(200, 30, 1)))
    batch = meters.vu_windows(spark.createDataFrame(rows, schema), 8)
    shown = meters.enveloped(batch, "left_mean", Envelope(200, 30, 1), 255).select("stream_id", "window_no", "display")
    want = batch.join(shown, ["stream_id", "window_no"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 12


def test_titles_resume_over_pieces(spark, tmp_path):
    body = fixtures.icy(10, [b"a" * 10] * 4, [b"StreamTitle='one';", b"", b"StreamTitle='two';", b"x"])
    cuts = [0, 3, 15, 16, 40, 61, len(body)]
    pieces = [("s", a, bytearray(body[a:b])) for a, b in zip(cuts, cuts[1:])]
    batches = [[pieces[1]], [pieces[0], pieces[3]], [pieces[2]], pieces[4:]]
    got = run(spark, tmp_path, "icy_stream", batches, "stream_id string, offset long, data binary", lambda s: stateful.icy_titles(s, 10))
    want = containers.icy_blocks(spark.createDataFrame([("s", bytearray(body))], "stream_id string, content binary"), 10).where("meta IS NOT NULL").select("stream_id", "audio_pos", "meta").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 3


def test_fresh_segments(spark, tmp_path):
    fetch = lambda n, urls: [("p", n, i, u) for i, u in enumerate(urls)]
    batches = [fetch(0, ["a", "b"]), fetch(1, ["a", "b", "c"]), fetch(2, ["b", "c"]), fetch(3, ["x", "y"])]
    got = run(spark, tmp_path, "hls_stream", batches, "playlist_id string, fetch_no long, line_no int, url string", stateful.fresh_segments)
    assert [(r.fetch_no, r.url) for r in sorted(got, key=lambda r: (r.fetch_no, r.line_no))] == [(0, "a"), (0, "b"), (1, "c"), (3, "x"), (3, "y")]


def test_title_changes_streaming(spark, tmp_path):
    """Per-batch transforms work on streams as they are: native expressions need no state."""
    from tonelake.operators import titles

    got = run(spark, tmp_path, "title_stream", [[("s", 0, "StreamTitle='a';")], [("s", 1, "StreamTitle='b';")]], "stream_id string, seq int, meta string", lambda s: s.select("seq", titles.title(F.col("meta")).alias("title")))
    assert sorted((r.seq, r.title) for r in got) == [(0, "a"), (1, "b")]


@pytest.mark.parametrize("lost", [2])
def test_stalls(spark, tmp_path, lost):
    folder = tmp_path / "arrivals"
    schema = "stream_id string, n_bytes long"
    spark.createDataFrame([("s", 10)], schema).write.mode("append").parquet(str(folder))
    source = spark.readStream.schema(schema).parquet(str(folder))
    q = stateful.stalls(source, 300, lost).writeStream.outputMode("append").format("memory").queryName("stall_stream").trigger(processingTime="200 milliseconds").start()
    try:
        for _ in range(100):
            rows = spark.sql("SELECT * FROM stall_stream").collect()
            if len(rows) >= 3:
                break
            time.sleep(0.3)
    finally:
        q.stop()
    assert [r.event for r in rows[:3]] == ["slow stream", "reconnect", "slow stream"]


def test_windows_go_on_past_a_lost_frame(spark, tmp_path):
    schema = "stream_id string, frame_no long, left int, right int"
    rows = [("a", i, i << 23, 0) for i in range(80) if i != 11]
    got = run(spark, tmp_path, "gap_stream", [rows[:30], rows[30:60], [*rows[60:], ("a", 11, 0, 0)]], schema, lambda s: stateful.vu_windows(s, 8, Envelope(200, 30, 1), patience=3))
    assert sorted(r.window_no for r in got) == [0, *range(2, 10)]


def lossy(lost, n=8, windows=3000, start=0):
    """Sums of windows of n frames, in order, without the lost frames, and the largest state on the way."""
    import json

    s, out, most = {"open": {}, "next": 0, "display": 0, "hold": 0}, [], 0
    for w in range(start, start + windows):
        frames = n - sum((w * n + i) in lost for i in range(n)) if not callable(lost) else n - lost(w)
        if frames:
            out += stateful.add_windows(s, [(w, [frames, 5 * frames, 0, 5, 0])], n, 16, Envelope(200, 30, 1))
        most = max(most, len(json.dumps(s)))
    return out, most, s


def test_state_is_bounded_whatever_is_lost():
    whole, size, s = lossy(lambda w: 0)
    assert [r[0] for r in whole] == list(range(3000)) and size < 200
    none, size, s = lossy(lambda w: 1)  # a frame of every window
    assert none == [] and len(s["open"]) <= 16 and size < 16 * 60
    some, size, s = lossy(lambda w: w % 3 == 0)
    assert [r[0] for r in some][:1900] == [w for w in range(3000) if w % 3][:1900] and len(s["open"]) <= 17 and size < 17 * 60
    gone, size, s = lossy(lambda w: 8 if 100 <= w < 2500 else 0)  # a long silence, then the stream goes on
    assert [r[0] for r in gone] == [*range(100), *range(2500, 3000)]
    late, _, _ = lossy(lambda w: 0, start=10**12)
    assert [r[0] for r in late][:2900] == list(range(10**12, 10**12 + 2900))


def test_early_pieces_are_bounded():
    s = {"at": 0, "rest": "", "early": {}}
    assert stateful.arrived(s, [(5, b"fgh"), (3, b"def")], 100) == (b"", False)
    rest, lost = stateful.arrived(s, [(0, b"abc"), (0, b"ab")], 100)
    assert (rest, lost, s["at"], s["early"]) == (b"abcdefgh", False, 8, {})
    s["rest"] = ""
    for k in range(200):
        rest, lost = stateful.arrived(s, [(100 + 50 * k, bytes(50))], 1000)
        if lost:
            break
    assert lost and k == 20 and s["at"] == 100 + 50 * 21 and not s["early"]


def test_titles_stop_at_a_loss_and_begin_anew(spark, tmp_path):
    body = fixtures.icy(10, [b"a" * 10] * 3, [b"StreamTitle='one';", b"", b"StreamTitle='two';"])
    batches = [[("s", 0, bytearray(body[:20]))], [("s", 25 + 30 * k, bytearray(30)) for k in range(4)], [("s", 0, bytearray(body))]]
    got = run(spark, tmp_path, "icy_lost", batches, "stream_id string, offset long, data binary", lambda s: stateful.icy_titles(s, 10, 100))
    assert sorted(r.meta for r in got) == ["StreamTitle='one';", "StreamTitle='two';"]


def test_transport_stream_cut_anywhere_equals_batch(spark, tmp_path):
    import random

    from tonelake.sources import files

    rng = random.Random(9)
    bodies = {"a": fixtures.transport_stream([rng.randbytes(rng.randint(1, 160)) for _ in range(40)]), "b": fixtures.transport_stream([b"x" * 170, b"y"])}
    packets = [bodies["a"][i : i + 188] for i in range(0, len(bodies["a"]), 188)]
    bodies["late tables"] = b"".join([packets[3], *packets[:3], *packets[4:]])  # audio before its program is told
    pieces = []
    for name, b in bodies.items():
        cuts = sorted({0, len(b), *(rng.randrange(len(b)) for _ in range(25))})
        pieces += [(name, x, bytearray(b[x:y])) for x, y in zip(cuts, cuts[1:])]
    rng.shuffle(pieces)
    batches = [pieces[k::4] for k in range(4)]
    got = run(spark, tmp_path, "ts_stream", batches, "stream_id string, offset long, data binary", stateful.ts_audio)
    whole = spark.createDataFrame([(k, bytearray(v)) for k, v in bodies.items()], "stream_id string, content binary")
    want = files.ts_audio(files.ts_packets(whole)).select("stream_id", "packet_no", "pid", "data").collect()
    plain = lambda rows: sorted((r.stream_id, r.packet_no, r.pid, bytes(r.data)) for r in rows)
    assert plain(got) == plain(want) and len(got) == 40 + 2 + 40


def test_transport_stream_goes_on_after_a_loss():
    b = fixtures.transport_stream([bytes([k]) * 100 for k in range(30)])
    ts, out = stateful.Transport(stateful.Transport.new()), []
    for x in range(0, len(b), 500):
        if x != 2500:
            rest, _ = stateful.arrived(ts.s, [(x, b[x : x + 500])], 600)
            out += ts.packets(rest)
    lost = {(2500 + k) // 188 for k in range(500)}
    assert [no for no, _, _ in out] == [n for n in range(3, 33) if n not in lost]


def test_a_state_gets_windows_and_not_frames(spark):
    rows = spark.range(0, 64_000, 1, 3).selectExpr("'s' AS stream_id", "(id * 7919) % 64000 AS frame_no", "CAST(-(id % 256) AS INT) * 8388608 AS left", "CAST(2147483647 AS INT) AS right")
    sums = stateful.window_sums(rows, 64)
    assert sums.count() == 1000
    assert tuple(sums.selectExpr("sum(n)", "sum(l)", "max(lm)", "min(rm)").first()) == (64_000, 250 * 255 * 128, 255, 255)
