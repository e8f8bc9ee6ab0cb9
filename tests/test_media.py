"""Binary formats: round trips through built files, broken input, sinks and the HTTP source."""

import http.server
import threading
import time

import pytest

from tonelake.operators import running
from tonelake.plans import fixtures
from tonelake.sources import containers, decoders, files, sinks
from tonelake.sources import http as media_http


def table(spark, items, key="path"):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in items.items()], f"{key} string, content binary")


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
@pytest.mark.parametrize("channels", [1, 2])
def test_wav_round_trip(spark, bits, channels):
    raw = [tuple((i * 37 + c * 11) % (1 << bits - 1) for c in range(channels)) for i in range(33)]
    got = files.wav_samples(table(spark, {"w": fixtures.wav(raw, bits)})).orderBy("frame_no").collect()
    want = [tuple((v - 128 << 24) if bits == 8 else v << 32 - bits for v in (f if channels == 2 else f * 2)) for f in raw]
    assert [(r.left, r.right) for r in got] == want


def test_broken_files_give_no_rows(spark):
    junk = {"empty": b"", "short": b"RIFF", "text": b"hello" * 100, "cut": fixtures.m4a()[:40], "flac": b"fLaC\x80"}
    t = table(spark, junk)
    assert files.wav_samples(t).count() == 0
    assert containers.id3_frames(t).count() == 0
    assert containers.ogg_packets(t).count() == 0
    assert containers.flac_stream_info(t).count() == 0
    assert containers.mp3_frame_rows(t).count() == 0
    assert files.ts_audio(files.ts_packets(t.withColumnRenamed("path", "stream_id"))).count() == 0
    assert containers.m4a_info(t).where("valid").count() == 0


@pytest.mark.parametrize("kind", ["verbatim", "fixed2", "lpc"])
@pytest.mark.parametrize("code", [1, 8, 9, 10])
def test_flac_frame(kind, code):
    left, right = [i * i % 113 - 50 for i in range(64)], [i * 7 % 101 - 60 for i in range(64)]
    a, b = decoders.decode_frame(fixtures.flac_frame(3, left, right, kind, code), 16)
    assert (a >> 16).tolist() == left and (b >> 16).tolist() == right


def test_flac_skips_a_damaged_frame(spark):
    frames = [fixtures.flac_frame(k, [k] * 20, [k] * 20, "verbatim", 1) for k in range(4)]
    frames[1] = frames[1][:-30]
    got = decoders.flac_pcm(table(spark, {"f": fixtures.flac(frames, 80, [])}))
    assert got.count() == 60 and got.agg({"frame_no": "max"}).first()[0] == 59


def test_wav_sink_reads_back(spark, tmp_path):
    rows = [("a", i, i << 16, -i << 16) for i in range(300)] + [("b", i, 5 << 16, 6 << 16) for i in range(7)]
    pcm = spark.createDataFrame(rows, "stream_id string, frame_no long, left int, right int")
    made = {r.stream_id: r for r in sinks.record_wav(pcm, f"file://{tmp_path}/rec", 8000).collect()}
    assert made["a"].frames == 300 and made["b"].frames == 7
    back = files.wav_samples(table(spark, {k: open(r.path.removeprefix("file://"), "rb").read() for k, r in made.items()}))
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_media_folder(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.wav").write_bytes(fixtures.wav([(1,)], 16))
    (tmp_path / "b.mp3").write_bytes(fixtures.mp3(3))
    got = {r.path.rsplit("/", 1)[1]: r.codec for r in files.media_files(spark, str(tmp_path)).collect()}
    assert got == {"a.wav": "WAV", "b.mp3": "MP3"}
    info = containers.mp3_info(files.media_files(spark, str(tmp_path), "*.mp3")).first()
    assert info.frames == 3 and info.bitrate // 1000 == 127


def test_cut_before_target(spark):
    frames = spark.createDataFrame([("s", 0), ("s", 10), ("s", 30)], "stream_id string, offset long")
    targets = spark.createDataFrame([("s", 0), ("s", 11), ("s", 31)], "stream_id string, target long")
    assert {r.target: r.offset for r in running.next_frame(frames, targets).collect()} == {0: 0, 11: 30, 31: None}


@pytest.fixture
def server():
    """Serves /whole without ranges, and /part with them; the first request for a part breaks off."""
    data, asked = bytes(range(256)) * 40, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def _head(self, status, n):
            self.send_response(status)
            self.send_header("Content-Length", str(n))
            if self.path != "/whole":
                self.send_header("Accept-Ranges", "bytes")
            self.end_headers()

        def do_HEAD(self):
            self._head(200, len(data))

        def do_GET(self):
            asked.append((self.path, self.headers["Range"]))
            first, last = self.headers["Range"].removeprefix("bytes=").split("-")
            if self.path == "/whole":
                self._head(200, len(data))
                self.wfile.write(data)
                return
            part = data[int(first) : int(last or len(data)) + 1]
            self._head(206, len(part))
            self.wfile.write(part[:100] if len(asked) == 1 else part)

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", data
    s.shutdown()


def joined(rows):
    return b"".join(bytes(r.data) for r in sorted(rows, key=lambda r: r.offset))


def test_http_ranges_and_retry(spark, server):
    url, data = server
    media_http.register(spark)
    all_rows = spark.read.format("media_http").option("urls", f"{url}/part").option("split", "3000").load().collect()
    assert joined(all_rows) == data
    some = spark.read.format("media_http").option("urls", f"{url}/part").option("offset", "100").option("length", "50").load().collect()
    assert joined(some) == data[100:150]
    whole = spark.read.format("media_http").option("urls", f"{url}/whole").option("offset", "7").load().collect()
    assert joined(whole) == data[7:]


def test_http_stream(spark, server):
    url, data = server
    media_http.register(spark)
    rows = spark.readStream.format("media_http").option("urls", f"{url}/part").option("split", "4000").load()
    q = rows.writeStream.format("memory").queryName("http_rows").start()
    try:
        for _ in range(60):
            rows = spark.sql("SELECT * FROM http_rows").collect()
            if sum(len(r.data) for r in rows) >= len(data):
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert joined(rows) == data


def test_hls_over_http(spark):
    """Variants, then segments in MPEG-TS and raw, fetched and unframed in order."""
    from tonelake.sources import web

    parts = {
        "/live/master.m3u8": b'#EXTM3U\n#EXT-X-STREAM-INF:CODECS="mp4a.40.5"\nlow.m3u8\n#EXT-X-STREAM-INF:CODECS="mp4a.40.2"\nhigh.m3u8\n',
        "/live/high.m3u8": b"#EXTM3U\n#EXTINF:4,a\n0.ts\n#EXTINF:4,b\n1.ts\n#EXTINF:4,c\n/raw/2.aac\n",
        "/live/0.ts": fixtures.transport_stream([b"old"]), "/live/1.ts": fixtures.transport_stream([b"x" * 150, b"y" * 20]), "/raw/2.aac": b"raw bytes",
    }

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_HEAD(self):
            self.send_response(200)
            self.send_header("Content-Length", str(len(parts[self.path])))
            self.end_headers()

        def do_GET(self):
            self.do_HEAD()
            self.wfile.write(parts[self.path])

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{s.server_port}"
    try:
        segments = web.hls_segments(spark, f"{root}/live/master.m3u8", last_url=f"{root}/live/0.ts")
        assert [r.url for r in segments.orderBy("line_no").collect()] == [f"{root}/live/1.ts", f"{root}/raw/2.aac"]
        data = [bytes(r.data) for r in web.hls_audio(spark, segments).orderBy("line_no", "packet_no").collect()]
        assert data == [b"x" * 150, b"y" * 20, b"raw bytes"]
        assert web.web_file(spark, f"{root}/raw/2.aac").first().content == b"raw bytes"
    finally:
        s.shutdown()


def test_flac_header_inside_a_frame(spark):
    fake = fixtures.flac_frame(1, [5] * 40, [5] * 40, "verbatim", 1)
    x = [int.from_bytes(fake[i : i + 2], "big", signed=True) for i in range(0, 40, 2)] + [7] * 20  # its header stands among the samples
    frames = [fixtures.flac_frame(k, own, own, "verbatim", 1) for k, own in enumerate((x, [9] * 40, x))]
    got = decoders.flac_pcm(table(spark, {"f": fixtures.flac(frames, 120, [])})).orderBy("frame_no").collect()
    assert [r.left >> 16 for r in got] == x + [9] * 40 + x


def test_parsers_hold_few_files_at_a_time(spark):
    """A batch of 1,000 files is made and parsed in slices."""
    import pyarrow as pa

    from tonelake.plans.table_media import built

    class Caught:  # gives the function itself
        sparkSession, columns, schema = spark, ["path", "k"], spark.createDataFrame([], "path string, k long").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            return run

    keys = pa.array([str(i) for i in range(1000)])
    made = list(built(Caught(), lambda k: bytes(k % 7))(iter([pa.RecordBatch.from_arrays([keys, pa.array(range(1000))], ["path", "k"])])))
    rows = list(containers.parsed(Caught(), lambda b: iter([(1,)]), "n int")(iter([pa.RecordBatch.from_arrays([keys, pa.array([b"x"] * 1000)], ["path", "content"])])))
    for of in (made, rows):
        assert max(map(len, of)) <= 128 and sum(map(len, of)) == 1000


@pytest.mark.parametrize("read", [containers.m4a_info, containers.m4a_tags, containers.m4a_sample_sizes, containers.mp3_info])
def test_whole_files_are_neither_shuffled_nor_joined(spark, read):
    """Each file is read once, and what leaves a parser is small; without sample sizes there are no samples."""
    made = table(spark, {"m": fixtures.m4a(), "p": fixtures.mp3(3), "cut": fixtures.m4a()[:40]})
    plan = read(made)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "content" not in plan.split("MapInArrow")[0]
    assert read(made).count() > 0
