"""Live playlists over a local server: growth, restarts, servers that fail; and seeking by few reads."""

import http.server
import random
import struct
import threading
import time

import pytest
from pyspark.sql import functions as F

from tonelake.plans import fixtures
from tonelake.sources import containers, live, seeking, splits


class Station(http.server.BaseHTTPRequestHandler):
    first, count, window, down = 0, 3, 4, 0

    def do_GET(self):
        own = type(self)
        if own.down > 0:
            own.down -= 1
            self.send_error(503)
            return
        if self.path == "/live/master.m3u8":
            body = b'#EXTM3U\n#EXT-X-STREAM-INF:CODECS="mp4a.40.5"\nlow.m3u8\n#EXT-X-STREAM-INF:CODECS="mp4a.40.2"\nhigh.m3u8\n'
        elif self.path == "/live/high.m3u8":
            start = max(0, own.count - own.window)
            body = (f"#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:{start}\n" + "".join(f"#EXTINF:4,{i}\n{i}.ts\n" for i in range(start, own.count))).encode()
        else:
            i = int(self.path.removeprefix("/live/").removesuffix(".ts"))
            body = fixtures.transport_stream([b"part %d" % i, b"x" * 150]) if i % 3 else b"raw %d" % i
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


@pytest.fixture
def station():
    kind = type("Own", (Station,), {})
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), kind)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield kind, f"http://127.0.0.1:{server.server_port}/live/master.m3u8"
    server.shutdown()


def test_growing_playlist_with_a_restart(spark, tmp_path, station):
    kind, url = station

    def start():
        stream = live.live_segments(spark, url, retries="0", timeout="2")
        return stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()

    def until(n):
        for _ in range(100):
            try:
                rows = spark.read.parquet(str(tmp_path / "out")).collect()
            except Exception:
                rows = []
            if len(rows) >= n:
                return
            time.sleep(0.2)

    q = start()
    until(3)
    kind.count, kind.down = 5, 4
    until(5)
    q.stop()
    kind.count = 8
    q = start()
    until(8)
    kind.count = 11
    until(11)
    time.sleep(0.6)
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()
    assert [(r.seq, r.url.rsplit("/", 1)[1], r.extinf) for r in got] == [(i, f"{i}.ts", f"#EXTINF:4,{i}") for i in range(11)]


def test_a_batch_is_read_from_its_offset_once_the_window_has_moved(station):
    kind, url = station
    reader = live.Reader({"url": url, "retries": "0"})
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    kind.count = 50
    again = live.Reader({"url": url}).readBetweenOffsets(reader.initialOffset(), end)
    assert list(again) == rows and [r[1] for r in rows] == [0, 1, 2]
    after, last = reader.read(end)
    assert [r[1] for r in after] == [46, 47, 48, 49]
    kind.down = 99
    assert reader.read(last)[1] == last and list(reader.read(last)[0]) == []


def test_audio_of_segments(spark, station):
    _, url = station
    base = url.rsplit("/", 1)[0]
    rows = spark.createDataFrame([("p", i, f"{base}/{i}.ts") for i in range(3)] + [("p", 9, "http://127.0.0.1:1/x.ts")], "playlist_id string, seq long, url string")
    got = live.segment_audio(live.fetched(rows, 0, 2)).orderBy("seq", "packet_no").collect()
    assert [(r.seq, bytes(r.data)) for r in got] == [(0, b"raw 0"), (1, b"part 1"), (1, b"x" * 150), (2, b"part 2"), (2, b"x" * 150)]


def test_variants_and_segments():
    assert live.best_variant("#EXTM3U\n#EXT-X-STREAM-INF:B=1\na.m3u8\n#EXT-X-STREAM-INF:B=2\nb.m3u8", "http://h/l/x.m3u8") == "http://h/l/b.m3u8"
    assert live.best_variant("#EXTM3U\n#EXTINF:1,\na.ts", "http://h/x") is None
    assert live.segments("#EXTM3U\n#EXT-X-MEDIA-SEQUENCE:7\n#EXTINF:1,a\n#EXT-X-PROGRAM-DATE-TIME:1\n/r/a.ts\n#EXTINF:1,b\nb.m4s", "http://h/l/x") == [(7, "#EXTINF:1,a", "http://h/r/a.ts")]
    found = [(i, "", u) for i, u in enumerate("abcab")]
    assert live.fresh(found, "b") == [] and live.fresh(found, "a") == [(4, "", "b")] and live.fresh(found, "z") == found


@pytest.fixture(scope="module")
def large(tmp_path_factory):
    rng, path = random.Random(4), tmp_path_factory.mktemp("seek")
    pages, granule = [], 0
    for k in range(4000):
        granule += rng.randint(500, 20_000)
        page = bytearray(fixtures.ogg_page(k, 4 if k == 3999 else 0, granule if k % 7 else -1, [rng.randbytes(rng.randint(50, 4000))]))
        page[22:26] = containers.page_crc(bytes(page)).to_bytes(4, "little")
        pages.append(bytes(page))
    (path / "a.ogg").write_bytes(b"".join(pages))
    frames = [fixtures.flac_frame(k % 128, [rng.randint(-30_000, 30_000) for _ in range(200)], [k] * 200, "verbatim", 1) for k in range(100)]
    (path / "b.flac").write_bytes(fixtures.flac(frames, 20_000, ["A=b"]))
    (path / "c.wav").write_bytes(fixtures.wav([(i % 100,) for i in range(100_000)], 16))
    head = b"\xff\xfb\x90\x00"
    toc = bytes(min(255, int(256 * i / 100)) for i in range(100))
    xing = (head + bytes(32) + b"Xing" + struct.pack(">III", 7, 5000, 5000 * 417) + toc).ljust(417, b"\0")
    (path / "d.mp3").write_bytes(xing + (head + bytes(413)) * 4999)
    (path / "e.mp3").write_bytes((head + bytes(413)) * 2000)
    (path / "f.txt").write_bytes(b"no media")
    return path


def seeks(spark, path, rate, seconds):
    rows = spark.createDataFrame([(str(path), float(s), rate) for s in seconds], "path string, seconds double, rate int")
    return {r.seconds: r for r in seeking.seek(rows).collect()}


def test_ogg_seek_in_few_reads(spark, large):
    b = (large / "a.ogg").read_bytes()
    pages = [(at, int.from_bytes(p[6:14], "little", signed=True)) for at, p in splits.ogg(open(large / "a.ogg", "rb"), len(b), 0, len(b))]
    pages = [p for p in pages if p[1] >= 0]
    times = [0, 0.01, 1, 55.5, 300, 600, 800, pages[-1][1] / 48_000 - 0.01, 10_000]
    got = seeks(spark, large / "a.ogg", 48_000, times)
    for s in times:
        want = next((p for p in pages if p[1] > int(s * 48_000)), (None, None))
        assert (got[s].offset, got[s].sample) == want and got[s].reads <= 40, (s, got[s], want)
    assert len(b) > 7_000_000 and sum(r.reads for r in got.values()) / len(got) < 25


def test_flac_wav_and_mp3_seek(spark, large):
    frames = [at for at, _ in splits.flac(open(large / "b.flac", "rb"), (large / "b.flac").stat().st_size, 0, 1 << 30)]
    got = seeks(spark, large / "b.flac", 1000, [0, 0.1, 3.0, 7.77, 19.999, 20.0])
    for s, r in got.items():
        k = int(s * 1000) // 200
        assert (r.offset, r.sample) == ((frames[k], k * 200) if k < 100 else (None, None)), (s, r)
    start = (large / "c.wav").read_bytes().find(b"data") + 8
    got = seeks(spark, large / "c.wav", 8000, [0, 1.5, 12.4, 12.5, -3])
    assert {s: r.offset for s, r in got.items()} == {0.0: start, 1.5: start + 24_000, 12.4: start + 198_400, 12.5: None, -3.0: start}
    length = 5000 * 1152 / 44_100
    got = seeks(spark, large / "d.mp3", 44_100, [0, length / 4, length / 2, length * 2])
    assert got[0.0].offset == 0 and got[length * 2].offset is None
    for share in (4, 2):
        assert abs(got[length / share].offset - 5000 * 417 / share) < 2 * 417 + 5000 * 417 / 256 and got[length / share].offset % 417 == 0 and got[length / share].reads < 12
    got = seeks(spark, large / "e.mp3", 44_100, [10.0])
    assert got[10.0].offset % 417 == 0 and abs(got[10.0].offset - 160_000) < 417
    assert seeks(spark, large / "f.txt", 1, [1.0])[1.0].offset is None and seeks(spark, large / "none", 1, [1.0])[1.0].offset is None
