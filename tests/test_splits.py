"""The splittable source: frames of small ranges against one pass over the whole file."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tonelake.plans import fixtures
from tonelake.sources import containers, decoders, splits


def ogg_stream(rng, pages):
    out = b""
    for k in range(pages):
        page = bytearray(fixtures.ogg_page(k, 2 if k == 0 else 4 if k == pages - 1 else 0, k * 960, [rng.randbytes(rng.randint(0, 900)) for _ in range(3)]))
        page[22:26] = containers.page_crc(bytes(page)).to_bytes(4, "little")
        out += bytes(page)
    return out


def adts(n, rng):
    body = rng.randbytes(n)
    size = n + 7
    return bytes([0xFF, 0xF1, 0x50, 0x80 | size >> 11, size >> 3 & 255, (size & 7) << 5 | 0x1F, 0xFC]) + body


def files(rng):
    pcm = [(rng.randint(-30000, 30000), rng.randint(-30000, 30000)) for _ in range(20_000)]
    frames = [fixtures.flac_frame(k, [rng.randint(-99, 99) for _ in range(64)], [rng.randint(-3000, 3000) for _ in range(64)], "fixed2", 8) for k in range(100)]
    head = b"\xff\xfb\x90\x00"
    mp3 = b"".join(head + rng.randbytes(413) for _ in range(200))
    return {
        "a.wav": fixtures.wav(pcm, 16, extra=b"xx"), "b.flac": fixtures.flac(frames, 6400, ["TITLE=x"], rng.randbytes(5000)), "c.ogg": ogg_stream(rng, 120),
        "d.ts": fixtures.transport_stream([rng.randbytes(150) for _ in range(300)]), "e.mp3": b"ID3\x03\0\0\0\0\0\x05hello" + mp3, "f.aac": b"".join(adts(rng.randint(20, 400), rng) for _ in range(200)), "g.txt": b"no media", "h.wav": b"",
    }


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("frames")
    for name, content in files(random.Random(2)).items():
        (path / name).write_bytes(content)
    return path


@pytest.mark.parametrize("split", [997, 10_000])
def test_splits_find_the_frames_of_one_pass(spark, folder, split):
    whole = sorted(map(tuple, splits.media_frames(spark, str(folder), 1 << 30).collect()))
    df = splits.media_frames(spark, str(folder), split)
    assert df.rdd.getNumPartitions() > 100_000 // split
    assert sorted(map(tuple, df.collect())) == whole
    counts = {k: sum(r[1] == k for r in whole) for k in splits.KINDS}
    assert counts == {"wav": 5, "flac": 100, "ogg": 120, "ts": 303, "mp3": 200, "adts": 200}
    content = {n: c for n, c in files(random.Random(2)).items()}
    assert all(content[path.rsplit("/", 1)[1]][at : at + len(data)] == data for path, _, at, data in whole)


def test_kind_may_be_said_and_junk_is_skipped(spark, tmp_path):
    rng = random.Random(6)
    body = b"".join(b"\xff\xfb\x90\x00" + rng.randbytes(413) for _ in range(30))
    (tmp_path / "stream").write_bytes(b"junk\xff\xfb\x90\x00 more" + body + b"\xff\xff tail")
    assert splits.media_frames(spark, str(tmp_path / "stream")).count() == 0
    got = splits.media_frames(spark, f"file://{tmp_path}/stream", 1000, "mp3").orderBy("offset").collect()
    assert [r.offset for r in got] == [13 + 417 * k for k in range(30)]
    with pytest.raises(Exception, match="kind"):
        splits.media_frames(spark, str(tmp_path), kind="midi").count()


def test_wav_pcm_by_blocks(spark, tmp_path):
    rng = random.Random(3)
    for bits, ch in ((8, 1), (16, 2), (24, 1), (32, 2)):
        low, high = (0, 255) if bits == 8 else (-(1 << bits - 1), (1 << bits - 1) - 1)
        samples = [tuple(rng.randint(low, high) for _ in range(ch)) for _ in range(10_000)]
        (tmp_path / f"{bits}.wav").write_bytes(fixtures.wav(samples, bits))
        rows = splits.wav_pcm(splits.media_frames(spark, str(tmp_path / f"{bits}.wav"), 5000)).orderBy("frame_no").collect()
        shown = [((s[0] - 128 if bits == 8 else s[0]) << 32 - bits, (s[-1] - 128 if bits == 8 else s[-1]) << 32 - bits) for s in samples]
        assert [(r.left, r.right) for r in rows] == shown and [r.frame_no for r in rows] == list(range(10_000))


def test_flac_pcm_places_frames_by_their_headers(spark, folder, tmp_path):
    file = folder / "b.flac"
    files_df = spark.createDataFrame([(str(file), bytearray(file.read_bytes()))], "path string, content binary")
    want = sorted(tuple(r)[1:] for r in decoders.flac_pcm(files_df).collect())
    got = splits.flac_pcm(splits.media_frames(spark, str(file), 3000))
    assert sorted(tuple(r)[1:] for r in got.collect()) == want and len(want) == 6400
    b = file.read_bytes()
    frames = splits.media_frames(spark, str(file)).orderBy("offset").collect()
    (tmp_path / "lost.flac").write_bytes(b.replace(frames[10].data, b""))
    lost = {r.frame_no for r in splits.flac_pcm(splits.media_frames(spark, str(tmp_path / "lost.flac"))).collect()}
    assert lost == set(range(6400)) - set(range(576, 704)) or lost == set(range(6400)) - set(range(640, 704))


def test_page_crc():
    def plain(data):
        crc = 0
        for x in data:
            crc ^= x << 24
            for _ in range(8):
                crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
        return crc

    for n in (0, 1, 5, 300):
        data = random.Random(n).randbytes(n)
        assert containers.page_crc(data) == plain(data)


def test_one_large_file_of_events_takes_many_tasks(spark, sf_dir, tmp_path):
    """200 MB of samples made of the events table, in ranges of 16 MB."""
    values = [int(r.value * 100) % 65536 - 32768 for r in spark.read.parquet(f"{sf_dir}/events.parquet").select("value").collect()]
    once = struct.pack(f"<{len(values)}h", *values)
    times = -(-(200 << 20) // len(once))
    data = len(once) * times
    with open(tmp_path / "large.wav", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 36 + data) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16_000, 2, 16) + b"data" + struct.pack("<I", data))
        for _ in range(times):
            f.write(once)
    df = splits.media_frames(spark, str(tmp_path / "large.wav"))
    assert df.rdd.getNumPartitions() >= 8
    by_task = df.select(F.octet_length("data").alias("b"), F.spark_partition_id().alias("task")).groupBy("task").agg(F.count("*").alias("n"), F.sum("b").alias("bytes"))
    got = by_task.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("tasks")).first()
    assert (got.n, got.bytes) == (-(-data // (2 * splits.BLOCK)), data) and got.tasks >= 8
