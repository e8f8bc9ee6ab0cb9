"""Large media files as a splittable data source: a task per byte range, each from the first sync behind its first byte.

As lines of text belong to the split in which they start, a frame belongs to the split that holds its first byte: a task
looks for the first frame start from its first byte on, goes from frame to frame, and reads beyond its last byte to finish
the last one. What counts as a start is checked so that a split finds the same frames as one pass over the file:

* WAV: places of samples by arithmetic from the chunks at the file's head; a row is a block of ``BLOCK`` frames.
* MPEG-TS: places of packets by arithmetic from the first three sync bytes in a row of the file.
* Ogg: a page whose checksum agrees. FLAC: a header with its CRC-8 and a body up to the next header with its CRC-16.
* MP3 and ADTS: ``AGREE`` headers in a row, each where the one before says and alike in what can't change within a stream,
  looked for from 64 KB before the range on.

Registered with ``register``, then ``spark.read.format("media_frames").option("path", ..)``: rows (path, kind, offset,
data), data being a WAV block, a packet, page or frame whole. ``path`` is a file or folder, several apart by spaces;
``split`` the bytes of a range (16 MB); ``kind`` says what files hold where neither content nor name does. Files are opened
by pyarrow's file systems (local, HDFS, object stores) and never whole: a task holds a range and what its last frame needs.
An empty file, and one of no known kind, gives no rows; junk between frames is skipped, a cut-off last frame left out.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tonelake.session import ready
from tonelake.sources import containers, decoders

SPLIT = 16 << 20
#: Frames in a row of WAV samples, and headers that must agree where an MP3 or ADTS split begins.
BLOCK, AGREE = 4096, 4
#: Bytes read at a time, and beyond a range's end; the furthest place of a WAV file's samples.
STEP, MORE, MOST = 1 << 16, 1 << 16, 64 << 20
HEAD = 1 << 16
NAMES = {"wav": "wav", "flac": "flac", "mp3": "mp3", "aac": "adts", "adts": "adts", "ogg": "ogg", "oga": "ogg", "opus": "ogg", "ts": "ts"}


class Window:
    """Bytes of a file from a place on, read as far as they are asked for: a range in all, in steps."""

    def __init__(self, file, first: int, size: int) -> None:
        self.file, self.first, self.size = file, first, size
        self.data = b""

    def upto(self, end: int) -> bytes:
        """What there is from ``first`` to ``end``, ends of the file permitting."""
        have = self.first + len(self.data)
        if min(end, self.size) > have:
            end = min(max(end, have + min(len(self.data), MORE << 6)), self.size)  # by as much again, so that bytes are seldom copied
            self.file.seek(have)
            self.data += self.file.read(end - have)
        return self.data

    @property
    def whole(self) -> bool:
        return self.first + len(self.data) >= self.size


def kind_of(head: bytes, name: str) -> str | None:
    """By content, else by the file's extension."""
    if head[:4] == b"RIFF" and head[8:12] == b"WAVE":
        return "wav"
    if head[:4] in (b"fLaC", b"OggS"):
        return {b"fLaC": "flac", b"OggS": "ogg"}[head[:4]]
    if packet_phase(head) is not None:
        return "ts"
    return NAMES.get(name.rpartition(".")[2].lower())


def packet_phase(head: bytes) -> int | None:
    """Where the first of three packets in a row begins."""
    if len(head) < 188:
        return None
    reach = range(0, len(head), 188)[:3]
    return next((p for p in range(188) if all(p + q < len(head) and head[p + q] == 0x47 for q in reach)), None)


def wav_data(w: Window) -> tuple[int, int, int] | None:
    """(place, bytes, bytes per frame) of a WAV file's samples."""
    at, align = 12, 0
    while len(b := w.upto(at + 32)) >= at + 8:
        kind, n = b[at : at + 4], int.from_bytes(b[at + 4 : at + 8], "little")
        if kind == b"fmt ":
            align = int.from_bytes(b[at + 20 : at + 22], "little")
        elif kind == b"data":
            return (at + 8, min(n, w.size - at - 8), align) if align else None
        if at + 8 + n + (n & 1) > MOST:
            return None
        at += 8 + n + (n & 1)
    return None


# Frames of a range: (offset, bytes) of those that start from ``first`` to before ``stop``.


def wav(file, size: int, first: int, stop: int) -> Iterator[tuple[int, bytes]]:
    if not (found := wav_data(Window(file, 0, size))):
        return
    start, n, align = found
    step = align * BLOCK
    for at in range(start + max(0, -(-(first - start) // step)) * step, min(stop, start + n - n % align), step):
        file.seek(at)
        yield at, file.read(min(step, start + n - n % align - at))


def ts(file, size: int, first: int, stop: int) -> Iterator[tuple[int, bytes]]:
    phase = packet_phase(Window(file, 0, size).upto(HEAD))
    if phase is None:
        return
    at = phase + max(0, -(-(first - phase) // 188)) * 188
    file.seek(at)
    while at < stop and len(p := file.read(188)) == 188:
        if p[0] == 0x47:
            yield at, p
        at += 188


def ogg(file, size: int, first: int, stop: int) -> Iterator[tuple[int, bytes]]:
    w = Window(file, first, size)
    at = first
    while at < stop:
        b = w.upto(min(max(stop, at), at + STEP) + MORE)
        i = b.find(b"OggS\x00", at - first)
        if i < 0 and not w.whole and first + len(b) - 4 < stop:
            at = first + len(b) - 4
            continue
        if i < 0 or first + i >= stop:
            return
        n = b[i + 26] if i + 27 <= len(b) else 0
        end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        page = b[i:end]
        if len(page) == end - i > 27 and containers.page_crc(page[:22] + bytes(4) + page[26:]) == int.from_bytes(page[22:26], "little"):
            yield first + i, page
            at = first + end
        else:
            at = first + i + 1


def flac(file, size: int, first: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """A frame lasts to the first later header whose number follows on and before which its CRC-16 agrees, or to the end."""
    info = metadata_end(Window(file, 0, size))
    first = max(first, info)
    w, at = Window(file, first, size), first
    while at < stop:
        b = w.upto(min(stop, at + STEP) + MORE)
        i = b.find(b"\xff", at - first)
        if i < 0 and not w.whole and first + len(b) < stop:
            at = first + len(b)
            continue
        if i < 0 or first + i >= stop:
            return
        if i + 32 > len(b) and not w.whole:
            at = first + i
            w.upto(first + len(b) + MORE)
            continue
        h = decoders.frame_header(b, i)
        end = _flac_end(w, i, h) if h else 0
        if end:
            yield first + i, w.data[i:end]
            at = first + end
        else:
            at = first + i + 1


def metadata_end(w: Window) -> int:
    """The place after a FLAC file's metadata blocks."""
    at, last = 4, w.upto(4) != b"fLaC"
    while not last and len(b := w.upto(at + 4)) >= at + 4:
        last, at = bool(b[at] & 0x80), at + 4 + int.from_bytes(b[at + 1 : at + 4], "big")
    return at if at > 4 else 0


def _flac_end(w: Window, i: int, h: tuple) -> int:
    after = h[1] + (h[2] if w.data[i + 1] & 1 else 1)
    most = h[0] + 2 + 5 * (h[2] + 8) * (2 if h[4] > 7 else h[4] + 1)  # samples take 33 bits at most
    sync, j = w.data[i : i + 2], i + h[0]
    while True:
        j = w.data.find(sync, j)
        if j < 0 or (j + 16 > len(w.data) and not w.whole):
            if w.whole:
                return len(w.data) if decoders.sound(w.data, i, len(w.data)) else 0
            if len(w.data) - i > most:
                return 0
            j = max(i + h[0], (j if j >= 0 else len(w.data)) - 1)
            w.upto(w.first + len(w.data) + MORE)
            continue
        later = decoders.frame_header(w.data, j)
        if later and later[1] == after and decoders.sound(w.data, i, j):
            return j
        if j - i > most:
            return 0
        j += 1


def _headed(size_of: Callable[[bytes, int], int], alike: Callable[[bytes, int], tuple]) -> Callable:
    """Frames whose header tells their size: a chain of AGREE headers starts a range, and goes on while headers follow."""

    def frames(file, size: int, first: int, stop: int) -> Iterator[tuple[int, bytes]]:
        before = max(0, first - HEAD)  # in step from a little earlier, as one pass would be
        w, at, synced = Window(file, before, size), 0, False
        while before + at < stop:
            b = w.upto(min(stop, before + at + STEP) + MORE)
            n = size_of(b, at)
            if n and (synced or _agree(b, at, w.whole)):
                if at + n > len(b):
                    return
                synced = True
                if before + at >= first:
                    yield before + at, b[at : at + n]
                at += n
            else:
                synced, at = False, b.find(b"\xff", at + 1)
                if at < 0 and w.whole:
                    return
                at = len(b) if at < 0 else at

    def _agree(b: bytes, at: int, whole: bool) -> bool:
        """Alike headers follow each other from here, or up to the end of the file, junk behind it aside."""
        own = alike(b, at)
        for k in range(AGREE):
            n = size_of(b, at)
            if not n or alike(b, at) != own:
                return False
            at += n
            if whole and at == len(b):
                return True
        return True

    return frames


def _mp3_size(b: bytes, at: int) -> int:
    h = containers.mp3_header(b, at)
    return h[0] if h else 0


def _adts_size(b: bytes, at: int) -> int:
    good = at + 7 <= len(b) and b[at] == 0xFF and b[at + 1] & 0xF6 == 0xF0 and b[at + 2] >> 2 & 15 < 13
    n = (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5 if good else 0
    return n if n > 6 else 0


KINDS = {
    "wav": wav, "ts": ts, "ogg": ogg, "flac": flac,
    "mp3": _headed(_mp3_size, lambda b, at: (b[at + 1] & 0xFE, b[at + 2] & 0x0C)),
    "adts": _headed(_adts_size, lambda b, at: (b[at + 1] & 0xFE, b[at + 2], b[at + 3] & 0xC0)),
}


def opened(path: str):
    """A file of any of pyarrow's file systems, and its size."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    return system.open_input_file(place), system.get_file_info(place).size


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder and below it, by name; hidden ones are left out."""
    from pyarrow import fs

    system, place = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    one = system.get_file_info(place)
    if one.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    return sorted((scheme + f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class Range(InputPartition):
    def __init__(self, path: str, first: int, stop: int) -> None:
        self.path, self.first, self.stop = path, first, stop


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths, self.split, self.kind = options["path"].split(), int(options.get("split", SPLIT)), options.get("kind")
        if self.split <= 0 or self.kind not in (None, *KINDS):
            raise ValueError(f"split: bytes of a range; kind: one of {', '.join(KINDS)}")

    def partitions(self) -> list[Range]:
        """Ranges of every file; the driver reads names and sizes only."""
        files = [f for p in self.paths for f in listed(p)]
        return [Range(path, a, min(a + self.split, size)) for path, size in files for a in range(0, size, self.split)]

    def read(self, r: Range) -> Iterator[tuple]:
        file, size = opened(r.path)
        with file:
            kind = self.kind or kind_of(file.read(HEAD), r.path)
            if kind:
                for at, data in KINDS[kind](file, size, r.first, r.stop):
                    yield r.path, kind, at, data


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "media_frames"

    def schema(self) -> str:
        return "path string, kind string, offset long, data binary"

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    ready(spark).dataSource.register(FrameSource)


def media_frames(spark: SparkSession, path: str, split: int = SPLIT, kind: str | None = None) -> DataFrame:
    """(path, kind, offset, data) of a file or folder."""
    register(spark)
    reader = spark.read.format("media_frames").option("split", split)
    return (reader.option("kind", kind) if kind else reader).load(path)


def heads(frames: DataFrame, kind: str, of: Callable, schema: str) -> DataFrame:
    """(path, schema) of each file of ``frames``: what ``of`` makes of the opened file and its size; a row per file at most."""
    ready(frames.sparkSession)
    types = T.StructType.fromDDL(f"path string, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                file, size = opened(path)
                with file:
                    if (found := of(file, size)) is not None:
                        rows.append((path, *found))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i == 0 else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows))], types.names)

    return frames.where(F.col("kind") == kind).select("path").distinct().mapInArrow(run, types)


def _pcm(rows: DataFrame, columns: tuple[str, ...], decode: Callable) -> DataFrame:
    """(stream_id, frame_no, left, right) by ``decode`` of a row's data and columns: first frame number, left and right, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, *own in zip(*(batch.column(c).to_pylist() for c in ("path", *columns))):
                if (found := decode(*own)) is not None:
                    first, left, right = found
                    numbers = np.arange(first, first + len(left), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(left)), pa.array(numbers), *(pa.array(x.astype(np.int32)) for x in (left, right))], ["stream_id", "frame_no", "left", "right"])

    return rows.mapInArrow(run, "stream_id string, frame_no long, left int, right int")


def wav_pcm(frames: DataFrame) -> DataFrame:
    """(stream_id, frame_no, left, right) of the WAV blocks of ``media_frames``, left-justified; mono gives both channels.

    A block's first frame number follows from its offset, so no block waits for another. Files that aren't plain PCM have no rows.
    """

    def head(file, size: int) -> tuple[int, ...] | None:
        w = Window(file, 0, size)
        if not (found := wav_data(w)):
            return None
        at = w.data.find(b"fmt ")
        kind, channels, _, _, _, bits = struct.unpack("<HHIIHH", w.data[at + 8 : at + 24])
        return (found[0], found[2], channels, bits) if kind == 1 and bits in (8, 16, 24, 32) and channels and found[2] == channels * bits // 8 else None

    def decode(offset: int, data: bytes, start: int, align: int, channels: int, bits: int) -> tuple:
        wide = bits // 8
        raw = np.frombuffer(data, np.uint8).reshape(-1, channels, wide).astype(np.int64)
        value = sum(raw[:, :, i] << 8 * (4 - wide + i) for i in range(wide))
        value = value - (1 << 31) if bits == 8 else np.where(value >= 1 << 31, value - (1 << 32), value)
        return (offset - start) // align, value[:, 0], value[:, min(1, channels - 1)]

    rows = frames.join(heads(frames, "wav", head, "start long, align long, channels long, bits long"), "path")
    return _pcm(rows, ("offset", "data", "start", "align", "channels", "bits"), decode)


def flac_pcm(frames: DataFrame) -> DataFrame:
    """(stream_id, frame_no, left, right) of the FLAC frames of ``media_frames``: each frame's place is in its own header.

    A frame's number is that of its first sample where the block size varies, else it counts blocks of the size that the
    stream's first frame has; so a frame needs no other, and lost ones leave a gap. Frames that fail to decode are left out.
    """

    def head(file, size: int) -> tuple[int, int] | None:
        start = metadata_end(Window(file, 0, size))
        file.seek(0)
        b = file.read(HEAD)
        file.seek(start)
        h = decoders.frame_header(file.read(64), 0)
        return ((int.from_bytes(b[20:22], "big") >> 4 & 31) + 1, h[2] if h else int.from_bytes(b[10:12], "big")) if len(b) >= 26 else None

    def decode(b: bytes, bits: int, block: int) -> tuple | None:
        try:
            left, right = decoders.decode_frame(b, bits)
        except (ValueError, IndexError):
            return None
        number = decoders.frame_header(b, 0)[1]
        return number if b[1] & 1 else number * block, left, right

    return _pcm(frames.join(heads(frames, "flac", head, "bits long, block long"), "path"), ("data", "bits", "block"), decode)
