"""Seeking in large files by a few reads of byte ranges, in place of a pass over them.

Ogg: pages tell the samples before their end (granules), which rise along the file; interpolation between two known places
says where to look, bisection takes over where it doesn't narrow. MP3: a Xing or Info header's table gives the byte of each
hundredth of the duration; without one the bit rate of the first frame does. FLAC: a seek table, and then interpolation over
the frames' own sample numbers. WAV: arithmetic. Then the next frame from there on is looked for. Each file and target
is a row; tasks open the files they have rows of.

A time before the start gives the first frame; one beyond the end, and files that can't be read, have null offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tonelake.session import ready
from tonelake.sources import containers, decoders, splits

#: Bytes of a read, and from how near on pages or frames are gone through one by one.
READ, NEAR = 1 << 16, 1 << 17


class Reads:
    """A file that counts what is read of it."""

    def __init__(self, file) -> None:
        self.file, self.count, self.bytes = file, 0, 0

    def seek(self, at: int) -> None:
        self.file.seek(at)

    def read(self, n: int) -> bytes:
        data = self.file.read(n)
        self.count, self.bytes = self.count + 1, self.bytes + len(data)
        return data


def _pages(file, size: int, at: int, serial: int | None = None) -> Iterator[tuple[int, int, int, int]]:
    """(place, end, granule, serial) of the sound pages from a place on whose granule counts."""
    for place, page in splits.ogg(file, size, at, size):
        granule, own = int.from_bytes(page[6:14], "little", signed=True), int.from_bytes(page[14:18], "little")
        if granule >= 0 and serial in (None, own):
            yield place, place + len(page), granule, own


def ogg_seek(file, size: int, granule: int) -> tuple[int, int] | None:
    """(place, granule) of the first page that ends past a granule: the one that holds the sample."""
    first = next(_pages(file, size, 0), None)
    if first is None:
        return None
    serial = first[3]
    low, below, high, above = 0, 0, size, None
    while high - low > NEAR:
        share = (granule - below) / (above - below) if above and above > below else 0.5
        middle = low + int((high - low) * min(max(share, 0.05), 0.95))
        page = next(_pages(file, size, min(middle, high - NEAR // 2), serial), None)
        if page is None or page[0] >= high:
            high = middle
        elif page[2] > granule:
            high, above = middle, page[2]
        else:
            low, below = page[1], page[2]
    return next(((place, own) for place, _, own, _ in _pages(file, size, low, serial) if own > granule), None)


def xing_table(head: bytes, at: int) -> tuple[int, int, bytes] | None:
    """(frames, bytes, table) of a Xing or Info header in the frame at a place."""
    frame = head[at : at + 256]
    i = max(frame.find(b"Xing"), frame.find(b"Info"))
    if i < 0:
        return None
    flags, p = int.from_bytes(frame[i + 4 : i + 8], "big"), i + 8
    frames = int.from_bytes(frame[p : p + 4], "big") if flags & 1 else 0
    p += 4 * (flags & 1)
    n = int.from_bytes(frame[p : p + 4], "big") if flags & 2 else 0
    p += 4 * (flags >> 1 & 1)
    return (frames, n, frame[p : p + 100]) if flags & 4 and len(frame) >= p + 100 and frames and n else None


def mp3_seek(file, size: int, seconds: float) -> tuple[int, int] | None:
    """(place, sample) of the frame at a time: by the table of the first frame, else by its bit rate."""
    first = next(splits.KINDS["mp3"](file, size, 0, size), None)
    if first is None:
        return None
    at, frame = first
    _, rate, bps, samples = containers.mp3_header(frame, 0)
    if table := xing_table(frame, 0):
        frames, n, toc = table
        share = min(max(seconds * rate / (frames * samples), 0.0), 1.0) * 100
        i = min(int(share), 99)
        after = toc[i + 1] if i < 99 else 256
        to = at + int((toc[i] + (after - toc[i]) * (share - i)) / 256 * n)
        if seconds * rate > frames * samples:
            return None
    else:
        to = at + int(max(seconds, 0.0) * bps / 8)
    found = next(splits.KINDS["mp3"](file, size, max(to, at), size), None) if to < size else None
    return (found[0], int(max(seconds, 0.0) * rate)) if found else None


def flac_points(w: splits.Window) -> list[tuple[int, int]]:
    """(sample, place from the first frame) of a FLAC file's seek table."""
    at, last, out = 4, w.upto(4) != b"fLaC", []
    while not last and len(b := w.upto(at + 4)) >= at + 4:
        kind, last, n = b[at] & 127, bool(b[at] & 128), int.from_bytes(b[at + 1 : at + 4], "big")
        if kind == 3:
            t = w.upto(at + 4 + n)[at + 4 : at + 4 + n]
            out = [(int.from_bytes(t[i : i + 8], "big"), int.from_bytes(t[i + 8 : i + 16], "big")) for i in range(0, len(t) - 17, 18)]
        at += 4 + n
    return [p for p in out if p[0] != 2**64 - 1]


def flac_seek(file, size: int, sample: int) -> tuple[int, int] | None:
    """(place, sample) of the frame that holds a sample."""
    w = splits.Window(file, 0, size)
    start = splits.metadata_end(w)
    if not start:
        return None
    head = next(splits.flac(file, size, start, size), None)
    if head is None:
        return None
    block = decoders.frame_header(head[1], 0)[2]

    def frames(at: int, stop: int) -> Iterator[tuple[int, int, int]]:
        """(place, first sample, sample after) of the frames that start in a range."""
        for p, b in splits.flac(file, size, at, stop):
            h = decoders.frame_header(b, 0)
            own = h[1] if b[1] & 1 else h[1] * block
            yield p, own, own + h[2]

    low, below, high, above = start, 0, size, None
    for s, o in flac_points(w):
        if s <= sample and start + o >= low:
            low, below = start + o, s
        elif s > sample and start + o < high:
            high, above = start + o, s
    while high - low > NEAR:
        share = (sample - below) / (above - below) if above and above > below else 0.5
        middle = low + int((high - low) * min(max(share, 0.05), 0.95))
        frame = next(frames(middle, high), None)
        if frame is None or frame[1] > sample:
            high, above = middle, frame[1] if frame else above
        else:
            low, below = frame[0], frame[1]
            if frame[2] > sample:
                return frame[0], frame[1]
    frame = next((f for f in frames(low, size) if f[2] > sample), None)
    return (frame[0], frame[1]) if frame and frame[1] <= max(sample, 0) else None


def wav_seek(file, size: int, frame: int) -> tuple[int, int] | None:
    found = splits.wav_data(splits.Window(file, 0, size))
    if not found:
        return None
    start, n, align = found
    return (start + max(frame, 0) * align, max(frame, 0)) if max(frame, 0) < n // align else None


def seek(targets: DataFrame) -> DataFrame:
    """(path, seconds, rate, offset, sample, reads) of (path, seconds, rate): where to go on reading for a time.

    ``offset`` is the page's, frame's or sample's first byte; ``sample`` the page's granule, the frame's first sample or the
    sample itself; ``reads`` how often the file was read.
    """
    ready(targets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, seconds, rate in zip(*(batch.column(c).to_pylist() for c in ("path", "seconds", "rate"))):
                try:
                    raw, size = splits.opened(path)
                except (OSError, ValueError):
                    out.append((None, None, 0))
                    continue
                with raw:
                    file = Reads(raw)
                    kind = splits.kind_of(file.read(READ), path)
                    sample = int(seconds * rate)
                    by = {"ogg": lambda: ogg_seek(file, size, sample), "flac": lambda: flac_seek(file, size, sample), "wav": lambda: wav_seek(file, size, sample), "mp3": lambda: mp3_seek(file, size, seconds)}
                    out.append((*((by[kind]() if kind in by else None) or (None, None)), file.count))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.int64()) for c in zip(*out))], ["path", "seconds", "rate", "offset", "sample", "reads"])

    rows = targets.selectExpr("path", "CAST(seconds AS DOUBLE) AS seconds", "CAST(rate AS INT) AS rate")
    return rows.mapInArrow(run, "path string, seconds double, rate int, offset long, sample long, reads long")
