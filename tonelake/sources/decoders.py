"""Decoding to PCM rows. WAV is native (``files.wav_samples``); FLAC is decoded frame by frame.

FLAC frames are found by their checked headers, numbers and checksums, so a file's frames spread over tasks; frames are cut
out as rows before any is decoded. Samples come left-justified in 32 bits, mono on both channels. Frames that fail are
left out, as a decoder that goes on at the next frame would.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonelake.functions.text import _CRC8, crc16_of
from tonelake.session import ready
from tonelake.sources import containers

# Block sizes, sample rates and sample widths by code.
SIZES = {1: 192, **{c: 576 << c - 2 for c in range(2, 6)}, **{c: 256 << c - 8 for c in range(8, 16)}}
RATES = {1: 88_200, 2: 176_400, 3: 192_000, 4: 8000, 5: 16_000, 6: 22_050, 7: 24_000, 8: 32_000, 9: 44_100, 10: 48_000, 11: 96_000}
WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def frame_header(b: bytes, at: int) -> tuple[int, int, int, int, int, int] | None:
    """(size of the header, number, block size, rate, channel code, width) if its CRC-8 agrees."""
    if at + 6 > len(b) or b[at] != 0xFF or b[at + 1] & 0xFE != 0xF8:
        return None
    bs, sr, ch, ss = b[at + 2] >> 4, b[at + 2] & 15, b[at + 3] >> 4, b[at + 3] >> 1 & 7
    if bs == 0 or sr == 15 or ch > 10 or ss == 3 or b[at + 3] & 1:
        return None
    p = at + 4
    lead = 8 - (b[p] ^ 0xFF).bit_length() if b[p] & 0x80 else 0
    if lead in (1, 8):
        return None
    number = b[p] & (0x7F >> lead)
    more = max(lead - 1, 0)
    p += 1 + more
    if p + 5 > len(b):
        return None
    for x in b[p - more : p]:
        number = number << 6 | x & 63
    size, rate = SIZES.get(bs, 0), RATES.get(sr, 0)
    if bs in (6, 7):
        size = int.from_bytes(b[p : p + bs - 5], "big") + 1
        p += bs - 5
    if sr in (12, 13, 14):
        n = 1 if sr == 12 else 2
        rate = int.from_bytes(b[p : p + n], "big") * {12: 1000, 13: 1, 14: 10}[sr]
        p += n
    crc = 0
    for x in b[at:p]:
        crc = _CRC8[crc ^ x]
    return (p + 1 - at, number, size, rate, ch, WIDTHS.get(ss, 0)) if p < len(b) and crc == b[p] else None


def flac_frames(b: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(offset, number, samples, bytes) of the sound frames after the metadata.

    A frame lasts to the header whose number follows on and before which the frame's CRC-16 agrees, the last one to the
    end; what looks like a header inside a frame is neither. A frame for which there is no such end is left out.
    """
    at = max((o + n for _, o, n in containers.flac_blocks(b)), default=0)
    found: list[tuple[int, int, int]] = []  # place, number, number of the frame after it
    while (at := b.find(b"\xff", at)) >= 0:
        h = frame_header(b, at)
        if h:
            found.append((at, h[1], h[1] + (h[2] if b[at + 1] & 1 else 1)))
        at += 1
    by_number: dict[int, list[int]] = {}
    for i, (_, number, _) in enumerate(found):
        by_number.setdefault(number, []).append(i)
    i = 0
    while i < len(found):
        at, number, after = found[i]
        later = [j for j in by_number.get(after, []) if j > i]
        end = next((j for j in [*later, len(found)] if sound(b, at, found[j][0] if j < len(found) else len(b))), None)
        if end is not None:
            yield at, number, frame_header(b, at)[2], b[at : found[end][0] if end < len(found) else len(b)]
        i = i + 1 if end is None else end


def sound(b: bytes, at: int, end: int) -> bool:
    return end - at > 2 and crc16_of(b[at : end - 2]) == int.from_bytes(b[end - 2 : end], "big")


class Bits:
    """Bits of a frame, first bit highest."""

    def __init__(self, b: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(b, np.uint8))
        self.at = 0

    @functools.cached_property
    def next_one(self) -> list[int]:
        """Of each place the first 1 from there on; one beyond the end where there is none."""
        n = len(self.bits)
        return np.minimum.accumulate(np.where(self.bits == 1, np.arange(n), n)[::-1])[::-1].tolist()

    def u(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise IndexError
        v = 0
        for x in self.bits[self.at : self.at + n].tolist():
            v = v << 1 | x
        self.at += n
        return v

    def s(self, n: int) -> int:
        v = self.u(n)
        return v - (1 << n) if n and v >> n - 1 else v

    def unary(self) -> int:
        n = self.next_one[self.at] - self.at
        self.at += n + 1
        return n

    def fixed(self, count: int, n: int) -> np.ndarray:
        """``count`` signed values of ``n`` bits."""
        if self.at + count * n > len(self.bits):
            raise IndexError
        part = self.bits[self.at : self.at + count * n].reshape(count, n).astype(np.int64)
        self.at += count * n
        v = part @ (1 << np.arange(n - 1, -1, -1, dtype=np.int64))
        return np.where(part[:, 0] == 1, v - (1 << n), v)

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` signed values: zeros up to a 1, then ``k`` bits. Where codes end is followed in turn, the rest is done at once."""
        first, ends, p, after = self.at, [], self.at, self.next_one
        for _ in range(count):
            p = after[p]
            ends.append(p)
            p += 1 + k
        if p > len(self.bits):
            raise IndexError
        self.at, ones = p, np.array(ends, np.int64)
        starts = np.concatenate([[first], ones[:-1] + 1 + k])[:count]
        low = self.bits[ones[:, None] + np.arange(1, k + 1)].astype(np.int64) @ (1 << np.arange(k - 1, -1, -1, dtype=np.int64)) if k else 0
        v = ones - starts << k | low
        return v >> 1 ^ -(v & 1)


def residuals(r: Bits, size: int, order: int) -> np.ndarray:
    """Rice-coded differences, by partitions; escaped partitions are plain."""
    wide = 5 if r.u(2) == 1 else 4
    parts = 1 << r.u(4)
    out: list[np.ndarray] = []
    for i in range(parts):
        n = size // parts - (order if i == 0 else 0)
        if n < 0:
            raise ValueError("a partition shorter than the warm-up")
        k = r.u(wide)
        if k == (1 << wide) - 1:
            w = r.u(5)
            out.append(r.fixed(n, w) if w else np.zeros(n, np.int64))
        else:
            out.append(r.rice(n, k))
    return np.concatenate(out)


def subframe(r: Bits, size: int, width: int) -> np.ndarray:
    """One channel: constant, plain, fixed or linear prediction."""
    r.u(1)
    kind = r.u(6)
    wasted = r.unary() + 1 if r.u(1) else 0
    width -= wasted
    if kind == 0:
        x = np.full(size, r.s(width), np.int64)
    elif kind == 1:
        x = r.fixed(size, width)
    else:
        order = kind & 7 if kind & 0x38 == 8 else (kind & 31) + 1
        start = r.fixed(order, width) if order else np.zeros(0, np.int64)
        if kind & 0x20:
            bits, shift = r.u(4) + 1, r.s(5)
            c, y = r.fixed(order, bits).tolist(), start.tolist()
            for d in residuals(r, size, order).tolist():
                y.append(d + (sum(map(operator.mul, c, y[: -order - 1 : -1])) >> shift))
            x = np.array(y, np.int64)
        else:  # a fixed predictor's differences are summed as often as its order
            x = residuals(r, size, order)
            for j in range(order - 1, -1, -1):
                x = np.diff(start, j)[-1] + np.cumsum(x)
            x = np.concatenate([start, x])
    return x << wasted


def _channels(b: bytes, width: int) -> tuple[list[np.ndarray], int, int, int]:
    """The channels of a frame as stored, its channel code and sample width, and how many bytes it takes up to its CRC-16."""
    h = frame_header(b, 0)
    if not h:
        raise ValueError("no frame")
    head, _, size, _, code, own = h
    width = own or width
    r = Bits(b[head:])
    wide = {8: (0, 1), 9: (1, 0), 10: (0, 1)}.get(code, (0,) * (code + 1))
    return [subframe(r, size, width + extra) for extra in wide], code, width, head + -(-r.at // 8)


def frame_length(b: bytes, width: int) -> int:
    """The bytes of the sound frame that ``b`` begins with, its CRC-16 included; 0 if there is none."""
    try:
        n = _channels(b, width)[3] + 2
    except (ValueError, IndexError):
        return 0
    return n if n <= len(b) and sound(b, 0, n) else 0


def decode_frame(b: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Left and right of one frame, left-justified; ``width`` serves where the frame leaves it to the stream."""
    ch, code, width, _ = _channels(b, width)
    left, right = ch[0], ch[min(1, len(ch) - 1)]
    if code == 8:
        right = left - right
    elif code == 9:
        left = left + right
    elif code == 10:
        mid = left << 1 | right & 1
        left, right = mid + right >> 1, mid - right >> 1
    return left << 32 - width, right << 32 - width


def flac_pcm(files: DataFrame) -> DataFrame:
    """(stream_id, frame_no, left, right) of native FLAC files, decoded once: the sizes of frames are in their headers.

    A frame begins where the sound ones before it end. One that is sound but can't be decoded leaves a gap.
    """
    spark = ready(files.sparkSession)
    info = containers.flac_stream_info(files).select("path", "bits")
    frames = containers.parsed(files, flac_frames, "offset bigint, number bigint, n bigint, frame binary")
    before = Window.partitionBy("path").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    starts = frames.select("path", "offset", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # no bytes are sorted
    frames = frames.select("path", "offset", "frame").join(info, "path").join(starts, ["path", "offset"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, b, bits in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "frame", "bits"))):
                try:
                    left, right = decode_frame(b, bits)
                except (ValueError, IndexError):
                    continue
                numbers = np.arange(start, start + len(left), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(left)), pa.array(numbers), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], names=["stream_id", "frame_no", "left", "right"])

    return frames.mapInArrow(run, "stream_id string, frame_no long, left int, right int")


def max_frame_size(codec):
    """Bytes a decoder wants at least, by codec."""
    # Frame sizes.
    sizes = {"WAV": 4096, "MP3": 18_000, "AAC": 18_000, "M4A": 18_000, "FLAC": 65_535, "OGG": 65_535, "OPUS": 65_535, "VORBIS": 65_535}
    return F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv])[codec]
