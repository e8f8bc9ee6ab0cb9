"""Small media files built byte by byte, for queries over binary formats and for tests."""

from __future__ import annotations

import struct

from tonelake.functions.text import _CRC8, crc16_of


def wav(samples: list[tuple[int, ...]], bits: int, rate: int = 8000, extra: bytes = b"") -> bytes:
    """Raw values, a tuple per frame; ``extra`` lengthens the format chunk."""
    ch = len(samples[0])
    data = b"".join((v & (1 << bits) - 1).to_bytes(bits // 8, "little") for f in samples for v in f)
    fmt = struct.pack("<HHIIHH", 1, ch, rate, rate * ch * bits // 8, ch * bits // 8, bits) + extra
    odd = b"LIST" + struct.pack("<I", 3) + b"abc\0"
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + odd + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


class BitWriter:
    def __init__(self) -> None:
        self.v, self.n = 0, 0

    def u(self, value: int, n: int) -> BitWriter:
        self.v, self.n = self.v << n | value & (1 << n) - 1, self.n + n
        return self

    def rice(self, value: int, k: int) -> None:
        z = value << 1 if value >= 0 else (-value << 1) - 1
        self.u(1, (z >> k) + 1).u(z, k)

    def bytes(self) -> bytes:
        pad = -self.n % 8
        return (self.v << pad).to_bytes((self.n + pad) // 8, "big")


def flac_subframe(w: BitWriter, x: list[int], kind: str, width: int) -> None:
    if kind == "constant":
        w.u(0, 8).u(x[0], width)
        return
    if kind == "verbatim":
        w.u(1 << 1, 8)
        for v in x:
            w.u(v, width)
        return
    if kind == "fixed2":
        order, c, shift = 2, [2, -1], 0
        w.u((8 | order) << 1, 8)
    else:  # lpc
        order, c, shift = 2, [3, -1], 1
        w.u((0x20 | order - 1) << 1, 8)
    for v in x[:order]:
        w.u(v, width)
    if kind == "lpc":
        w.u(7 - 1, 4).u(shift, 5)
        for v in c:
            w.u(v, 7)
    w.u(0, 2).u(0, 4).u(4, 4)  # one partition, Rice parameter 4
    for i in range(order, len(x)):
        w.rice(x[i] - (sum(a * x[i - 1 - j] for j, a in enumerate(c)) >> shift), 4)


def flac_frame(number: int, left: list[int], right: list[int], kind: str, code: int, width: int = 16) -> bytes:
    """One frame of 16-bit samples at 44.1 kHz; code 1 is plain stereo, 8 to 10 left/side, side/right, mid/side."""
    head = bytes([0xFF, 0xF8, 0x70 | 9, code << 4 | 4 << 1, number]) + struct.pack(">H", len(left) - 1)
    crc = 0
    for b in head:
        crc = _CRC8[crc ^ b]
    side = [a - b for a, b in zip(left, right)]
    pair = {1: ((left, 0), (right, 0)), 8: ((left, 0), (side, 1)), 9: ((side, 1), (right, 0)), 10: (([a + b >> 1 for a, b in zip(left, right)], 0), (side, 1))}[code]
    w = BitWriter()
    for x, more in pair:
        flac_subframe(w, x, kind, width + more)
    whole = head + bytes([crc]) + w.bytes()
    return whole + crc16_of(whole).to_bytes(2, "big")


def vorbis_comment(pairs: list[str]) -> bytes:
    items = b"".join(struct.pack("<I", len(p.encode())) + p.encode() for p in pairs)
    return struct.pack("<I", 4) + b"tone" + struct.pack("<I", len(pairs)) + items


def flac(frames: list[bytes], total: int, pairs: list[str], picture: bytes = b"") -> bytes:
    def block(kind: int, body: bytes, last: bool = False) -> bytes:
        return bytes([kind | 128 * last]) + len(body).to_bytes(3, "big") + body

    info = struct.pack(">HH", 16, 4096) + bytes(6) + (44_100 << 44 | 1 << 41 | 15 << 36 | total).to_bytes(8, "big") + bytes(16)
    shown = struct.pack(">I", 3) + struct.pack(">I", 9) + b"image/png" + struct.pack(">I", 0) + bytes(16) + struct.pack(">I", len(picture)) + picture
    return b"fLaC" + block(0, info) + block(6, shown) + block(4, vorbis_comment(pairs), True) + b"".join(frames)


def safe(n: int) -> bytes:
    return bytes(n >> 7 * i & 127 for i in (3, 2, 1, 0))


def id3(version: int, frames: list[tuple[str, bytes]]) -> bytes:
    def size(n: int) -> bytes:
        return n.to_bytes(3, "big") if version == 2 else safe(n) if version == 4 else n.to_bytes(4, "big")

    body = b"".join(k.encode() + size(len(v)) + (b"" if version == 2 else b"\0\0") + v for k, v in frames) + bytes(16)
    return b"ID3" + bytes([version, 0, 0]) + safe(len(body)) + body


def id3v1(title: str, artist: str, year: str, track: int, genre: int) -> bytes:
    return b"TAG" + title.encode("latin-1").ljust(30, b"\0") + artist.encode("latin-1").ljust(30, b"\0") + bytes(30) + year.encode().ljust(4, b"\0") + b"note".ljust(28, b"\0") + bytes([0, track, genre])


def ogg_page(number: int, flags: int, granule: int, packets: list[bytes], go_on: bool = False) -> bytes:
    """A page of packets; with ``go_on`` the last packet, a multiple of 255 bytes, continues on the next page."""
    lacing: list[int] = []
    for i, p in enumerate(packets):
        lacing += [255] * (len(p) // 255)
        if not (go_on and i == len(packets) - 1):
            lacing.append(len(p) % 255)
    return b"OggS\0" + bytes([flags]) + struct.pack("<qIII", granule, 7, number, 0) + bytes([len(lacing)]) + bytes(lacing) + b"".join(packets)


def opus_head(channels: int = 2, skip: int = 312) -> bytes:
    return b"OpusHead\x01" + bytes([channels]) + struct.pack("<HIHB", skip, 48_000, 0, 0)


def atom(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + name + body


def m4a(name: str = "Tón", track: int = 3, cover: bytes = b"\x89PNGxx", length: int = 441_000, data: int = 100) -> bytes:
    """One AAC track of four samples, with a title, a track number of nine, and a cover."""

    def item(kind: int, v: bytes) -> bytes:
        return atom(b"data", struct.pack(">II", kind, 0) + v)

    entry = atom(b"mp4a", bytes(28) + atom(b"esds", bytes(12)))
    stbl = atom(b"stbl", atom(b"stsd", bytes(4) + struct.pack(">I", 1) + entry) + atom(b"stsz", bytes(4) + struct.pack(">II", 0, 4) + struct.pack(">IIII", 10, 20, 30, 40)))
    mdia = atom(b"mdia", atom(b"mdhd", bytes(12) + struct.pack(">II", 44_100, length) + bytes(4)) + atom(b"minf", stbl))
    ilst = atom(b"ilst", atom(b"\xa9nam", item(1, name.encode())) + atom(b"trkn", item(0, struct.pack(">HHHH", 0, track, 9, 0))) + atom(b"covr", item(14, cover)))
    return atom(b"ftyp", b"M4A \0\0\0\0") + atom(b"moov", atom(b"trak", mdia) + atom(b"udta", atom(b"meta", bytes(4) + ilst))) + atom(b"mdat", bytes(data))


def ts_packet(pid: int, start: bool, payload: bytes) -> bytes:
    room = 184 - len(payload)
    field = b"" if room == 0 else bytes([room - 1]) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"")
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, 0x30 if field else 0x10]) + field + payload


def transport_stream(parts: list[bytes]) -> bytes:
    """One program with a video stream, which is to be left out, and an ADTS audio stream that carries ``parts``."""
    pat = b"\0" + b"\0\xb0\x0d\0\x01\xc1\0\0" + b"\0\x01" + (0xE000 | 0x100).to_bytes(2, "big") + bytes(4)
    streams = b"\x1b" + (0xE000 | 0x101).to_bytes(2, "big") + b"\xf0\0" + b"\x0f" + (0xE000 | 0x102).to_bytes(2, "big") + b"\xf0\0"
    pmt = b"\0" + b"\x02\xb0" + bytes([13 + len(streams)]) + b"\0\x01\xc1\0\0" + b"\xe1\x02\xf0\0" + streams + bytes(4)
    out = [ts_packet(0, True, pat), ts_packet(0x100, True, pmt), ts_packet(0x101, True, b"\0\0\x01\xe0\0\0\x80\0\0video")]
    for i, p in enumerate(parts):
        out.append(ts_packet(0x102, i == 0, (b"\0\0\x01\xc0\0\0\x80\x80\x05" + bytes(5) if i == 0 else b"") + p))
    return b"".join(out)


def mp3(frames: int, xing: int | None = None, tail: bytes = b"") -> bytes:
    """Frames of 128 kb/s at 44.1 kHz; a Xing header tells of more frames than there are."""
    head, size = b"\xff\xfb\x90\x00", 1152 // 8 * 128_000 // 44_100
    first = head + (bytes(32) + b"Xing" + struct.pack(">II", 1, xing) if xing else b"").ljust(size - 4, b"\0")
    return first + (head + bytes(size - 4)) * (frames - 1) + tail


def icy(metaint: int, parts: list[bytes], titles: list[bytes]) -> bytes:
    out = b""
    for audio, t in zip(parts, titles):
        n = -(-len(t) // 16)
        out += audio.ljust(metaint, b".") + bytes([n]) + t.ljust(n * 16, b"\0")
    return out


def chunked(parts: list[bytes]) -> bytes:
    return b"".join(b"%X;x=1\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\nTrailer: t\r\n\r\n"


