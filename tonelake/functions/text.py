"""Text and byte scalars of media metadata. Native expressions throughout; indexes count from 0 and -1 means absent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named HTML entities.
ENTITIES = [
    ("amp", "&"), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("euro", "€"), ("copy", "©"),
    ("reg", "®"), ("trade", "™"), ("hellip", "…"), ("ndash", "–"), ("mdash", "—"), ("sect", "§"), ("para", "¶"),
]


def starts_with(s: Column, prefix: str, fold: bool = False) -> Column:
    return F.startswith(F.lower(s), F.lit(prefix.lower())) if fold else F.startswith(s, F.lit(prefix))


def ends_with(s: Column, suffix: str, fold: bool = False) -> Column:
    return F.endswith(F.lower(s), F.lit(suffix.lower())) if fold else F.endswith(s, F.lit(suffix))


def equals(a: Column, b: Column, fold: bool = False) -> Column:
    return F.lower(a) == F.lower(b) if fold else a == b


def contains(s: Column, part: str, fold: bool = False) -> Column:
    return F.contains(F.lower(s), F.lit(part.lower())) if fold else F.contains(s, F.lit(part))


def index_of(s: Column, part: str, start: int = 0, fold: bool = False) -> Column:
    """Place of the first occurrence from ``start`` on."""
    a, b = (F.lower(s), part.lower()) if fold else (s, part)
    return F.locate(b, a, start + 1) - 1


def last_index_of(s: Column, part: str, fold: bool = False) -> Column:
    """Place of the last occurrence."""
    a, b = (F.lower(s), part.lower()) if fold else (s, part)
    back = F.locate(b[::-1], F.reverse(a))
    return F.when(back == 0, -1).otherwise(F.char_length(a) - back - (len(b) - 1))


def bytes_index_of(data: Column, part: bytes, last: bool = False) -> Column:
    """Place of a byte string in binary: searched in Latin-1 text, where a byte is a character."""
    s, p = F.decode(data, "ISO-8859-1"), part.decode("latin-1")
    return last_index_of(s, p) if last else index_of(s, p)


def substr(s: Column, start: int, n: int | None = None) -> Column:
    return F.substring(s, start + 1, n if n is not None else 2**31 - 1)


def insert(s: Column, part: str, at: int) -> Column:
    return F.overlay(s, F.lit(part), F.lit(at + 1), F.lit(0))


def truncate_at(s: Column, mark: str) -> Column:
    return F.substring_index(s, mark, 1)


def remove_prefix(s: Column, prefix: str) -> Column:
    return F.when(F.startswith(s, F.lit(prefix)), substr(s, len(prefix))).otherwise(s)


def remove_before(s: Column, mark: str, keep: bool = True) -> Column:
    """What follows the first mark, with or without it; the whole text where there is none."""
    at = index_of(s, mark)
    return F.when(at < 0, s).otherwise(F.substring(s, at + (1 if keep else 1 + len(mark)), F.char_length(s)))


def remove_chars(s: Column, chars: str) -> Column:
    return F.translate(s, chars, "")


def trim(s: Column) -> Column:
    """Without spaces, tabs and line ends at both ends."""
    return F.regexp_replace(s, r"^[ \t\r\n\x0B\f]+|[ \t\r\n\x0B\f]+$", "")


def utf8_length(s: Column) -> Column:
    """Code points, terminal escape sequences left out."""
    return F.char_length(F.regexp_replace(s, "\x1b\\[[^@-~]*[@-~]?", ""))


def to_int(s: Column, base: int = 10) -> Column:
    """The number that a text begins with, 0 without one; base 16 with or without 0x, base 0 by the prefix."""
    t = F.regexp_extract(s, r"^\s*([+-]?)(0[xX])?", 0)
    sign = F.when(F.contains(t, F.lit("-")), -1).otherwise(1)
    hexed = F.regexp_extract(s, r"^\s*[+-]?(?:0[xX])?([0-9a-fA-F]{1,15})", 1)
    ten = F.regexp_extract(s, r"^\s*[+-]?(\d{1,18})", 1)
    as16 = F.when(hexed == "", 0).otherwise(F.conv(hexed, 16, 10).cast("bigint"))
    as10 = F.when(ten == "", 0).otherwise(ten.try_cast("bigint"))
    if base == 10:
        return sign * as10
    return sign * (as16 if base == 16 else F.when(F.regexp_like(t, F.lit("0[xX]")), as16).otherwise(as10))


def big_endian(data: Column) -> Column:
    """An unsigned number of up to 7 bytes, the first byte highest."""
    return F.conv(F.hex(data), 16, 10).cast("bigint")


def little_endian(data: Column) -> Column:
    """An unsigned number of up to 7 bytes, the last byte highest."""
    two = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.conv(F.array_join(F.reverse(two), ""), 16, 10).cast("bigint")


def syncsafe(data: Column) -> Column:
    """A number of 7 bits a byte, as tag headers have it."""
    two = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.aggregate(two, F.lit(0).cast("bigint"), lambda a, h: a * 128 + F.conv(h, 16, 10).cast("bigint"))


def latin_to_utf8(data: Column) -> Column:
    """Bytes as text: UTF-8 if they are, else Latin-1."""
    return F.when(F.is_valid_utf8(data.cast("string")), data.cast("string")).otherwise(F.decode(data, "ISO-8859-1"))


def from_utf16(data: Column, big: bool | None = None) -> Column:
    """Text of UTF-16 bytes; without ``big`` a byte order mark decides."""
    return F.decode(data, "UTF-16" if big is None else "UTF-16BE" if big else "UTF-16LE")


def character(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("bigint")), 8, "0")), "UTF-32")


def _each(s: Column, pattern: str, change) -> Column:
    """``change`` applied to each match of a pattern that covers the text, in one pass."""
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)), change), "")


def html_to_utf8(s: Column) -> Column:
    """Named and decimal entities replaced in one pass, so that ``&amp;lt;`` gives ``&lt;``; unknown ones stay.

    The text is cut before decimal ones. In what is between, names are replaced in turn: ``&amp;`` last, since only its
    character could begin another.
    """

    def named(t: Column) -> Column:
        for name, c in [*ENTITIES[1:], ENTITIES[0]]:
            t = F.replace(t, F.lit(f"&{name};"), F.lit(c))
        return t

    def decimal(t: Column) -> Column:
        end = F.locate(";", t)
        n = F.substring(t, F.lit(3), end - 3).cast("int")
        good = (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
        c = F.when(n < 128, F.char(n)).otherwise(character(F.when(good, n).otherwise(65)))
        return F.when(good, F.concat(c, named(F.substring(t, end + 1, F.char_length(t))))).otherwise(named(t))

    begins = r"&#[0-9]{1,7};"
    parts = F.transform(F.split(s, f"(?={begins})"), lambda t: F.when(F.regexp_like(t, F.lit(f"^{begins}")), decimal(t)).otherwise(named(t)))
    return F.when(~F.contains(s, F.lit("&")), s).when(F.regexp_like(s, F.lit(begins)), F.array_join(parts, "")).otherwise(named(s))


def unicode_to_utf8(s: Column) -> Column:
    r"""``\uXXXX`` escapes replaced; surrogates are not paired and stay as they are."""

    def change(t: Column) -> Column:
        n = F.conv(F.regexp_extract(t, r"^\\u([0-9a-fA-F]{4})$", 1), 16, 10).try_cast("int")
        return F.when((n > 0) & ~n.between(0xD800, 0xDFFF), character(n)).otherwise(t)

    return _each(s, r"\\u[0-9a-fA-F]{4}|[^\\]+|\\", change)


def is_json(s: Column) -> Column:
    """Whether a text has the shape of an object: braces balanced and only JSON's marks outside strings. No parser."""
    plain = F.regexp_replace(trim(s), r'"(?:[^"\\]|\\.)*"', "")
    braces = F.regexp_extract_all(plain, F.lit(r"[{}]"), F.lit(0))
    depth = F.aggregate(braces, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, b: F.struct((a["d"] + F.when(b == "{", 1).otherwise(-1)).alias("d"), F.least(a["low"], a["d"] + F.when(b == "{", 1).otherwise(-1)).alias("low")))
    return F.regexp_like(plain, F.lit(r"^\{[{}:, \t\r\n0-9.\-tfn\[\]]*\}$")) & (depth["d"] == 0) & (depth["low"] == 0)


def url_encode(s: Column, spaces_only: bool = False) -> Column:
    """Percent encoding of all but ASCII letters and digits, or of spaces alone."""
    if spaces_only:
        return F.replace(s, F.lit(" "), F.lit("%20"))
    form = F.url_encode(s)  # of ASCII it leaves letters, digits and four marks, and a space is a plus
    for c, code in (("+", "%20"), (".", "%2E"), ("-", "%2D"), ("*", "%2A"), ("_", "%5F")):
        form = F.replace(form, F.lit(c), F.lit(code))
    return form


def url_decode(s: Column) -> Column:
    """``%XX`` and ``+`` decoded; sequences that aren't hex or whose bytes aren't UTF-8 stay."""

    def change(t: Column) -> Column:
        raw = F.unhex(F.replace(t, F.lit("%"), F.lit("")))
        return F.when(F.regexp_like(t, F.lit("^(?:%[0-9a-fA-F]{2})+$")) & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.translate(t, "+", " "))

    return _each(s, r"(?:%[0-9a-fA-F]{2})+|[^%]+|%", change)


def b64_encode(s: Column) -> Column:
    return F.base64(F.encode(s, "UTF-8"))


def last_number(s: Column) -> Column:
    """The integer that ends a text as a word of its own, else null."""
    return F.regexp_extract(s, r"(?:^|\s)([+-]?\d{1,18})\s*$", 1).try_cast("bigint")


def lyric_ms(s: Column) -> Column:
    """Milliseconds of ``[mm:ss.hh]`` at the start of a line, else -1."""
    part = [F.regexp_extract(s, r"^\[(\d+):(\d+)\.(\d+)\]", i).try_cast("bigint") for i in (1, 2, 3)]
    return F.coalesce(part[0] * 60_000 + part[1] * 1000 + part[2] * 10, F.lit(-1))


#: CRC-8 with polynomial 7, one entry for each byte, by its rule.
_CRC8 = []
for _b in range(256):
    for _ in range(8):
        _b = (_b << 1 ^ 7 if _b & 128 else _b << 1) & 255
    _CRC8.append(_b)


#: CRC-16 with polynomial 0x8005, likewise.
_CRC16 = []
for _b in range(256):
    _b <<= 8
    for _ in range(8):
        _b = (_b << 1 ^ 0x8005 if _b & 0x8000 else _b << 1) & 0xFFFF
    _CRC16.append(_b)


def crc16_of(data: bytes) -> int:
    crc = 0
    for x in data:
        crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ x]
    return crc


def crc8(data: Column) -> Column:
    """CRC-8 of bytes, as frame headers carry it."""
    steps = F.array(*[F.lit(x) for x in _CRC8])
    two = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.aggregate(two, F.lit(0), lambda a, h: F.get(steps, a.bitwiseXOR(F.conv(h, 16, 10).cast("int"))))


def json_escape(s: Column) -> Column:
    """Backslashes first, then quotes and control characters."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def padded(n: Column, width: int, hexed: bool = False) -> Column:
    """A number padded with zeros, in upper-case hex on demand; a longer one stays whole."""
    s = F.hex(n.cast("bigint")) if hexed else n.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.char_length(s)), F.lit("0"))


def formatted(template: str, *args: Column) -> Column:
    """``{}`` places of a template filled in turn; ``{:02}`` pads with zeros, ``{:X}`` and ``{:04X}`` give hex."""
    import re

    parts: list[Column] = []
    fields = iter(args)
    for text, spec in re.findall(r"([^{]*)(\{[^}]*\})?", template):
        if text:
            parts.append(F.lit(text))
        if spec:
            m, arg = re.fullmatch(r"\{(?::(\d*)(X?))?\}", spec), next(fields)
            parts.append(padded(arg, int(m[1] or 0), m[2] == "X") if m[1] or m[2] else arg.cast("string"))
    return F.concat(*parts)
