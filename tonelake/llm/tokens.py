"""Token ids of whole texts by the tokenizers library, white-space chunk by chunk.

The tokenizer named in the contracts (word_bpe_49k) drops white space and never joins what it parts, so a text's ids are
those of its chunks in turn. It parts letter runs from all else, lower-cases, maps bytes to letters and merges; a chunk of
plain letters therefore goes to its merges alone. A text that holds a special token, in whatever case, goes to the library
whole, and so does each text of a tokenizer that fails PROBES. Several texts are cut further, where a chunk's plain letters begin
or end, and their equal pieces looked up once. Each worker keeps the ids of chunks it has met, in two generations of bounded size.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tonelake.llm import shingles as sh
from tonelake.llm.common import in_arrow
from tonelake.session import BATCH_BYTES

#: Chunks in a generation, of which there are two: 160 bytes each or so, in every worker.
KEPT = 200_000
#: Below this character, letters are composed and have one simple lower case, so that a mark after them stays apart.
FIRST_BEYOND = "\u0130"
#: Texts that a tokenizer must part as this module does for its chunks to be taken one by one.
PROBES = ["Plain words, and others.  Two spaces\tand\nlines\r\n", "ÀÉ straße. É, 12a,b. don't (x) a-b http://a.b/c?d", " leading, trailing ", "İ. ΣΑΣ, クラ 漢字。 a1 ¼ ª"]
PROBES += ["it's 's a's.b a'sb 'tis x'1 '' b''s c'.d we'LL've", "nter*** (a-b_c)d 12ab34 e$$$f. é.a a.é ΑΣ.a Σ'a a\u0301.b .a\u0301 =\u0338a a\u00a0.b"]
#: Bytes of texts up to which they are cut and looked up at once.
AT_ONCE = 8 << 20
# White space, letters after lower-casing, other ASCII and the rest; pieces end where two kinds differ by 1 to 4 (by XOR).
_KINDS = np.full(256, 4, np.uint8)
_KINDS[:128] = 2
_KINDS[[32, *range(9, 14)]] = 0
_KINDS[ord("a") : ord("z") + 1] = 1

# The byte-level alphabet by its rule: printable bytes stand for themselves, the others follow from U+0100 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder(dict):
    """Maps a chunk to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, kept: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.of, self.last, self.kept = Tokenizer.from_file(path), {}, kept
        self.merge = self.of.model.tokenize
        self.special = [t.content.lower().encode() for t in self.of.get_added_tokens_decoder().values()]
        self.by_chunk = True
        try:
            whole = [self.whole(t.encode()) for t in PROBES]
            self.by_chunk = all(self.ids(t.encode()) == w and self.all_ids([t.encode()])[0].tobytes() == w for t, w in zip(PROBES, whole))
        except Exception:  # noqa: BLE001 - a model without such merges
            self.by_chunk = False
        self.clear()

    def whole(self, text: bytes) -> bytes:
        return array("I", self.of.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) >= self.kept:
            self.last = dict(self)
            self.clear()
        ids = self.last.get(chunk)
        if ids is None:
            plain = chunk.decode()
            if plain.isalpha() and (plain.isascii() or max(plain) < FIRST_BEYOND):  # one letter run: only the merges are left to do
                if not plain.isascii():
                    plain = plain.lower().encode().decode("latin-1").translate(_BYTE_LEVEL)
                ids = array("I", [t.id for t in self.merge(plain)]).tobytes()
            elif chunk[-1:] in (b".", b",") and plain[:-1].isalpha() and max(plain) < FIRST_BEYOND:  # a letter run and a mark are apart
                ids = self[chunk[:-1]] + self[chunk[-1:]]
            else:
                ids = self.whole(chunk)
        self[chunk] = ids
        return ids

    def ids(self, text: bytes | None) -> bytes:
        text = text or b""
        lower = text.lower()
        if not self.by_chunk or any(t in lower for t in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, lower.split()))

    def all_ids(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts in a row, and how many each has."""
        lower = [(t or b"").lower() for t in texts]
        text = b" ".join([b"", *lower, b""])
        found = self._pieces(text) if self.by_chunk and len(text) <= AT_ONCE and not any(t in text for t in self.special) else None
        if found is None:
            each = [self.ids(t) for t in texts]
            return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64)
        ids, starts, upto = found
        ends = np.cumsum([len(t) + 1 for t in lower])
        return ids, np.diff(upto[np.searchsorted(starts, ends)], prepend=0)

    def _pieces(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """The ids of a lower-cased text in white space, where its pieces start, and how many ids are before each and in all; none if hashes clash."""
        b = np.frombuffer(text, np.uint8)
        kind = _KINDS[b]
        edge = (kind[1:] ^ kind[:-1]) - np.uint8(1) < 4
        edge &= (b[:-1] != ord("'")) | (kind[1:] != 1)  # 's and the like are one
        edge = np.flatnonzero(edge) + 1
        starts, ends = edge[kind[edge] > 0], edge[kind[edge - 1] > 0]
        _, first, of = np.unique(sh.hashes_at(text, starts, ends), return_index=True, return_inverse=True)
        size, same = ends - starts, first[of]
        if (size != size[same]).any() or not sh.equal_at(text, starts, ends, starts[same]):
            return None
        known = [self[text[i:j]] for i, j in zip(starts[first].tolist(), ends[first].tolist())]
        n = np.array([len(x) // 4 for x in known], np.int64)
        many = n[of]
        upto = np.concatenate([[0], np.cumsum(many)])
        at = np.repeat((np.cumsum(n) - n)[of] - upto[:-1], many) + np.arange(upto[-1])
        return np.frombuffer(b"".join(known), "<u4")[at], starts, upto


@functools.lru_cache(2)
def encoder(path: str, kept: int = KEPT) -> Encoder:
    return Encoder(path, kept)


def with_ids(df: DataFrame, path: str, end_id: int, text: str = "text", out: str = "ids", kept: int = KEPT) -> DataFrame:
    """Adds the ids of a text (null: none) and then ``end_id``, 4 bytes each, little-endian."""
    end = struct.pack("<I", end_id)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, kept)
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            yield batch.append_column(out, pa.array([of.ids(t) + end for t in texts], pa.binary()))

    return in_arrow(df, encode, schema)


def with_pieces(df: DataFrame, path: str, end_id: int, most: int, keep_ids: bool = True, text: str = "text", kept: int = KEPT) -> DataFrame:
    """Cuts the ids of a text (null: none) and then ``end_id`` every ``most`` ids: a row for each piece, from 0, in place of the text.

    Adds piece, start, length, ids_crc32 and, if kept, the ids, as ``with_ids``; others never leave the worker that made them.
    """
    end = struct.pack("<I", end_id)
    others = [f for f in df.schema.fields if f.name != text]
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = [T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.BinaryType()]
    schema = T.StructType([*others, *map(T.StructField, names, kinds)])
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: len(names)]

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, *found = zip(*rows)
        columns = batch.select([f.name for f in others]).take(pa.array(at, pa.int64())).columns
        return pa.RecordBatch.from_arrays([*columns, *map(pa.array, found, types)], names=[*(f.name for f in others), *names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(path, kept)
        for batch in batches:
            rows, size = [], 0
            for at, t in enumerate(batch.column(text).cast(pa.binary()).to_pylist()):
                ids = memoryview(of.ids(t) + end)
                for piece, start in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[start : start + 4 * most]
                    rows.append((at, piece, start // 4, len(part) // 4, zlib.crc32(part), *[bytes(part)] * keep_ids))
                    size += len(part) * keep_ids
                    if size >= BATCH_BYTES:
                        yield made(batch, rows)
                        rows, size = [], 0
            if rows:
                yield made(batch, rows)

    return in_arrow(df, cut, schema)
