"""Token-ID binary output: files of Simple-8b words, with per-block offsets for vectorised decoding.

A file is: the magic b"S8B1"; blocks of at most BLOCK ids as little-endian 64-bit words; an index of Arrow tables
(blocks: byte offset, words, ids before; documents: doc_id, start, n_tokens); the index's length in 8 bytes.

A word has a 4-bit selector in its top bits and 60 bits of payload. Selectors 1 to 15 hold 120, 60, 30, .. 1 values of
0, 1, 2, .. 60 bits. Selector 0 is the escape: the word after it is one value of 64 bits. The last word of a block may
hold fewer values than its selector says; the block's count tells.

Documents go by range into as many files as there are shuffle partitions, in ascending order of doc_id (null first,
equal ids by text). Each task names its files anew and returns them with its rows, so that what a lost or repeated task
wrote is never read. Null texts count as empty: such a document is its end id alone. An empty table gives no rows.
"""

from __future__ import annotations

import io
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.llm.common import fresh_path, in_arrow, partitions, table, written
from tonelake.llm.tokens import KEPT, default_path, encoder

# Values in a word and bits of each, by selector; 0 is the escape.
COUNTS = [1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
BITS = [64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]

MAGIC = b"S8B1"
BLOCK = 16_384
_POWERS = np.uint64(1) << np.arange(61, dtype=np.uint64)
#: Bit lengths of the values that token ids have.
_LENGTHS = np.searchsorted(_POWERS, np.arange(1 << 17, dtype=np.uint64), side="right")


def encode_block(values: np.ndarray) -> np.ndarray:
    """uint64 values as Simple-8b words; at each place the selector that takes the most values."""
    n = len(values)
    bits = _LENGTHS[values] if values.max(initial=0) < len(_LENGTHS) else np.searchsorted(_POWERS, values, side="right")  # 61 stands for more than 60
    rest = np.arange(n, 0, -1)
    selector, taken = np.zeros(n, np.int64), np.ones(n, np.int64)
    small, most = np.arange(n), 16
    if bits.max(initial=0) <= 60:  # what takes every value fits everywhere, and wins over all that take larger ones
        most = next(s for s in range(1, 16) if BITS[s] >= bits.max(initial=0))
        selector[:], taken[:] = most, np.minimum(COUNTS[most], rest)
    for s in range(most - 1, 0, -1):  # the later, denser ones win
        small = small[bits[small] <= BITS[s]]
        if not len(small):
            break
        # places from which COUNTS[s] small values follow; past the end all counts as small, so the last word may be short
        run = np.concatenate([small, np.arange(n, n + COUNTS[s] - 1)])
        fits = small[run[COUNTS[s] - 1 :] - small == COUNTS[s] - 1]
        selector[fits], taken[fits] = s, np.minimum(COUNTS[s], rest[fits])
    starts, at, step = [], 0, taken.tolist()
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    wide = chosen == 0
    where = np.cumsum(1 + wide) - 1 - wide  # an escape takes two words
    words = np.zeros(int((1 + wide).sum()), np.uint64)
    words[where[wide] + 1] = values[starts[wide]]
    padded = np.concatenate([values, np.zeros(120, np.uint64)])  # what a short last word lacks is zero
    for s in np.unique(chosen[~wide]).tolist():
        own = np.flatnonzero(chosen == s)
        word = np.full(len(own), s << 60, np.uint64)
        if BITS[s]:
            for k in range(COUNTS[s]):
                word |= padded[starts[own] + k] << np.uint64(k * BITS[s])
        words[where[own]] = word
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The n values of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (selector == 0).any():  # an escape's second word may look like any selector, so these are found in turn
        at, ordinary = 0, selector.tolist()
        while at < len(ordinary):
            if ordinary[at] == 0:
                raw[at + 1] = True
                at += 1
            at += 1
    heads = np.flatnonzero(~raw)
    chosen = selector[heads]
    counts = np.array(COUNTS)[chosen]
    starts = np.cumsum(counts) - counts
    values = np.zeros(int(counts.sum()), np.uint64)
    for s in range(16):
        own = chosen == s
        if own.any() and s == 0:
            values[starts[own]] = words[heads[own] + 1]
        elif own.any() and BITS[s]:
            k = np.arange(COUNTS[s])
            values[starts[own, None] + k] = (words[heads[own], None] >> (k * BITS[s]).astype(np.uint64)) & np.uint64((1 << BITS[s]) - 1)
    return values[:n]


class Writer:
    """Writes one file, block by block."""

    def __init__(self, out) -> None:
        self.out, self.at, self.ids, self.waiting, self.have = out, len(MAGIC), 0, [], 0
        self.blocks, self.docs = ([], [], []), ([], [], [])
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for c, v in zip(self.docs, (doc_id, self.ids + self.have, len(ids))):
            c.append(v)
        self.waiting.append(ids)
        self.have += len(ids)
        if self.have >= BLOCK:
            self.flush(False)

    def flush(self, all_: bool) -> None:
        values = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint64)
        full = len(values) if all_ else len(values) // BLOCK * BLOCK
        for i in range(0, full, BLOCK):
            part = values[i : min(i + BLOCK, full)]
            words = encode_block(part)
            for c, v in zip(self.blocks, (self.at, len(words), self.ids)):
                c.append(v)
            self.out.write(words.astype("<u8").tobytes())
            self.at, self.ids = self.at + 8 * len(words), self.ids + len(part)
        self.waiting, self.have = [values[full:]], len(values) - full

    def close(self) -> None:
        self.flush(True)
        index = io.BytesIO()
        for names, cols in ((("offset", "words", "before"), self.blocks), (("doc_id", "start", "n_tokens"), self.docs)):
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(names))
            with pa.ipc.new_stream(index, batch.schema) as stream:
                stream.write_batch(batch)
        self.out.write(index.getvalue())
        self.out.write(len(index.getvalue()).to_bytes(8, "little"))


class Reader:
    """Reads a file's index, and ids from any place on."""

    def __init__(self, file) -> None:
        self.file, size = file, file.size()
        n = int.from_bytes(file.read_at(8, size - 8), "little")
        index = io.BytesIO(file.read_at(n, size - 8 - n))
        self.blocks, self.docs = pa.ipc.open_stream(index).read_all(), pa.ipc.open_stream(index).read_all()
        self.total = sum(self.docs["n_tokens"].to_pylist())

    def chunks(self) -> Iterator[np.ndarray]:
        """The ids of each block in turn."""
        offset, words, before = (self.blocks[c].to_pylist() for c in ("offset", "words", "before"))
        for at, n, first, after in zip(offset, words, before, [*before[1:], self.total]):
            yield decode_block(np.frombuffer(self.file.read_at(8 * n, at), "<u8"), after - first)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) of each document; a block is held at a time, and a document."""
        chunks, have = self.chunks(), np.empty(0, np.uint64)
        for doc_id, start, n in zip(*(self.docs[c].to_pylist() for c in ("doc_id", "start", "n_tokens"))):
            if len(have) < n:
                got, parts = len(have), [have]
                while got < n:
                    parts.append(next(chunks))
                    got += len(parts[-1])
                have = np.concatenate(parts)
            yield doc_id, start, have[:n]
            have = have[n:]


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, kept: int = KEPT) -> DataFrame:
    """Writes (doc_id, text) into files below ``folder``; returns (file, path, n_ids), numbered in order."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        of, number, path = encoder(tokenizer, kept), TaskContext.get().partitionId(), f"{folder}/{uuid.uuid4().hex}.s8b"
        fs, local = FileSystem.from_uri(path)
        fs.create_dir(local.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(local, compression=None) as out:
            writer = Writer(out)
            for batch in itertools.chain([first], batches):
                ids, sizes = of.all_ids(batch.column(1).cast(pa.binary()).to_pylist())
                stops = np.cumsum(sizes + 1)
                ended = np.full(len(ids) + len(sizes), end_id, np.uint64)
                own = np.ones(len(ended), bool)
                own[stops - 1] = False
                ended[own] = ids
                for doc_id, part in zip(batch.column(0).to_pylist(), np.split(ended, stops[:-1])):
                    writer.add(doc_id, part)
            writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (number, path, writer.ids)], names=["file", "path", "n_ids"])

    order = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text"))
    order = order.repartitionByRange(partitions(docs.sparkSession), "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    files, _ = written(in_arrow(order.drop("_h"), write, "file long, path string, n_ids long"), "files")
    return files


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): what the files hold; start counts the ids of all documents before.

    One row per file goes through one task for the running sum, which is as many rows as shuffle partitions.
    """
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                fs, local = FileSystem.from_uri(path)
                with fs.open_input_file(local) as file:
                    docs = Reader(file).documents()
                    while some := list(itertools.islice(docs, 200)):
                        cols = [pa.array([d[0] for d in some], pa.int64()), pa.array([base + d[1] for d in some], pa.int64()), pa.array([len(d[2]) for d in some], pa.int64()), pa.array([d[2].astype("<u4").tobytes() for d in some], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids"])

    n = partitions(files.sparkSession)
    return in_arrow(based.repartition(n, "path"), read, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_files(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), default_path(), 2, kept=500_000)
    return read_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
