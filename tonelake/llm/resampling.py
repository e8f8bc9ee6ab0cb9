"""Importance resampling towards a target distribution, in two passes over Arrow batches.

A text's words are the runs of letters and digits of its A-Z lower-cased form, every character beyond ASCII being a letter;
its features are the runs of ``sizes`` consecutive words, joined by a space, and a feature's bucket is the CRC-32 of its
bytes modulo ``buckets``. The first pass counts buckets of the corpus and of the target: each partition counts into one vector
with np.bincount, treeReduce adds the vectors on executors, and the driver gets one. A bucket's gain is the logarithm of
its share in the target over its share in the corpus, in thousandths, smoothed by one. The second pass gathers the
broadcast gains and sums them by document with the weights of bincount. A document's weight is its mean gain; its score
adds Gumbel noise drawn from its id, so that the highest scores are a sample without replacement by weight.

Ranks need no global sort. Scores are whole numbers within about +-70,000 at any size, so a table of counts by score says
at what rank each score begins, and ids are ordered within a score only. Noise follows the id, so that no score has more than
0.04 % of the ids, whatever the weights; rows that repeat an id are counted first and ordered as one.

Null and empty texts, and those without a word, have no feature and weight 0. A null id counts as the empty text and is ordered
last. Rows that repeat are ranked one by one; those of one id and score by n_features, then weight. Texts of any length are
read whole, in pieces. Other columns are left alone. Over an empty table the result is empty, an empty target gives gains all the same.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.llm.common import counted, in_arrow, table, unused

BUCKETS, SIZES, SEED, PERCENT, LEAST_WORDS = 10_000, (1, 1), 2024, 10, 20
#: Lower-cases A-Z, and makes a space of each ASCII character that no word has.
LETTERS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: Bytes of text whose words are in memory at a time, and features that are summed at a time.
PIECE, SUMMED = 1 << 20, 1 << 18
#: Words whose bucket a task remembers, and the longest of them.
KNOWN, LONGEST = 1 << 17, 64
#: Copies of one row that are numbered at a time.
COPIES = 1 << 20


class _Buckets(dict):
    """Buckets of features, remembered for as many as fit."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        b = zlib.crc32(feature) % self.buckets
        if len(self) < KNOWN and len(feature) <= LONGEST:
            self[feature] = b
        return b


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    text, start = text.translate(LETTERS), 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def features(text: bytes, sizes: tuple[int, int]) -> Iterator[tuple[int, list[bytes]]]:
    """Pairs of a number of words and the features that end within them, for a text in UTF-8."""
    least, most = sizes
    tail: list[bytes] = []
    for words in _word_lists(text):
        joined = tail + words
        found = words if sizes == (1, 1) else [b" ".join(joined[i : i + n]) for n in range(least, most + 1) for i in range(max(0, len(tail) - n + 1), len(joined) - n + 1)]
        yield len(words), found
        tail = joined[max(0, len(joined) - most + 1) :] if most > 1 else []


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()]


def bucket_counts(df: DataFrame, text: str = "text", sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = _Buckets(buckets), np.zeros(buckets, np.int64)
        of, waiting = [], 0
        for batch in batches:
            for t in _bytes(batch.column(0)):
                for _, found in features(t, sizes):
                    of.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                    waiting += len(found)
                    if waiting >= SUMMED:
                        total += np.bincount(np.concatenate(of), minlength=buckets)
                        of, waiting = [], 0
        if of:
            total += np.bincount(np.concatenate(of), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["counts"])

    vectors = in_arrow(df.select(text), count, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(buckets, np.int64)


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logarithms of each bucket's share in the target over that in the corpus, in thousandths, rounded down."""
    n, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = [(t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)) for s, t in zip(corpus.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def noise(doc_id, seed: int) -> int:
    """Gumbel noise of an id, in thousandths, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


_SCORED = (("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()))


def scored(docs: DataFrame, of_bucket: np.ndarray, id_col: str = "doc_id", text: str = "text", sizes: tuple[int, int] = SIZES, seed: int = SEED, keep: list[str] | None = None, out: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` (default: the id) with n_words, n_features, weight and score, under the names ``out``."""
    keep = [id_col] if keep is None else keep
    names = out or tuple(n for n, _ in _SCORED)
    id_, text_ = unused(keep, "_id", "_text")
    shared, buckets = docs.sparkSession.sparkContext.broadcast(of_bucket), len(of_bucket)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, gain = _Buckets(buckets), shared.value
        for batch in batches:
            rows = len(batch)
            n_words, n_features, sums = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows)
            at, of, waiting = [], [], 0
            for i, t in enumerate(_bytes(batch.column(text_))):
                for words, found in features(t, sizes):
                    n_words[i] += words
                    n_features[i] += len(found)
                    at.append((i, len(found)))
                    of.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
                    waiting += len(found)
                    if waiting >= SUMMED:
                        sums += _summed(at, of, gain, rows)
                        at, of, waiting = [], [], 0
            sums += _summed(at, of, gain, rows)
            weight = sums.astype(np.int64) // np.maximum(n_features, 1)
            score = weight + np.fromiter((noise(d, seed) for d in batch.column(id_).to_pylist()), np.int64, rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, (n_words, n_features, weight, score))], [*keep, *names])

    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return in_arrow(docs.select(*keep, F.col(id_col).alias(id_), F.col(text).alias(text_)), score, schema)


def _summed(at: list[tuple[int, int]], of: list[np.ndarray], gain: np.ndarray, rows: int) -> np.ndarray:
    if not at:
        return np.zeros(rows)
    rows_of, counts = np.array(at).T
    return np.bincount(np.repeat(rows_of, counts), weights=gain[np.concatenate(of)], minlength=rows)


def _starts(table_: DataFrame, least_words: int, take: int) -> DataFrame:
    """(score, before): the drawn scores and how many documents score more. A row per score: under 200,000 at any size."""
    by_score = table_.where(F.col("n_words") >= least_words).groupBy("score").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return by_score.select("score", (F.sum("n").over(down) - F.col("n")).alias("before")).where(F.col("before") < take)


def ranked(table_: DataFrame, take: int, id_col: str = "doc_id", least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds ``rank`` to a written table of scores: 1, 2, .. by falling score, then id, for the ``take`` first; else null."""
    starts = _starts(table_, least_words, take)
    cut = starts.agg(F.min("score").alias("cut")).first()["cut"] if take else None
    rank = F.lit(None).cast("long")
    if cut is None:
        return table_.withColumn("rank", rank)
    high = (F.col("n_words") >= least_words) & (F.col("score") >= cut)
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last(id_col), "n_features", "weight").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = table_.where(high).groupBy(*table_.columns).agg(F.count("*").alias("c"))  # rows that repeat are one
    one = one.join(F.broadcast(starts), "score").withColumn("at", F.col("before") + F.sum("c").over(order) - F.col("c"))
    one = one.withColumn("i", F.explode(F.expr(f"sequence(0L, c - 1, {COPIES}L)"))).withColumn("i", F.explode(F.expr(f"sequence(i, least(i + {COPIES - 1}, c - 1))")))
    one = one.withColumn("rank", F.col("at") + F.col("i") + 1).withColumn("rank", F.when(F.col("rank") <= take, F.col("rank")))
    return table_.where(~high).withColumn("rank", rank).unionByName(one.select(*table_.columns, "rank"))


def importance(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every document."""
    of_bucket = gains(bucket_counts(docs, text, sizes, buckets), bucket_counts(target, target_text, sizes, buckets))
    enough = F.count_if(F.col("n_words") >= least_words)
    table_, _, seen = counted(scored(docs, of_bucket, id_col, text, sizes, seed), "scores", enough=enough)
    return ranked(table_, percent * seen["enough"] // 100, id_col, least_words)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", target_text: str = "text", sizes: tuple[int, int] = SIZES, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """The drawn documents, whole: ``percent`` of those of ``least_words`` and more that are like the target.

    The last drawn score and id are found from the scores; texts are then read once more and never shuffled. Of rows that
    repeat the last drawn id all are drawn.
    """
    of_bucket = gains(bucket_counts(docs, text, sizes, buckets), bucket_counts(target, target_text, sizes, buckets))
    names = tuple(unused(docs.columns, "_n_words", "_n_features", "_weight", "_score"))
    rows = scored(docs, of_bucket, id_col, text, sizes, seed, docs.columns, names)
    table_, _, seen = counted(scored(docs, of_bucket, id_col, text, sizes, seed), "scores", enough=F.count_if(F.col("n_words") >= least_words))
    take = percent * seen["enough"] // 100
    last = ranked(table_, take, id_col, least_words).where(F.col("rank") == take).first() if take else None
    if last is None:
        return docs.limit(0)
    same = F.col(names[3]) == last["score"]
    same = same & (F.col(id_col).isNotNull() & (F.col(id_col) <= F.lit(last[id_col])) if last[id_col] is not None else F.lit(True))
    return rows.where((F.col(names[0]) >= least_words) & ((F.col(names[3]) > last["score"]) | same)).select(*docs.columns)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


ORACLE = r"""
WITH RECURSIVE bits AS (SELECT n AS i, n AS c, 0 AS k FROM range(256) t(n)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS crc_table FROM bits WHERE k = 8),
texts AS (SELECT 'd' AS kind, row_number() OVER () AS row_no, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
lists AS MATERIALIZED (SELECT kind, row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
words AS MATERIALIZED (SELECT kind, row_no, unnest(w) AS w FROM lists),
hexed AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM words),
bucket AS MATERIALIZED (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1])), 4294967295) % 10000 AS b FROM hexed, crc),
counts AS (SELECT b, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM words JOIN bucket USING (w) GROUP BY b),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gain AS (SELECT b, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS g FROM counts, sums),
weights AS (SELECT row_no, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM words JOIN bucket USING (w) JOIN gain USING (b) WHERE kind = 'd' GROUP BY row_no),
scores AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM lists LEFT JOIN weights USING (row_no) WHERE kind = 'd'),
drawn AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) END AS r FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= (SELECT 10 * count(*) // 100 FROM scores WHERE n_features >= 20) THEN r END AS rank FROM drawn
"""
