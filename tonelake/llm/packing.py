"""Best-fit packing: vector best-fit of token pieces into sequences.

A sequence has three capacities: tokens, documents, and attention cost (the sum of squared piece lengths, since
attention within a sequence is masked by document). Pieces come longest first. Of the open sequences in which a piece
fits under every capacity, the one is taken whose residual vector suits it best: by the smallest weighted norm of
what is left after placing it, or by the largest weighted dot product of piece and residual. If none fits, a
sequence is opened; a piece that no empty sequence could hold raises an error.

Pieces are dealt at random but repeatably into groups of about GROUP and each group is packed in one task, so tasks
have bounded size whatever the keys, and a group ends with about one sequence that isn't full.

Null texts count as empty: their end id is packed alone. Rows that repeat are packed each. An empty table gives an
empty result. Columns other than those named are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.llm.common import table, written
from tonelake.llm.tokens import KEPT, default_path, with_pieces
from tonelake.session import ready

GROUP = 20_000
MOST_TOKENS = 4096


def best_fit(lengths: np.ndarray, most_tokens: int, most_docs: int, most_cost: int, weights: tuple = (1.0, 0.01, 0.01), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece, from 0, and its offset there."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    w = np.asarray(weights, float)
    caps = np.array([most_tokens, most_docs, most_cost], float)
    left = np.empty((3, 1024))  # residuals of the open sequences, as shares of the capacities
    number, open_, made = np.empty(1024, np.int64), 0, 0
    least = int(lengths.min()) if n else 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        item = np.array([size, 1, size * size], float) / caps
        if (item > 1).any():
            raise ValueError(f"a piece of {size} tokens fits in no sequence")
        at = -1
        if open_:
            res = left[:, :open_]
            fits = (res >= item[:, None] - 1e-12).all(axis=0)
            if fits.any():
                score = w @ (res - item[:, None]) ** 2 if rule == "norm" else -((w * item) @ res)
                at = int(np.argmin(np.where(fits, score, np.inf)))
        if at < 0:
            if open_ == left.shape[1]:
                left, number = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([number, np.empty_like(number)])
            at, open_ = open_, open_ + 1
            left[:, at], number[at], made = 1.0, made, made + 1
        bins[i], offsets[i] = number[at], most_tokens - round(left[0, at] * most_tokens)
        left[:, at] -= item
        if round(left[0, at] * most_tokens) < least or left[1, at] * most_docs < 0.5:  # nothing more can go in
            open_ -= 1
            left[:, at], number[at] = left[:, open_], number[open_]
    return bins, offsets


def packed(cut: DataFrame, most_tokens: int = MOST_TOKENS, most_docs: int | None = None, most_cost: int | None = None, weights: tuple = (1.0, 0.01, 0.01), rule: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to pieces that have a ``length``. ``cut`` must give the same rows when read again.

    Without limits of their own, documents and attention cost are bounded by the tokens alone.
    """
    ready(cut.sparkSession)
    limits = (most_tokens, most_docs or most_tokens, most_cost or most_tokens**2, weights, rule)
    groups = max(1, -(-cut.count() // GROUP))
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def pack(rows: pa.Table) -> pa.Table:
        bins, offsets = best_fit(rows["length"].to_numpy(), *limits)
        group = rows["_group"][0].as_py()
        return rows.drop_columns("_group").append_column("sequence_id", pa.array(group * 2**32 + bins)).append_column("offset", pa.array(offsets))

    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long")
    return cut.withColumn("_group", dealt).groupBy("_group").applyInArrow(pack, schema)


def packed_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, most_tokens: int = MOST_TOKENS, keep_ids: bool = True, kept: int = KEPT, **limits) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset) of (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    cut, _ = written(with_pieces(docs, tokenizer or default_path(), end_id, most_tokens, keep_ids, kept=kept), "pieces")
    return packed(cut, most_tokens, **limits)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"), keep_ids=False)
