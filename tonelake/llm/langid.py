"""Language ID: nearest of several centroids per language, by cosine of normalised TF-IDF vectors of character n-grams.

A text is lower-cased, runs of anything but letters become one space, and its 1-, 2- and 3-grams are counted in DIM
hashed places over the whole text. Places weigh log(1 + count) times their IDF. Each language's sample is clustered by
spherical k-means into CENTROIDS. The prediction is the language of the nearest centroid, its score the cosine, cut
to 0..1. ``rejected`` marks texts without a letter and those whose cosine is below ``model.floor``: a fraction of the
least cosine that a sampled text has to a centroid of its own language, so that only texts unlike all that was learned go.

The classifier is fit on a bounded sample: about FIT_ROWS labelled rows in all, in equal shares per language, chosen
by a hash of doc_id. Only their DIM-long vectors reach the driver. Prediction covers every row.

Null texts and texts with no letter get ``und`` with score 0 and are rejected. Rows with a null language are not
learned from; a null doc_id counts as not held out and is not learned from. With no labelled row at all, all is ``und``.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tonelake.llm.common import in_arrow, table

DIM = 4096
CENTROIDS = 4
FIT_ROWS = 1200
#: Share of the least cosine seen in fitting below which a text is rejected.
SLACK = 0.5
UNKNOWN = "und"


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts; None without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return None
    c = np.where(letter, points, 32)
    c = np.concatenate([[32], c[letter | np.concatenate([[True], letter[:-1]])], [32]]).astype(np.uint32)
    grams = [c * np.uint32(0x9E3779B1)]
    grams.append((grams[0][:-1] ^ np.uint32(0x55555555)) + c[1:] * np.uint32(0x85EBCA77))
    grams.append((grams[1][:-1] ^ np.uint32(0x33333333)) + c[2:] * np.uint32(0xC2B2AE3D))
    return np.bincount(((np.concatenate(grams) * np.uint32(0x27D4EB2F)) >> np.uint32(20)).astype(np.int64), minlength=DIM)


@dataclass
class Model:
    languages: list[str]
    centroids: np.ndarray
    of: np.ndarray
    idf: np.ndarray
    floor: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        found = [counts(t) for t in texts]
        some = [i for i, c in enumerate(found) if c is not None]
        if some and self.languages:
            cosines = unit(np.log1p(np.stack([found[i] for i in some])) * self.idf) @ self.centroids.T
            best = cosines.argmax(axis=1)
            for i, b, s in zip(some, best, cosines.max(axis=1)):
                langs[i], scores[i] = self.languages[self.of[b]], min(1.0, max(0.0, float(s)))
        return langs, scores


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def clustered(x: np.ndarray, k: int, seed: int = 7, rounds: int = 12) -> np.ndarray:
    """Spherical k-means: unit centroids of unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, vectors = [], []
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if (c := counts(text)) is not None:
                langs.append(lang)
                vectors.append(np.log1p(c).astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(vectors, pa.binary())], names=["lang", "vector"])


def fit(labelled: DataFrame, rows: int = FIT_ROWS, centroids: int = CENTROIDS) -> Model:
    """A model of (doc_id, text, lang); rows with a null are left out."""
    labelled = labelled.select("doc_id", "text", "lang").where("lang IS NOT NULL AND doc_id IS NOT NULL")
    have = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row per language
    languages = sorted(have)
    if not languages:
        return Model([], np.zeros((0, DIM)), np.zeros(0, int), np.ones(DIM), 0.0)
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, rows / len(languages) / have[lang]))).otherwise(share)
    chosen = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < share * 1_000_000
    sample = in_arrow(labelled.where(chosen).select("text", "lang"), _vectors, "lang string, vector binary").collect()
    if not sample:
        return fit(labelled, rows * 4, centroids) if rows < 10**9 else Model([], np.zeros((0, DIM)), np.zeros(0, int), np.ones(DIM), 0.0)
    sample.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    x = np.stack([np.frombuffer(r["vector"], np.float16) for r in sample]).astype(np.float32)
    of_row = np.array([languages.index(r["lang"]) for r in sample])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x = unit(x * idf)
    parts = [clustered(x[of_row == i], centroids) if (of_row == i).any() else np.zeros((0, DIM), np.float32) for i in range(len(languages))]
    c, of = np.concatenate(parts), np.repeat(np.arange(len(languages)), [len(p) for p in parts])
    own = np.where(of[None, :] == of_row[:, None], x @ c.T, -1).max(axis=1)
    return Model(languages, c.astype(np.float32), of, idf, float(own.min()) * SLACK)


def identified(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """Adds the predicted language, score and rejection, under the names ``out``, to every row; reads nothing but the text.

    Columns that already have one of these names are replaced.
    """
    docs = docs.drop(*out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out[0], T.StringType()), T.StructField(out[1], T.DoubleType()), T.StructField(out[2], T.BooleanType())])

    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(batch.column(at).to_pylist())
            gone = [lang == UNKNOWN or s < model.floor for lang, s in zip(langs, scores)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())], names=schema.names)

    return in_arrow(docs, run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is never learned from."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return identified(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
