"""Corpus preparation in five stages, each reading the table that the one before it wrote.

Language ID drops documents unlike every learned language; near-dedup keeps one document of each group of near copies;
substring dedup cuts out repeated passages; mixing repeats or drops documents to meet the sources' target weights;
packing cuts what is left into token pieces and assigns them to sequences. All but the last return the columns
of documents, and any others that the table has. Documents with a null or empty text have no letter, so language ID drops
them. Of rows that repeat a doc_id near-dedup keeps one; rows with a null doc_id pass near-dedup and substring dedup. Texts
that substring dedup leaves without a word go. Very long texts are handled whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonelake.llm import langid, mixing, neardup, packing, passages
from tonelake.llm.common import shrink, table, unused, written

#: The tokenizer, the packing and the seeded choices are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None
#: Chunks of text whose ids packing keeps in a worker, twice: fewer than alone, since the stages before leave executors large.
KEPT = 50_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.where(~langid.held_out()))
    names = unused(docs.columns, "_lang", "_score", "_rejected")
    found = langid.identified(docs, model, out=tuple(names))
    return found.where(f"NOT {names[2]}").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return passages.without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink(spark)
    return packing.packed_documents(docs, keep_ids=False, kept=KEPT)


STAGES = [("language ID", language_id), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
