"""Registered queries: SQL where there is some, contracts on the test tables, and the pipeline as a whole."""

import os
import struct
import zlib

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tonelake.llm import queries, tokens


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    got, want = queries.QUERIES[name](spark, sf_dir).collect(), duck.sql(queries.ORACLE_SQL[name])
    cols = sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in got), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_each_query_keeps_every_document(spark, sf_dir):
    docs = pd.read_parquet(f"{sf_dir}/documents.parquet")
    for n in (1, 3, 6, 8, 9, 10, 11, 13):
        name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
        got = queries.QUERIES[name](spark, sf_dir).toPandas()
        assert sorted(got.doc_id) == sorted(docs.doc_id), name


def test_registered():
    assert {f"op{n}" for n in range(1, len(queries.QUERIES) + 1)} == {q.split("_")[0] for q in queries.QUERIES} and "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, table = docs.columns, docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        table, _ = corpus_pipeline.written(stage(spark, table, sf_dir), "test")
        sizes.append(table.count())
        if name != "packing":
            assert table.columns == names
        if name == "mixing":
            mixed = table.collect()
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[0] == docs.count()
    out = table.collect()
    pieces = {}
    encode = tokens.encoder(tokens.default_path()).of.encode
    for r in mixed:
        ids = [*encode(r.text, add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            key = (r.doc_id, k // 4096, k, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
            pieces[key] = pieces.get(key, 0) + 1
    got = {}
    for r in out:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == pieces
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.count() == len(out)


def test_pipeline_empty(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
