"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tonelake.plans import catalog


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same(spark_df, relation) -> None:
    cols = sorted(spark_df.columns)
    assert cols == sorted(relation.columns)
    at = [relation.columns.index(c) for c in cols]
    got = sorted((tuple(plain(r[c]) for c in cols) for r in spark_df.collect()), key=repr)
    want = sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    same(catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(catalog.FIXTURES))
def test_fixtures(spark, sf_dir, duck, name):
    query, sql = catalog.FIXTURES[name]
    same(query(spark, sf_dir), duck.sql(sql))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).columns
