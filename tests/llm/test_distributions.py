"""Importance resampling and whitening against plain versions, and the cases of odd rows."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import resampling, whitening
from tonelake.llm.common import fresh_path

DOCS = "doc_id long, text string, source string"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_importance(docs, target, sizes=(1, 1), buckets=10_000, least=20, percent=10):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for of, texts in ((s, [r[1] for r in docs]), (t, target)):
        for x in texts:
            for b in features(x):
                of[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (int(s.sum()) + buckets) / ((s[b] + 1) * (int(t.sum()) + buckets)))) for b in range(buckets)]
    rows = []
    for doc_id, text, *_ in docs:
        f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_of(text))])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return sorted([(*r[:4], ranks.get(id(r))) for r in rows], key=repr)


def found(df):
    return sorted([(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()], key=repr)


@pytest.fixture(scope="module")
def odd_docs():
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"Wort{k}" for k in rng.zipf(1.4, rng.integers(1, 60)) % 300), "s") for i in range(400)]
    rows += [(7, rows[7][1], "s")] * 40 + [(900, None, None), (901, "", "s"), (902, " ... ", "s"), (None, "null id " * 20, "s"), (None, "null id " * 20, "s"), (903, "İ é ß 漢字 x9Y" * 30, "s")]
    rows += [(904, "lang wort " * 150_000 + "a" * 2_000_000, "s"), (9, "another text of a repeated id " * 9, "s")]
    return rows


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (2, 3)])
def test_importance_by_brute_force(spark, odd_docs, sizes):
    docs = spark.createDataFrame(odd_docs, DOCS).repartition(7).withColumns({c: F.lit("own") for c in ("rank", "score", "n", "c", "_text")})
    target = [r[1] for r in odd_docs[::9]] + ["Wort3 wort4", None]
    got = resampling.importance(docs, spark.createDataFrame([(t,) for t in target], "text string"), sizes=sizes, percent=37)
    assert found(got) == plain_importance(odd_docs, target, sizes, percent=37)


def test_features_across_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = [f for _, fs in resampling.features(text, (1, 3)) for f in fs]
    monkeypatch.setattr(resampling, "PIECE", 100)
    pieces = [f for _, fs in resampling.features(text, (1, 3)) for f in fs]
    assert sorted(whole) == sorted(pieces) and len(whole) == 5000 + 4999 + 4998


def test_drawn_documents_are_those_ranked(spark, odd_docs):
    docs, target = spark.createDataFrame(odd_docs, DOCS).withColumn("_score", F.lit(1)), spark.createDataFrame([("Wort1 wort2",)], "text string")
    ranks = resampling.importance(docs, target, percent=25).where("rank IS NOT NULL")
    got = resampling.resampled(docs, target, percent=25)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.where("doc_id != 7").collect()) == sorted(r.doc_id for r in ranks.where("doc_id != 7").collect())
    assert resampling.resampled(docs, target, percent=0).count() == 0


def test_importance_of_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert found(resampling.importance(none, docs)) == [] and resampling.resampled(none, docs).count() == 0
    assert found(resampling.importance(docs, none)) == plain_importance([(1, "a b")], [])


def plain_whitening(rows, scale=256):
    x = {i: tuple(math.floor(scale * float(c)) for c in v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    fit = np.array(sorted(set(x.values())))
    n, s = len(fit), [sum(int(v) for v in col) for col in fit.T]
    cov = (fit - fit.mean(0)).T @ (fit - fit.mean(0)) / n
    e, q = np.linalg.eigh(cov)
    return x, n, s, e[::-1], q[:, ::-1], np.trace(cov)


def test_whitening_by_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    d = len(table.where("embedding IS NOT NULL").first()["embedding"])
    odd = [(-1, None), (-2, [None] * d), (-3, [float("nan")] + [0.0] * (d - 1)), (-4, [float("inf")] * d), (-5, []), (-6, [1.0, 2.0])]
    copies = table.limit(1).withColumn("vec_id", F.explode(F.expr("sequence(10000L, 10300L)")))
    all_rows = table.union(spark.createDataFrame(odd, table.schema)).union(copies).repartition(5)
    path = fresh_path(spark, "vectors-test")
    all_rows.withColumns({"_x": F.lit(1), "x": F.lit("own"), "whitened": F.lit(2)}).write.parquet(f"{path}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in all_rows.collect() if r.vec_id not in (-5, -6)]
    x, n, s, e, q, trace = plain_whitening(rows)
    got = whitening.op12_embedding_whitening(spark, path).collect()
    assert sorted({(r.vec_id) for r in got}) == sorted(x) and len(got) == 4 * len(x)
    for k in range(1, 5):
        ours = {r.vec_id: r for r in got if r.component == k}
        plain = {i: (np.array(v) - np.array(s) / n) @ q[:, k - 1] / math.sqrt(e[k - 1]) for i, v in x.items()}
        top = max(plain, key=lambda i: abs(plain[i]))
        sign = math.copysign(1, ours[top].whitened * plain[top])
        for i, v in x.items():
            assert ours[i].n == n and ours[i].deviation == sum((n * a - b) ** 2 for a, b in zip(v, s))
            assert abs(sign * ours[i].whitened - plain[i]) < 1e-8 and abs(ours[i].explained - e[k - 1] / trace) < 1e-10 and ours[i].identity_error < 1e-8


@pytest.mark.parametrize("n", [1, 2, 3, 8, 40])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    for a in (rng.normal(size=(n, n)), np.ones((n, n)), np.zeros((n, n)), np.diag(rng.integers(0, 3, n).astype(float)), np.outer(range(n), range(n)) * 1e9):
        a = a + a.T
        e, q = whitening.symmetric_qr(a)
        size = max(1.0, np.abs(a).max())
        assert np.abs(q.T @ q - np.eye(n)).max() < 1e-12 and np.abs(q @ np.diag(e) @ q.T - a).max() < 1e-12 * size * n and (np.diff(e) <= 0).all()
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1], atol=1e-11 * size * n)


def test_moments_merge():
    rng = np.random.default_rng(1)
    rows = rng.integers(-1000, 1000, (200, 5)) + 10**9
    parts = [whitening.welford(whitening.Moments.none(5), rows[i : i + 30]) for i in range(0, 200, 30)]
    of = whitening.Moments.none(5)
    for p in parts:
        of = of.merged(p)
    centred = rows - rows.mean(0)
    assert of.n == 200 and list(of.sums) == [int(v) for v in rows.sum(0)] and np.allclose(of.scatter, centred.T @ centred, rtol=1e-6)


def test_deviation_beyond_64_bits():
    assert whitening.deviations(np.array([[3_000_000_000, 0], [1, 1]]), 2, [0, 1]) == [None, 4 + 1]
    assert whitening.deviations(np.array([[2_000_000_000, 0]]), 1, [0, 3]) == [4 * 10**18 + 9]


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id long, embedding array<float>")
    for df in (one, one.limit(0), one.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"))):
        path = fresh_path(spark, "flat")
        df.write.parquet(f"{path}/embeddings.parquet")
        got = whitening.op12_embedding_whitening(spark, path)
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    flat = one.union(spark.createDataFrame([(3, [5.0, 2.0]), (3, [5.0, 2.0])], one.schema))
    path = fresh_path(spark, "flat")
    flat.write.parquet(f"{path}/embeddings.parquet")
    got = whitening.op12_embedding_whitening(spark, path).collect()
    assert len(got) == 5 and {r.component for r in got} == {1} and {round(abs(r.whitened), 9) for r in got} == {1.0}
