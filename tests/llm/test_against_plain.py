"""Queries by their own columns against plain versions, language ID computed another way, and the pipeline on odd rows."""

import collections
import math
import random
import re
import struct
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonelake.llm import langid, mixing, queries, tokens
from tonelake.llm.common import fresh_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def grams(text):
    """Counts of the 1- to 3-grams of a text by place, with plain integers."""
    text = (text or "").lower()
    if not any(unicodedata.category(c)[0] == "L" for c in text):
        return None
    s = " " + re.sub(r" +", " ", "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text)).lstrip(" ") + " "
    s = [ord(c) for c in (s if text and unicodedata.category(text[0])[0] == "L" else " " + s[1:])]
    out, m = collections.Counter(), 0xFFFFFFFF
    for i in range(len(s)):
        h = s[i] * 0x9E3779B1 & m
        out[(h * 0x27D4EB2F & m) >> 20] += 1
        for mark, by in ((0x55555555, 0x85EBCA77), (0x33333333, 0xC2B2AE3D)):
            i += 1
            if i >= len(s):
                break
            h = ((h ^ mark) + s[i] * by) & m
            out[(h * 0x27D4EB2F & m) >> 20] += 1
    return out


def cosine(a, b):
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def unit(v):
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {k: x / norm for k, x in v.items()}


def test_language_id_by_plain_tf_idf(spark):
    rng = random.Random(7)
    kinds = {"aa": "bada gabo dami raba tulo".split(), "bb": "stro pliks trenk grumf".split(), "cc": "éçà ouèr çaié éiou".split()}
    rows = [(i, ", ".join(rng.choice(kinds[k]) for _ in range(rng.randrange(4, 30))), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identified(docs, langid.fit(docs)).collect()}
    counted = {i: grams(t) for i, t, _ in rows}
    logs = {i: {k: float(np.float16(np.float32(math.log1p(n)))) for k, n in c.items()} for i, c in counted.items()}
    df = collections.Counter(k for v in logs.values() for k in v)
    idf = {k: math.log((1 + len(rows)) / (1 + n)) + 1 for k, n in df.items()}
    fitted = {i: unit({k: x * idf[k] for k, x in v.items()}) for i, v in logs.items()}
    centroids = []
    for lang in sorted(kinds):
        own = sorted((np.array([logs[i].get(k, 0) for k in range(langid.DIM)]).astype(np.float16).tobytes(), i) for i, _, k in rows if k == lang)
        x = [fitted[i] for _, i in own]
        c = [x[j] for j in np.random.default_rng(7).choice(len(x), min(langid.CENTROIDS, len(x)), replace=False)]
        for _ in range(12):
            near = [max(range(len(c)), key=lambda j: (cosine(v, c[j]), -j)) for v in x]
            for j in range(len(c)):
                total = collections.Counter()
                for v, n in zip(x, near):
                    if n == j:
                        total.update(v)
                c[j] = unit(total) if total else c[j]
        centroids += [(lang, v) for v in c]
    for i, _, _ in rows:
        v = unit({k: math.log1p(n) * idf[k] for k, n in counted[i].items()})
        lang, best = max(((k, cosine(v, c)) for k, c in centroids), key=lambda p: p[1])
        assert got[i].lang_pred == lang and abs(got[i].score - best) < 5e-3, (i, got[i].score, best)


def test_token_files_by_their_columns(spark, sf_dir):
    encode = tokens.encoder(tokens.default_path()).of.encode
    start = 0
    got = sorted(queries.QUERIES["op8_token_files"](spark, sf_dir).collect(), key=lambda r: r.doc_id)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert [r.doc_id for r in got] == sorted(docs)
    for r in got:
        ids = [*encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_mixing_by_its_columns(spark, sf_dir):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()}
    size = {i: len(WORDS.findall(r.text or "")) for i, r in docs.items()}
    of = collections.Counter()
    for i, r in docs.items():
        of[r.source] += size[i]
    order = sorted(of, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.shared_out([of[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(of.values()))))
    taken = collections.Counter()
    got = queries.QUERIES["op10_mixing"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        source = docs[r.doc_id].source
        assert (r["size"], r.source_size) == (size[r.doc_id], of[source]) and abs(r.target - targets[source]) < 1e-6
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[source] += r.taken
    for s in order:  # whole copies while they fit, then as near below the target as any choice of documents comes
        left = round(targets[s]) - min(2, round(targets[s]) // of[s]) * of[s] if of[s] else 0
        reach = 1
        for i, r in docs.items():
            if r.source == s and left:
                reach |= reach << size[i]
        best = max(k for k in range(left + 1) if reach >> k & 1)
        assert taken[s] == round(targets[s]) - left + best, (s, taken[s], targets[s])


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def odd(spark, sf_dir):
    rng = random.Random(1)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = docs.orderBy("doc_id").limit(60).collect()
    vocabulary = sorted({w for r in base if r.lang == "en" and r.text for w in r.text.split()})
    long = " ".join(rng.choice(vocabulary) for _ in range(1_600_000))
    rows = [tuple(r) for r in base] + [tuple(base[3])] * 3 + [(None, base[5].text, "en", None, 1), (None, None, None, None, None), (70_001, "", "en", "s", 0), (70_002, " \n\t ", None, "s", 4), (70_003, "123 456 !!", "en", "s", 10), (70_004, long, "en", "very long", len(long))]
    path = fresh_path(spark, "odd")
    odd = spark.createDataFrame(rows, docs.schema).withColumns({"_spans": F.lit("own"), "_p_n": F.lit(5), "_copy": F.lit(1)}).repartition(5)
    odd.write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_pipeline_on_odd_rows(spark, odd):
    """Nulls, empty, repeated and very long texts, null ids and clashing columns, each stage on what the one before kept."""
    path, rows = odd
    assert max(len(r[1] or "") for r in rows) > 8_000_000
    table, kept = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = table.columns
        table, _ = corpus_pipeline.written(stage(spark, table, path), "odd-stage")
        assert name == "packing" or table.columns == before
        kept[name] = table.collect()
    with_letter = [r for r in rows if r[1] and any(unicodedata.category(c)[0] == "L" for c in r[1][:2000])]
    assert sorted(str(r.doc_id) for r in kept["language ID"]) == sorted(str(r[0]) for r in with_letter)
    sets = {r.doc_id: shingles(r.text) for r in kept["language ID"] if r.doc_id is not None and r.doc_id != 70_004}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = sorted([*{find(i) for i in ids}, 70_004])
    assert sorted(r.doc_id for r in kept["near-dedup"] if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in kept["near-dedup"]) == 1
    left = {r.doc_id: r.text for r in kept["substring dedup"]}
    assert set(left) <= {r.doc_id for r in kept["near-dedup"]} and len(left[70_004]) > 8_000_000
    copies = collections.Counter((r.doc_id, r.text) for r in kept["mixing"])
    assert all(n <= 2 and left[i] == t for (i, t), n in copies.items())
    encode, pieces = tokens.encoder(tokens.default_path()).of.encode, collections.Counter()
    for (i, t), n in copies.items():
        total = len(encode(t, add_special_tokens=False).ids) + 1
        for k in range(0, total, 4096):
            pieces[i, k // 4096, k, min(4096, total - k)] += n
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length) for r in kept["packing"]) == pieces
