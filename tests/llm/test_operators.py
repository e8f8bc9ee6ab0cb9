"""The ten operators against brute force, on small tables with nulls, ties, repeats, long and empty texts."""

import base64
import gzip
import hashlib
import io
import random
import re
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tonelake.llm import components, fingerprints, langid, media, mixing, neardup, packing, passages, shingles, tokenfiles, tokens, urlrules, warc
from tonelake.llm.common import fresh_path, written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return [rng.choice("ka lo mi ru se ta vu ze na po".split()) + rng.choice("x y z w q".split()) + str(rng.randrange(40)) for _ in range(n)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        w = words(rng, rng.randrange(1, 120))
        rows.append((i, " ".join(w), rng.choice(["a", "b"]), rng.choice(["s1", "s2", "s3", None]), None))
        if i % 3 == 0:
            v = list(w)
            for _ in range(len(v) // 40):
                v[rng.randrange(len(v))] = "edit"
            rows.append((1000 + i, " ".join(v) + ("" if i % 2 else " "), "a", "s1", 1))
    base = words(rng, 80)
    for k in range(12):  # a group whose members are near some others only
        v = list(base)
        for j in range(k):
            v[j * 6 % 80] = f"only{k}"
        rows.append((2000 + k, " ".join(v), "b", "s2", 2))
    rows += [(3000, None, None, None, None), (3001, "", "a", "s1", 0), (3002, " \t\n", "b", "s1", 3), (3003, "One", "a", None, 3), (3004, "oNE", "a", "s9", 3), (3005, "x" * 50_000, "a", "s1", 1), (3006, " ".join(words(rng, 9000)), "a", "s1", 1)]
    rows += [(rows[0][0], rows[0][1], "a", "s1", 1), (None, rows[1][1], "a", "s1", 1), (3007, "é" * 40 + " ñ 漢字 😀", "b", "s1", 1)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({c: F.lit(7) for c in ("id", "n", "size", "copies", "component", "score", "ids", "group")}).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_groups(rows):
    by = {}
    for i, t, *_ in rows:
        if i is not None:
            by.setdefault(i, set()).update(shingle_set(t))
    up = {i: i for i in by}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in by:
        for b in by:
            if a < b and by[a] and 100 * len(by[a] & by[b]) >= 75 * len(by[a] | by[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in by}


@pytest.mark.parametrize("hot", [2, 32])
def test_neardup_brute_force(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(neardup, "HOT", hot)
    got = neardup.grouped(docs.select(F.col("doc_id").alias("id"), "text")).collect()
    want = brute_groups(corpus())
    assert len(got) == len(corpus())
    assert {r.id: r.component for r in got if r.id is not None} == want
    assert all(r.component is None for r in got if r.id is None)
    assert len({v for v in want.values()}) < len(want)


def test_neardup_empty_and_dedup(spark, docs, empty):
    assert neardup.grouped(empty.select(F.col("doc_id").alias("id"), "text")).count() == 0
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    want = brute_groups(corpus())
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == sorted(i for i, c in want.items() if i == c)
    assert kept.where("doc_id IS NULL").count() == 1


def test_shingle_batches_agree():
    texts = [None, b"", b"a b", b"a b c d e f g", b"A b  c\x0bd e f g", " ".join(map(str, range(3000))).encode(), b"x x x x x x x"]
    values, sizes = shingles.sets_of(texts)
    at = 0
    for t, n in zip(texts, sizes):
        assert (values[at : at + n] == shingles.shingle_set(t)).all() and n == len(shingle_set((t or b"").decode()))
        at += n
    some = sizes > 0
    for h in (36, 128):
        least = shingles.minima_of(values, sizes[some], h)
        one = [shingles.minima(shingles.shingle_set(t), h) for t, s in zip(texts, some) if s]
        assert (least == np.stack(one)).all()


@pytest.mark.parametrize("seed, few", [(0, 200_000), (1, 200_000), (2, 0)])
def test_components(spark, seed, few, monkeypatch):
    monkeypatch.setattr(components, "FEW", few)
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(20)] + [(500, 500 + i) for i in range(1, 30)] + [(7, 7)]
    up = list(range(600))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got, _ = components.components(spark.createDataFrame([*links, (None, 3)], "a long, b long"), len(links) + 1)
    want = {i: find(i) for p in links if p[0] != p[1] for i in p}
    assert {r.id: r.component for r in got.collect()} == want


def spark_hash(*values, seed=42):
    """Spark's xxhash64 of strings and longs in turn."""
    h = seed
    for v in values:
        h = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h).intdigest()
        h -= (h >> 63) << 64
        h %= 1 << 64
    return h - ((h >> 63) << 64)


def tokens_of(text):
    out, cut = [], set("bdfhjlnprtvxz0123456789" + "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()))
    for word in re.findall(r"[^\x20\x09-\x0D]+", text.lower()):
        if len(word) <= 16:
            out.append(word)
            continue
        piece = ""
        for c in word:
            piece += c
            if c in cut or ord(c) > 127 or len(piece) == 32:
                out.append(piece)
                piece = ""
        out += [piece] * bool(piece)
    return out


def sketch_of(text):
    """The fingerprint's anchors by brute force: each k-mer's inner s-mers are compared."""
    k, s = fingerprints.K, fingerprints.S
    h = [spark_hash(t) for t in tokens_of(text or "")]
    places = {}
    for i in range(len(h) - k + 1):
        inner = [spark_hash(*h[i + d : i + d + s]) for d in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            places.setdefault(spark_hash(*inner[::s]), i)
    if h and not places:
        places = {spark_hash(*h): 0}
    return sorted(places.items())[: fingerprints.KEEP]


def likeness_of(a, b):
    if not a or not b:
        return float(not a and not b)
    both = sorted({x for x, _ in a} | {x for x, _ in b})[: fingerprints.KEEP]
    at, to = dict(a), dict(b)
    met = sorted((at[x], to[x] - at[x]) for x in both if x in at and x in to)
    near = lambda i, j: 0 <= j < len(met) and abs(met[i][1] - met[j][1]) <= fingerprints.SLACK
    return sum(len(met) == 1 or near(i, i - 1) or near(i, i + 1) for i in range(len(met))) / len(both)


def edited(rows):
    """All columns of the query by brute force; ties and nulls in descending hash of the text."""
    rows = sorted(((i, t or "") for i, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1])), reverse=True)
    written = lambda sketch: "".join(f"{h % (1 << 64):016x}{p:08x}" for h, p in sketch)
    out = []
    for k, (i, t) in enumerate(rows):
        n, nxt = len(t) // 3, rows[(k + 1) % len(rows)][1]
        new = t[: len(t) - n] + nxt[:n]
        a, b, c = sketch_of(t), sketch_of(new), sketch_of(nxt)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), written(a), written(b), likeness_of(a, b), likeness_of(a, c)))
    return out


@pytest.mark.parametrize("run_bytes", [1 << 28, 5000])
def test_fingerprints_brute_force(spark, docs, empty, run_bytes, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN_BYTES", run_bytes)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    rows = fingerprints.fingerprint_edits(docs).collect()
    assert sorted(map(tuple, rows), key=key) == sorted(edited(corpus()), key=key)
    by = {r.doc_id: r for r in rows}
    assert by[3000].fingerprint == by[3001].fingerprint == by[3002].fingerprint == "" and by[3003].fingerprint == by[3004].fingerprint != ""
    assert fingerprints.fingerprint_edits(empty).count() == 0
    assert "Python" not in fingerprints.fingerprint_edits(docs)._jdf.queryExecution().toString()


def test_next_of_many_equal_ids(spark):
    rng = random.Random(8)
    rows = [(None if i % 3 else i, f"text {rng.random()}") for i in range(400)]
    got = fingerprints.fingerprint_edits(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted((str(r[0]), r[2]) for r in edited(rows))


def test_a_change_in_a_text_without_spaces_stays_local(spark):
    rng = random.Random(6)
    chinese = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(4000))
    code = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/") for _ in range(4000))
    consonants = "".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(4000))
    rows = [(i, t) for i, t in enumerate([chinese, "新" + chinese, chinese[:900] + "新" + chinese[900:], code, "q" + code, consonants, "q" + consonants, "b" + consonants[:2000] + "m" + consonants[2000:]])]
    sketches = fingerprints.with_sketches(spark.createDataFrame(rows, "doc_id long, text string"), {"text": "sketch"}).collect()
    by = {r.doc_id: [(x["hash"], x["place"]) for x in r.sketch] for r in sketches}
    assert all(len(s) == fingerprints.KEEP for s in by.values())
    assert likeness_of(by[0], by[1]) > 0.9 and likeness_of(by[0], by[2]) > 0.9 and likeness_of(by[3], by[4]) > 0.9 and likeness_of(by[0], by[3]) == 0
    assert likeness_of(by[5], by[6]) > 0.9 and likeness_of(by[5], by[7]) > 0.9 and likeness_of(by[3], by[5]) < 0.1


def test_syncmer_rule_and_positions(spark):
    rng = random.Random(5)
    passage = words(rng, 60)
    a, b = words(rng, 30) + passage + words(rng, 9), words(rng, 50) + passage
    rows = fingerprints.with_anchors(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, None)], "doc_id long, text string")).cache()
    places = {r.doc_id: [x.place for x in r.anchors] for r in rows.collect()}
    inside = [p - 30 for p in places[1] if 30 <= p <= 30 + 60 - fingerprints.K]
    assert inside == [p - 50 for p in places[2] if 50 <= p <= 50 + 60 - fingerprints.K] and len(inside) > 10 and places[3] == []
    best = fingerprints.positional_matches(rows).orderBy(F.desc("hits")).first()
    assert (best.id, best.other_id, best.shift) == (2, 1, 20) and best.hits >= len(inside)


def test_passages(spark, empty):
    rng = random.Random(3)
    shared, near, short = words(rng, 70), words(rng, 90), words(rng, 8)
    bent = [*near[:40], "changed", *near[41:]]
    texts = {
        1: words(rng, 40) + shared + words(rng, 20), 2: shared + words(rng, 33), 3: words(rng, 100), 4: words(rng, 30) + short, 5: words(rng, 25) + short, 7: ["w"] * 300, 8: ["w"] * 280, 9: words(rng, 11) + shared,
    }
    rows = [(i, " ".join(w)) for i, w in texts.items()] + [(10, " ".join(words(rng, 30)) + "\n" + " ".join(near)), (11, " ".join(bent) + "\n" + " ".join(words(rng, 20))), (12, None), (13, ""), (None, " ".join(shared)), (3, " ".join(texts[3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeats(docs.withColumnRenamed("doc_id", "id")).collect()
    said_over = {7, 8}  # one word over and over: equal shingle sets
    assert {r.doc_id for r in found} == {1, 2, 9, 10, 11} | said_over
    assert {r.doc_id for r in found if not r.kept} == {2, 8, 9, 11} and all(r.component_id in (1, 7, 10) for r in found)
    by = dict(rows)
    for r in found:
        if r.kind == "run":
            assert any(" ".join(by[r.doc_id][r.start : r.stop].split()) in " ".join(p) for p in (shared, near))
    left = {r.doc_id: r.text for r in passages.without_repeats(docs.where("doc_id IS NOT NULL")).collect()}
    assert left[1] == by[1] and left[3] == by[3] and left[10] == by[10] and len(left[2].split()) < 60 and " ".join(near[50:]) not in left[11]
    assert 12 not in left and 13 not in left
    assert passages.repeats(empty.select(F.col("doc_id").alias("id"), "text")).count() == 0


def test_repeats_find_every_long_passage(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        p = words(rng, 51 + k % 20)
        for j in range(2):
            rows.append((2 * k + j, " ".join(words(rng, rng.randrange(10, 60)) + p + words(rng, rng.randrange(0, 60)))))
    rows += [(1000 + i, " ".join(words(rng, 150))) for i in range(40)]
    got = {r.doc_id for r in passages.repeats(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got <= set(range(80)) and len(got) >= 78


def test_repeats_find_all_long_passages(spark):
    rng = random.Random(10)
    turns = [["ka", "lo"], words(rng, 5), words(rng, 13)]  # words that repeat with a period have no strict minima
    passages_ = [words(rng, 50 + k % 3) for k in range(120)] + [(t * 30)[: 51 + 2 * k] for k, t in enumerate(turns)]
    rows = [(2 * k + j, " ".join(words(rng, rng.randrange(10, 60)) + p + words(rng, rng.randrange(0, 60)))) for k, p in enumerate(passages_) for j in range(2)]
    rows += [(1000 + i, " ".join(words(rng, 150))) for i in range(40)]
    rows += [(2000 + j, " ".join(words(rng, 60) + [f"one{k}" for k in range(49)] + words(rng, 60))) for j in range(2)]  # a word too short
    got = {r.doc_id for r in passages.repeats(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == set(range(2 * len(passages_)))


def test_runs_reach_the_ends_of_passages(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(30):
        p = words(rng, 51 + 3 * k)
        for j in range(3):
            before, after = words(rng, rng.randrange(10, 45)) + [f"b{k}x{j}"], [f"a{k}x{j}"] + words(rng, 40)
            rows.append((3 * k + j, " ".join(before) + "\n é " + " ".join(p) + " " + " ".join(after)))
            start = len(" ".join(before)) + 2
            want[3 * k + j] = (start, start + 2 + len(" ".join(p)), len(p) + 1, 3 * k, j == 0)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in passages.repeats(docs.withColumnRenamed("doc_id", "id")).where("kind = 'run'").collect():
        assert r.doc_id not in got
        got[r.doc_id] = (r.start, r.stop, r.n_words, r.component_id, r.kept)
    by = dict(rows)
    lines = {i for i, t in by.items() if len(t.split("\n")[1].split()) >= 50}
    assert got == want and lines
    left = {r.doc_id: r.text for r in passages.without_repeats(docs).collect()}
    assert all(left[i] == (by[i] if w[4] else by[i][: w[0]] + by[i][w[1] :]) for i, w in want.items())


def test_wrapped_paragraphs(spark):
    rng = random.Random(12)

    def wrap(w, n):
        return "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))

    plain = [words(rng, 130) for _ in range(3)]
    edits = [[x if i % 45 != 20 else f"new{i}" for i, x in enumerate(p)] for p in plain]
    own = [wrap(words(rng, 60), 11) for _ in range(6)]
    rows = [(1, own[0] + "\n\n" + wrap(plain[0], 9) + "\n \n" + own[1]), (2, own[2] + "\n\n" + wrap(edits[0], 12)), (3, " ".join(plain[1])), (4, wrap(edits[1], 10) + "\r\n\r\n" + own[3])]
    rows += [(5, wrap(plain[2], 8)), (6, wrap(edits[2], 14)), (7, "\n".join(" ".join(words(rng, 12)) + "." for _ in range(9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.repeats(docs.withColumnRenamed("doc_id", "id")).collect()
    assert {(r.doc_id, r.kind, r.component_id, r.kept) for r in found} == {(i, "paragraph", i - (i + 1) % 2, i % 2 == 1) for i in range(1, 7)}
    by = dict(rows)
    assert all(by[r.doc_id][r.start : r.stop].split() == (plain if r.kept else edits)[(r.doc_id - 1) // 2] for r in found)
    left = {r.doc_id: r.text.strip() for r in passages.without_repeats(docs).collect()}
    assert left == {**{i: by[i] for i in (1, 3, 5, 7)}, 2: own[2], 4: own[3]}


def ids_of(text):
    return tokens.encoder(tokens.default_path()).of.encode(text or "", add_special_tokens=False).ids


def test_token_ids_equal_the_library(spark):
    odd = ["<|ENDOFTEXT|> a<|endoftext|>b", "İstanbul ΣΑΣ. straße, ÀÉ ﬁ K", "don't I'VE 12a,b. a1 ¼ ª", "\u0085  x y\x1cz", "É. é, ÉÉ..", "éa ́", "", None]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in tokens.with_ids(rows, tokens.default_path(), 2).collect():
        want = [*ids_of(r.text), 2]
        assert bytes(r.ids) == struct.pack(f"<{len(want)}I", *want)


def test_simple8b():
    rng = np.random.default_rng(0)
    for k in range(150):
        v = np.concatenate([rng.integers(0, 2 ** int(b), rng.integers(0, 150), dtype=np.uint64) for b in rng.integers(0, 64, 5)])
        assert (tokenfiles.decode_block(tokenfiles.encode_block(v), len(v)) == v).all()
    zeros = np.zeros(1000, np.uint64)
    assert len(tokenfiles.encode_block(zeros)) == 9 and (tokenfiles.decode_block(tokenfiles.encode_block(zeros), 1000) == 0).all()


def test_token_files(spark, docs, empty):
    files = tokenfiles.write_files(docs, fresh_path(spark, "t"), tokens.default_path(), 2)
    got = sorted((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in tokenfiles.read_files(files).collect())
    assert [r[0] for r in got] == [sum(x[2] for x in got[:i]) for i in range(len(got))]
    order = [(-1 if r[1] is None else r[1]) for r in got]
    assert order == sorted(order) and len(got) == len(corpus())
    by = {i: t for i, t, *_ in corpus()}
    for _, i, n, ids in got:
        if i is not None:
            want = [*ids_of(by[i]), 2]
            assert n == len(want) and ids == struct.pack(f"<{n}I", *want)
    assert tokenfiles.read_files(tokenfiles.write_files(empty, fresh_path(spark, "t"), tokens.default_path(), 2)).count() == 0


def test_packing(spark, docs, empty):
    rows = packing.packed_documents(docs, most_tokens=128).collect()
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(bytes(r.ids))
    texts = {i: t for i, t, *_ in corpus()}
    want = [*ids_of(texts[3006]), 1]
    assert b"".join(bytes(r.ids) for r in sorted(by[3006], key=lambda r: r.piece)) == struct.pack(f"<{len(want)}I", *want)
    assert all(r.length == 128 for r in sorted(by[3006], key=lambda r: r.piece)[:-1]) and by[3000][0].length == 1 and len(by[0]) == 2 * max(r.piece + 1 for r in by[0])
    for own in seqs.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 128
    assert len(seqs) <= -(-sum(r.length for r in rows) // 128) + 2
    assert packing.packed_documents(empty).count() == 0


def test_packing_keeps_ids_in_the_worker(spark, docs, monkeypatch):
    cuts, written = [], packing.written

    def spy(df, name):
        cuts.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(packing, "written", spy)
    bare = packing.packed_documents(docs, most_tokens=128, keep_ids=False).collect()
    whole = packing.packed_documents(docs, most_tokens=128).collect()
    assert "ids" not in cuts[0][0] and "Generate" not in cuts[0][1] and "ids" in cuts[1][0]  # ids don't pass through the JVM only to be cut there
    of = lambda rows: sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert of(bare) == of(whole)


def test_pieces_of_long_texts(spark):
    texts = [(1, "ka lo mi " * 2000), (2, None), (3, ""), (4, "ka")]
    ids = {i: [*ids_of(t), 7] for i, t in texts}
    rows = tokens.with_pieces(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), tokens.default_path(), 7, 100).collect()
    want = [(i, k // 100, k, len(own[k : k + 100]), struct.pack(f"<{len(own[k : k + 100])}I", *own[k : k + 100])) for i, own in ids.items() for k in range(0, len(own), 100)]
    assert [(r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows] == want and all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)


def test_tables_are_written_by_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    rows = spark.range(0, 60, 1, 1).select(F.expr("repeat('x', 1 << 20)").alias("text"))
    seen = written(rows.mapInArrow(sizes, "size long, n long"), "sizes")[0].collect()
    assert sum(r.n for r in seen) == 60 and max(r.size for r in seen) < 8 << 20 and key not in spark.conf.getAll
    spark.conf.set(key, str(16 << 20))
    try:
        seen = written(rows.mapInArrow(sizes, "size long, n long"), "sizes")[0].collect()
        assert max(r.size for r in seen) > 12 << 20 and spark.conf.get(key) == str(16 << 20)  # a session's own setting holds
    finally:
        spark.conf.unset(key)


def test_packing_query_keeps_no_more_chunks_than_others(monkeypatch):
    asked = {}
    monkeypatch.setattr(packing, "table", lambda *a: None)
    monkeypatch.setattr(packing, "packed_documents", lambda docs, **kw: asked.update(kw))
    packing.op2_best_fit_packing(None, "")
    assert asked.get("kept", tokens.KEPT) <= tokens.KEPT


def test_pipeline_packs_with_few_chunks_after_executors_shrink(spark, docs, monkeypatch):
    asked, shrink = [], corpus_pipeline.shrink
    packed = packing.packed_documents
    monkeypatch.setattr(corpus_pipeline, "shrink", lambda s: asked.append("shrink") or shrink(s))
    monkeypatch.setattr(packing, "packed_documents", lambda d, **kw: asked.append(kw["kept"]) or packed(d, **kw))
    few = corpus_pipeline.pack(spark, docs, "").collect()
    assert asked[0] == "shrink" and asked[1] <= 50_000
    of = lambda rows: sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert of(few) == of(packed(docs, keep_ids=False).collect())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    rng = np.random.default_rng(4)
    n = rng.integers(1, 101, 500)
    bins, offsets = packing.best_fit(n, 100, 4, 6000, (1.0, 0.5, 0.5), rule) if (n * n <= 6000).all() else packing.best_fit(np.minimum(n, 77), 100, 4, 6000, (1.0, 0.5, 0.5), rule)
    n = np.minimum(n, 77)
    for b in np.unique(bins):
        own = np.flatnonzero(bins == b)
        assert n[own].sum() <= 100 and len(own) <= 4 and (n[own] ** 2).sum() <= 6000
        assert sorted(offsets[own].tolist()) == (np.cumsum(n[own[np.argsort(offsets[own])]]) - n[own[np.argsort(offsets[own])]]).tolist()
    with pytest.raises(ValueError):
        packing.best_fit(np.array([101]), 100, 4, 10**9)


def test_mixing(spark, docs, empty):
    rows = mixing.decided(docs).collect()
    again = mixing.decided(docs).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again)) and len(rows) == len(corpus())
    sizes = {}
    for _, t, _, s, _ in corpus():
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, target in zip(order, mixing.shared_out([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()))):
        own = [r for r in rows if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - target) < 1e-6 and 0 <= r.copies <= 2 for r in own)
        if max(r.size for r in own) < sizes[s] / 2:  # else no choice comes near
            assert abs(sum(r.size * r.copies for r in own) - target) <= max(2, 0.02 * target)
    mix = mixing.mixed(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in rows)
    assert mixing.decided(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_shares_and_fits():
    assert mixing.shared_out([10, 10, 10], [5, 2, 1], 45) == [20.0, 50 / 3, 25 / 3]
    assert sum(mixing.shared_out([1, 100, 0], [5, 2, 1], 150)) == 150
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.unique(rng.integers(2, 60, 12))
        have = rng.integers(1, 6, len(lengths))
        budget = int(rng.integers(0, (lengths * have).sum() + 5))
        take = mixing.fitted(lengths, have, budget)
        assert ((take >= 0) & (take <= have)).all() and (take * lengths).sum() <= budget
        reach = {0}
        for n, h in zip(lengths.tolist(), have.tolist()):
            reach |= {r + n * k for r in reach for k in range(h + 1)}
        best = max(r for r in reach if r <= budget)
        assert best == (take * lengths).sum()


@pytest.mark.parametrize("n", [200, 3000, 20_000])
def test_every_range_of_lengths_gives_its_share(n):
    rng = np.random.default_rng(n)
    lengths, have = np.unique(np.minimum(rng.lognormal(5, 1, n).astype(np.int64) + 1, 20_000), return_counts=True)
    whole = int((lengths * have).sum())
    for share in (0.21, 0.54, 0.81):
        budget = int(whole * share)
        picks = [mixing.fitted(lengths, have, budget, start) for start in (0.1, 0.6)]
        for take in picks:
            assert ((take >= 0) & (take <= have)).all() and (take * lengths).sum() == budget
            for part in np.array_split(np.arange(len(lengths)), 5):
                assert abs(take[part].sum() - share * have[part].sum()) <= 6 + 0.02 * have[part].sum()
        assert (picks[0] != picks[1]).any()


def test_mixing_hot_length(spark):
    rows = [(i, "a b c", "s", ) for i in range(5000)] + [(9000 + i, "x " * (i + 1), "t") for i in range(50)]
    got = mixing.decided(spark.createDataFrame(rows, "doc_id long, text string, source string"), total=0.5).collect()
    for s in "st":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) <= 3


def test_language_id(spark, empty):
    rng = random.Random(2)
    kinds = {"aa": "bada gabo dami raba".split(), "bb": "stro pliks trenk grumf".split(), "cc": "éçà ouèr çaié éiou".split()}
    rows = [(i, " ".join(rng.choice(kinds[k]) for _ in range(rng.randrange(5, 60))), k) for i, k in enumerate(rng.choice(list(kinds)) for _ in range(300))]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (903, "漢字漢字 漢字", None), (None, "bada gabo", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    out = langid.identified(docs, langid.fit(docs.where(~langid.held_out()))).withColumn("held", langid.held_out()).collect()
    assert len(out) == len(rows)
    assert all(r.lang_pred == r.lang and not r.rejected for r in out if r.doc_id is not None and r.doc_id < 300)
    by = {r.doc_id: r for r in out}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[903].rejected and by[903].lang_pred in kinds and by[None].lang_pred == "aa" and by[None].held is False
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert langid.identified(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.identified(docs, langid.fit(empty)).collect()} == {"und"}


URLS = ["http://a.net/x", "https://NET/", "http://b.example.net/en/1?q#f", "http://example.com/de/", "http://xexample.com/de/", "http://h.org/fr/a", "http://h.org/fra", "http://net", "nothing", None, "ftp://u://example.net/en/", "http://example.net/en", "http://a.net/x"]


def judge(url, rules, default):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fits, key=lambda r: (-len(r.text), r.text), default=None)
    return url, host, path, best and best.text, best.verdict if best else default


@pytest.mark.parametrize("most", [0, 2000])
def test_url_rules(spark, most, monkeypatch):
    monkeypatch.setattr(urlrules, "MOST_LITERAL", most)
    rules = [*urlrules.RULES, urlrules.Rule("h.org", "/fr", "block"), urlrules.Rule("a.net", "", "allow")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = [(r.url, r.host, r.path, r.rule, r.verdict) for r in urlrules.judged(pages, rules).orderBy("page_id").collect()]
    assert got == [judge(u, rules, "allow") for u in URLS]
    assert {r.verdict for r in urlrules.judged(pages, [], "block").collect()} == {"block"}
    assert urlrules.judged(pages.limit(0), rules).count() == 0
    assert "Python" not in urlrules.judged(pages, rules)._jdf.queryExecution().toString()


def test_warc(spark):
    rows = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "x\r\ny", ""), (5, "u", "a\r\n\r\nb" * 90_000), (None, "n", "<p>é</p>"), (None, "n", "alone"), (2, "dup", "<p>é</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("revisit", F.lit(1))
    files = warc.normalise(warc.write_monolithic(warc.with_revisits(pages.drop("revisit")), fresh_path(spark, "w")), fresh_path(spark, "w"))
    got = warc.read_indexed(files).collect()
    assert len(got) == len(rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = sorted((str(i), sha(h), len((h or "").encode())) for i, _, h in rows)
    assert sorted((str(r.page_id), r.payload_digest, r.payload_bytes) for r in got) == want
    by = {(r.page_id, r.payload_bytes): r for r in got}
    assert by[(1, 9)].record_type == "revisit" and by[(1, 9)].refers_to == 2 and by[(2, 9)].record_type == "response" and by[(None, 9)].refers_to == 2 and by[(None, 5)].record_type == "response"
    assert by[(3, 0)].refers_to == 4 and by[(4, 0)].record_type == "response" and bytes(by[(5, 540_000)].payload).startswith(b"a\r\n\r\nb")
    assert warc.read_indexed(warc.normalise(warc.write_monolithic(warc.with_revisits(pages.drop("revisit").limit(0)), fresh_path(spark, "w")), fresh_path(spark, "w"))).count() == 0


PNG = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", bytes(13)), (b"IEND", b"")))


def test_sniffing(spark):
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0, 0, 0]) + b"," + bytes(8) + b"\0" + b"\x02\x01\x00\x00" + b";"
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a", b"b")
    packed = gzip.compress(b"hello", mtime=0)
    wav = media.to_wav(b"\x80" * 10 + PNG + b"BM not a picture RIFF neither" + packed)
    rows = {"png": (PNG, "image/gif"), "gif": (gif, "image/gif"), "zip": (zipped.getvalue(), None), "wav": (wav, "audio/mpeg"), "text": (b"plain %PDF- text", "text/plain"), "empty": (b"", None), "null": (None, "x"), "cut": (PNG[:-3], "image/png"), "tail": (b"  " + gif + zipped.getvalue(), None)}
    df = spark.createDataFrame([(k, None if b is None else bytearray(b), d) for k, (b, d) in rows.items()], "k string, media binary, declared string")
    got = {r.k: r for r in media.sniffed(df, declared="declared").collect()}
    assert (got["png"].media_type, got["png"].corrected) == ("image/png", True) and (got["gif"].media_type, got["gif"].corrected) == ("image/gif", False) and got["zip"].media_type == "application/zip"
    assert got["wav"].media_type == "audio/wav" and [(c.offset, c.length, c.type) for c in got["wav"].carved] == [(54, len(PNG), "image/png"), (54 + len(PNG) + 29, len(packed), "application/gzip")]
    assert got["text"].media_type == "text/plain" and not got["text"].carved and got["empty"].media_type is None and got["null"].corrected is None and got["cut"].media_type == "image/png" and not got["cut"].corrected
    assert [(c.offset, c.type) for c in got["tail"].carved] == [(2, "image/gif"), (2 + len(gif), "application/zip")]


def test_media_round_trip(spark, docs, empty):
    rows = media.with_samples(media.sniffed(media.stored(docs))).collect()
    texts = {i: t for i, t, *_ in corpus()}
    for r in rows:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert bytes(r.samples) == media.padded(raw) and len(r.samples) % 64 == 0 and r.n_bytes == len(raw) and r.media_type == "audio/wav"
    assert len(media.padded(b"")) == 64 and len(media.padded(b"x" * 64)) == 64 and media.from_wav(media.to_wav(b"abc")) == b"abc"
    assert media.with_samples(media.sniffed(media.stored(empty))).count() == 0
