"""Cases of single faults: token ids of all letters, streams that break off, columns with clashing names, repeated ids."""

import hashlib
import io
import struct
import sys
import time
import unicodedata
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tonelake.llm import media, mixing, neardup, passages, tokens, urlrules, warc
from tonelake.llm.common import fresh_path
from tonelake.plans import fixtures
from tonelake.sources import containers


def ids_of(text):
    i = tokens.encoder(tokens.default_path()).of.encode(text, add_special_tokens=False).ids
    return struct.pack(f"<{len(i)}I", *i)


def test_ids_of_all_letters_before_marks():
    of = tokens.Encoder(tokens.default_path(), 1000)
    letters = [chr(i) for i in range(128, min(0x30000, sys.maxunicode)) if unicodedata.category(chr(i))[0] == "L"]
    rare = [c for c in letters if unicodedata.normalize("NFC", c.lower()) != c] + letters[::40]
    for c in rare:
        for t in (f"A{c}.", f"{c},", f"{c}. B<|x", f"Ab{c}, C<|endoftext|>D"):
            assert of.ids(t.encode()) == ids_of(t), t


def test_special_tokens_in_any_case():
    of = tokens.encoder(tokens.default_path())
    for t in ("A b<|endoftext|>a", "A <|ENDOFTEXT|> B", "<| Plain Words |>", "A<|startoftext|>B C"):
        assert of.ids(t.encode()) == ids_of(t)


def test_a_stream_cut_between_records_raises():
    d, cuts, out = zlib.compressobj(6, zlib.DEFLATED, 31), [], b""
    for i in range(30):
        out += d.compress(warc.record(i, "u", bytes([65 + i]) * 500 * i, None, False)) + d.flush(zlib.Z_FULL_FLUSH)
        cuts.append(len(out))
    whole = out + d.flush()
    assert len(list(warc.records(warc.inflated(io.BytesIO(whole + whole + bytes(50)))))) == 60
    for c in cuts:
        with pytest.raises(ValueError):
            list(warc.records(warc.inflated(io.BytesIO(whole[:c]))))


def test_header_fields_without_a_space():
    assert warc.fields(b"WARC/1.1\r\nWARC-Type:response\r\nA: b\r\n c") == {"warc-type": "response", "a": "b c"}


def test_clashing_names(spark):
    rows = [(i, f"plain words of text number {i} are here", "en", "s", 5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_id", "_h", "_spans", "_score", "_lang", "_rejected", "_copies", "_copy", "_row", "_size", "_mark", "_n", "_of", "_p_n", "id", "h", "rule", "i"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    twice = docs.union(docs.where("doc_id < 3").withColumn("text", F.lit("another text under an old id")))
    for out in (mixing.mixed(docs), passages.without_repeats(docs), neardup.deduplicated(twice), corpus_pipeline.language_id(spark, docs, "")):
        assert out.columns == docs.columns
        assert {r["_id"] + r["_score"] + r["rule"] for r in out.collect()} == {"own _idown _scoreown rule"}
    kept = neardup.deduplicated(twice)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({r.doc_id for r in kept.select("doc_id").collect()})


@pytest.mark.parametrize("most", [0, 2000])
def test_rules_with_clashing_names(spark, most, monkeypatch):
    monkeypatch.setattr(urlrules, "MOST_LITERAL", most)
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string").withColumns({c: F.lit("own") for c in ("rule", "i", "t", "_tokens", "_verdict")})
    got = urlrules.judged(pages, urlrules.RULES).orderBy("page_id").collect()
    assert [(r.rule, r.verdict, r["i"], r["t"], r["_tokens"], r["_verdict"]) for r in got] == [("net/", "block", *["own"] * 4), (None, "allow", *["own"] * 4)]


def test_two_results_stay_readable(spark):
    docs = spark.createDataFrame([(i, "the same words are in each of these texts", "en", "s", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    x, y = corpus_pipeline.near_dedup(spark, docs, ""), corpus_pipeline.near_dedup(spark, docs, "")
    assert x.count() == y.count() == x.count() == 1


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    mixing.mixed(spark.createDataFrame([(1, "a b", "s")], "doc_id long, text string, source string")).count()
    assert spark.conf.get(key) == before


def test_media_ends(spark):
    wav = media.to_wav(b"\x80" * 9)
    frames = [fixtures.flac_frame(k, [k] * 30, [-k] * 30, "verbatim", 1) for k in range(3)]
    flac = fixtures.flac(frames, 90, ["TITLE=x"])
    assert media.found(flac + wav) == [(0, len(flac), "audio/flac"), (len(flac), len(wav), "audio/wav")]
    assert media.found(b"fLaC\x00\x00\x00\x22") == []
    body = b"%PDF-1.4\n1 0 obj\nendobj\n"
    once = body + b"xref\n0 1\ntrailer\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"
    more = once + b"\n2 0 obj\nendobj\nxref\n0 1\ntrailer\nstartxref\n" + str(len(once) + 16).encode() + b"\n%%EOF"
    assert more[len(once) + 16 :].startswith(b"xref"), more[len(once) + 16 :]
    assert media.found(more + b" tail")[0] == (0, len(more), "application/pdf") and media.found(body + b"startxref 9999 %%EOF") == []
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a", b"bb")
        z.writestr("c", b"d" * 100)
    assert media.found(zipped.getvalue() + b"..") == [(0, len(zipped.getvalue()), "application/zip")]
    began = time.perf_counter()
    assert media.found(b"PK\x03\x04" * 40_000) == [] and media.found(b"%PDF-" * 40_000) == [] and time.perf_counter() - began < 20


def test_media_columns_by_brute_force(spark):
    texts = {1: "abc", 2: None, 3: "x" * 64, 4: "é" * 100, 5: "RIFF in a text %PDF- PK\x03\x04"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    path = fresh_path(spark, "media-test")
    docs.write.parquet(f"{path}/documents.parquet")
    for r in media.op9_media_columns(spark, path).collect():
        raw = (texts[r.doc_id] or "").encode()
        want = media.padded(raw)
        stored = media.to_wav(want)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = [v - 128 for v in want]
        mean = sum(x) / len(x)
        dev = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
        cross = sum((a >= 0) != (b >= 0) for a, b in zip(x, x[1:]))
        assert r.feature.strip() == f"audio/wav/u8 mean={mean:.3f} dev={dev:.3f} peak={max(map(abs, x))} cross={cross} carved=".strip()


def layouts(docs):
    return [docs.coalesce(1), docs.repartition(3), docs.repartition(7, "doc_id"), docs.repartition(7)]


def test_mix_of_equal_rows_is_exact_in_any_layout(spark):
    rows = [(1, "a b c", "s", 3)] * 2000 + [(i, "x " * (i % 5 + 1), "t", 1) for i in range(200)] + [(500, "x x", None, k % 3) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    seen = []
    for d in layouts(docs):
        got = mixing.decided(d).withColumn("taken", F.col("size") * F.col("copies"))
        sums = {r.source: (r.target, r.taken) for r in got.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()}
        assert got.count() == len(rows) and all(t - 3 <= taken <= t + 1 for t, taken in sums.values()), sums
        seen.append(sorted(map(tuple, got.select("doc_id", "size", "source", "copies").collect()), key=repr))
        out = sorted(map(tuple, mixing.mixed(d).collect()), key=repr)
        assert sum(len(r[1].split()) for r in out) == sum(t for _, t in sums.values())
        seen.append(out)
    assert all(s == seen[i % 2] for i, s in enumerate(seen))


def test_mix_fits_what_can_be_fit():
    import numpy as np

    for lengths, have, budget, best in (([2, 4, 6], [10**5, 10**5, 10**5], 123_457, 123_456), ([10**7, 3 * 10**7], [40, 40], 10**9 + 5, 10**9), ([7], [3], 20, 14), ([5, 9], [1, 1], 13, 9)):
        take = mixing.fitted(np.array(lengths), np.array(have), budget)
        assert int((take * lengths).sum()) == best and (take <= have).all() and (take >= 0).all()


def broken_ogg(n, flags=0):
    first, page = (bytearray(fixtures.ogg_page(1, f, 5, [bytes(200)])) for f in (2, flags))
    for p in (first, page):
        p[22:26] = containers.page_crc(bytes(p)).to_bytes(4, "little")
    return bytes(first) + bytes(page) * (n // len(page) - 1)


def entries_without_directory(n):
    entry = b"PK\x03\x04" + bytes([20, 0, 8, 0, 0, 0]) + bytes(8) + struct.pack("<IIHH", 0, 0, 1, 0) + b"a" + b"data" * 5 + b"PK\x07\x08" + bytes(12)
    return entry * (n // len(entry))


@pytest.mark.parametrize("of", [broken_ogg, lambda n: broken_ogg(n, 2), entries_without_directory, lambda n: b"PK\x03\x04" + bytes([20, 0, 8]) * (n // 3), lambda n: b"PK\x03\x04\x14\0\x08\0" * (n // 8)])
def test_validators_are_linear(of):
    times = []
    for n in (2 << 20, 4 << 20):
        began = time.perf_counter()
        media.found(of(n))
        times.append(time.perf_counter() - began)
    assert times[1] < 4 and times[1] < 4 * times[0] + 0.2, times


def test_broken_ogg_and_nested_zip():
    ogg = broken_ogg(4000)
    assert media.found(ogg + b"tail") == [(0, len(ogg), "audio/ogg")] and media.found(b"x" + ogg[:-5]) == [(1, len(ogg) * 16 // 17, "audio/ogg")]
    zipped = io.BytesIO()
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a", b"bb")
        z.writestr("b", b"cc" * 50)
    whole, fake = zipped.getvalue(), b"PK\x03\x04" + bytes(14) + struct.pack("<IIHH", 0, 0, 0, 0)
    assert media.found(fake + whole) == [(len(fake), len(whole), "application/zip")]
    header = fixtures.flac([], 0, ["A=b"])
    assert media.found(header) == []
