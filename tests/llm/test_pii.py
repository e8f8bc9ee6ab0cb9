"""Personal data: base spans against the contract's patterns, what trees add, odd and very long texts, redaction."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tonelake.llm import pii
from tonelake.llm.common import fresh_path, written

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(v if i % 2 == 0 else (v * 2 - 9 if v > 4 else v * 2) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def base(text):
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in s.split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn(d) or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def text_of(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)


def checked(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(text_of(want).encode()).hexdigest(), (r.doc_id, texts[r.doc_id][:200], text_of(want), r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        spans = [s for s in r.spans.split(",") if s]
        assert set(text_of(want).split(",")) - {""} <= set(spans) and len(spans) == len(want) + r.n_added
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))


def test_base_spans_by_brute_force(spark):
    rng = random.Random(5)
    pieces = ["a", "Z.", "@", "@b", ".c", "-", "+", "+1", " ", "  ", "(", ")", "12", "4", "255", "256", ".", "1.2.3", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123456", "x@y.z", "é", "漢", "😀", "\n", "_", "%", "007", "@x.", ". 5"]
    texts = {i: "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for i in range(3000)}
    texts |= {9000: None, 9001: "", 9002: "a@b.c+d@e.f_g@h.i", 9003: "1.2.3.4.5.6.7.8 001.02.3.255 1.2.3.0256", 9004: "1.2.3.4 5678 9012 3456 78", 9005: "1 " * 9 + "2" * 14 + " " + "3" * 16}
    docs = spark.createDataFrame([(i, t, "own") for i, t in texts.items()], "doc_id long, text string, kind string").withColumn("_base", F.lit(1))
    rows = pii.spans_of(docs).collect()
    assert len(rows) == len(texts)
    checked(rows, texts)


def test_base_spans_of_the_test_tables(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    checked(pii.op13_pii(spark, sf_dir).collect(), texts)


def test_long_texts_take_linear_time(spark):
    n = 200_000
    texts = {1: "a" * n, 2: "1" * n, 3: "1 " * n, 4: "1." * n, 5: "+1 (" * (n // 4), 6: "a.b-" * (n // 4) + "@", 7: "a@b.c " * (n // 60), 8: "1.2.3.4 " * (n // 80), 9: "(" * n, 10: "a at b" * (n // 6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    began = time.perf_counter()
    rows = pii.spans_of(docs).collect()
    assert time.perf_counter() - began < 60
    checked([r for r in rows if r.doc_id in (3, 7, 8)], texts)  # the plain version takes quadratic time on the others
    assert all(r.spans == "" for r in rows if r.doc_id in (1, 2, 9))


def card(rng, valid=True):
    digits = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    last = next(d for d in "0123456789" if luhn(digits + d))
    return digits + (last if valid else str((int(last) + 1 + rng.randint(0, 8)) % 10))


@pytest.fixture(scope="module")
def learnt(spark):
    """Documents of cards with dots, phones with and without a country code, spelt-out addresses, and numbers that are none."""
    rng, rows = random.Random(11), []
    for i in range(1500):
        c, bad = card(rng), f"{rng.randint(10**15, 10**16 - 1)}"
        phone = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        name = rng.choice(["ann", "bob", "eva"]) + str(rng.randint(1, 99))
        rows.append((i, f"card {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} and order {bad}x, call +1 {phone} or mail {name} [at] example [dot] com or look at this dot now"))
    rows += [(5000, "please call (743) 555-3824 or not"), (5001, "nothing here at all"), (5002, None), (5003, "card 4111.1111.1111.1112 mistyped")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cands, _ = written(pii.candidates(docs), "candidates-test")
    return docs, cands, pii.fit(cands)


def test_trees_add_what_validates(spark, learnt):
    docs, cands, model = learnt
    assert {0, 2, 3} <= set(model.least)
    rows = {r.doc_id: r for r in pii.spans_of(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    checked(rows.values(), texts)
    added = {i: {s.split(":")[0] + " " + texts[i][int(s.split(":")[1]) : int(s.split(":")[2])] for s in rows[i].spans.split(",") if s and s not in text_of(base(texts[i])).split(",")} for i in rows}
    plain = range(1500)
    assert sum(any(a.startswith("card ") and "." in a for a in added[i]) for i in plain) >= 0.98 * 1500
    assert sum(any(a.startswith("email ") and "[at]" in a for a in added[i]) for i in plain) >= 0.98 * 1500
    assert sum(any("order" in a or "this" in a or a.startswith("phone") for a in added[i]) for i in plain) <= 0.02 * 1500
    assert added[5000] == {"phone (743) 555-3824"} and added[5001] == added[5002] == set() and added[5003] == {"card 4111.1111.1111.1112"}


def test_reruns_agree(learnt):
    _, cands, model = learnt
    assert pii.fit(cands.repartition(3)) == model == pii.fit(cands.repartition(7))


def test_redacted(spark, learnt):
    _, _, model = learnt
    docs = spark.createDataFrame([(1, "é a@b.cd and 4111 1111 1111 1111, +1 (743) 555-3824.", 5), (2, None, 6), (3, "clean", 7), (3, "clean", 7)], "doc_id long, text string, _spans int")
    got = pii.redacted(docs, model)
    assert got.columns == docs.columns
    assert sorted(got.collect(), key=lambda r: r.doc_id) == [(1, "é [EMAIL] and [CARD], [PHONE].", 5), (2, None, 6), (3, "clean", 7), (3, "clean", 7)]


def test_empty_and_repeated(spark):
    rows = [(1, "x@y.z"), (1, "x@y.z"), (None, "1.2.3.4"), (None, None)]
    for of in (rows, []):
        path = fresh_path(spark, "pii-test")
        spark.createDataFrame(of, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
        got = pii.op13_pii(spark, path).collect()
        assert sorted((str(r.doc_id), r.spans) for r in got) == sorted((str(i), text_of(base(t))) for i, t in of)


def test_rare_combinations_count_in_fit_and_thresholds(spark):
    """100 held-out proposals, each of features of its own, beside 60,000 combinations that are more frequent."""
    features = {n: F.lit(0) for n in pii.FEATURES} | {"digits": (F.col("id") % 300).cast("int"), "long": F.floor(F.col("id") / 300).cast("int")}
    rows = spark.range(60_100).withColumn("_held", F.col("id") >= 60_000).withColumn("y", F.lit(1)).withColumn("kind", F.lit(2))
    proposal = F.struct(F.struct(F.lit(0).alias("start"), F.lit(5).alias("stop"), "kind", *[v.alias(n) for n, v in features.items()], "y").alias("c"), F.lit(True).alias("free"))
    cands = rows.select("_held", F.when(F.col("_held"), F.array(proposal)).otherwise(F.array_repeat(proposal, 2)).alias("_loose"))
    assert set(pii.fit(cands).least) == {2}
