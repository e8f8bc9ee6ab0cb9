"""Document fingerprints from closed syncmers, in DataFrame functions alone.

The alphabet is tokens of the lower-cased text. A word of up to 16 code points is one. A longer run without white space is
cut where its content says: after each digit, mark, character beyond ASCII and letter of even code, half of them, so that
Chinese, Japanese or Thai go by character, and a change shifts no cut but its own; 32 of the other letters in a row are
one token too, so that one letter repeated goes by 32. An s-mer is ``S`` tokens in a row, a k-mer ``K``. A k-mer is
a closed syncmer, an anchor, when the smallest hash of its inner s-mers is that of its first or last one. Whether it is
depends on its own tokens only, so that a copied passage keeps its anchors wherever it lands.

A fingerprint is the ``KEEP`` smallest distinct anchor hashes, each with the place (a token number) where it is first: 16 and
8 hex digits. Two are matched by position: an anchor in common counts if a neighbour in common, before or after it, has moved
about as far (``SLACK`` tokens), or if there is no other. Likeness is the share of such anchors among the KEEP smallest of both.

Nulls count as empty texts. An empty text (or one of white space) has the fingerprint ''. A text with no anchor
(fewer than K tokens, or none chosen) has one: the hash of all its tokens. Likeness is 1 between two empty
fingerprints, 0 between an empty and another one. Equal texts, rows that repeat among them, have equal fingerprints. Whole
texts are read, however long. An empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.llm.common import partitions, table

K, S, KEEP, SLACK = 6, 2, 64, 16
_SPACE = r"\x20\x09-\x0D"
_CUT = "".join(c for c in map(chr, range(ord("a"), ord("z") + 1)) if ord(c) % 2 == 0) + r"0-9!-/:-@\[-`{-~\x{80}-\x{10FFFF}"
TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}]{{1,16}}(?![^{_SPACE}])|[^{_SPACE}{_CUT}]{{0,31}}[{_CUT}]|[^{_SPACE}{_CUT}]{{1,32}}"
LEAST = -(2**63)
#: Bytes of text in a run of documents, of which there are eight to a partition at least.
RUN_BYTES = 256 << 20
_ANCHORS = "array<struct<hash: bigint, place: int>>"


def _columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Adds what the anchors of ``<name>`` need: its token hashes, s-mer hashes and anchor places."""
    w = K - S + 1
    df = df.withColumns({f"{n}_tokens": F.expr(f"regexp_extract_all(lower({n}), r'{TOKEN}', 0)") for n in names})
    df = df.withColumns({f"{n}_hashes": F.transform(f"{n}_tokens", lambda t: F.xxhash64(t)) for n in names})
    df = df.withColumns({f"{n}_smers": F.expr(f"zip_with({n}_hashes, slice({n}_hashes, {S}, greatest(size({n}_hashes) - 1, 0)), (a, b) -> xxhash64(a, b))") for n in names})

    def at(n: str, d: int) -> str:
        return f"{n}_smers[i + {d}]"

    def chosen(n: str) -> str:
        first, last = ", ".join(at(n, d) for d in range(1, w)), ", ".join(at(n, d) for d in range(w - 1))
        return f"{at(n, 0)} <= least({first}) OR {at(n, w - 1)} <= least({last})"

    places = {f"{n}_places": F.expr(f"CASE WHEN size({n}_hashes) >= {K} THEN filter(sequence(0, size({n}_hashes) - {K}), i -> {chosen(n)}) ELSE array() END") for n in names}
    return df.withColumns(places)


def _anchor(n: str) -> str:
    inner = ", ".join(f"{n}_smers[i + {d}]" for d in range(0, K - S + 1, S))
    return f"struct(xxhash64({inner}) AS hash, CAST(i AS INT) AS place)"


def _dropped(df: DataFrame, names: list[str]) -> DataFrame:
    return df.drop(*[f"{n}_{x}" for n in names for x in ("tokens", "hashes", "smers", "places", "sorted")])


def with_anchors(df: DataFrame, text: str = "text", out: str = "anchors") -> DataFrame:
    """Adds an array of (hash, place): each closed syncmer's hash and first token, from 0."""
    df = _columns(df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))), ["_t"])
    df = df.withColumn(out, F.expr(f"transform(_t_places, i -> {_anchor('_t')})"))
    return _dropped(df, ["_t"]).drop("_t")


def with_sketches(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Adds for each text column a sketch column: the KEEP smallest distinct anchor hashes, ascending, with their first places."""
    names = list(texts)
    df = _columns(df, names)
    df = df.withColumns({f"{n}_sorted": F.expr(f"CASE WHEN size({n}_hashes) > 0 AND size({n}_places) = 0 THEN array(struct(xxhash64({n}_hashes) AS hash, 0 AS place)) ELSE sort_array(transform({n}_places, i -> {_anchor(n)})) END").cast(_ANCHORS) for n in names})
    found = {out: F.expr(f"slice(filter({n}_sorted, (x, i) -> i = 0 OR {n}_sorted[i - 1].hash != x.hash), 1, {KEEP})") for n, out in texts.items()}
    return _dropped(df.withColumns(found), names)


def as_text(sketch: str) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.concat(F.lpad(F.lower(F.hex(x["hash"])), 16, "0"), F.lpad(F.lower(F.hex(x["place"])), 8, "0"))), "")


def with_likeness(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for each pair of sketches their likeness, 0 to 1."""
    both = {f"{out}_both": F.expr(f"slice(sort_array(array_union({a}.hash, {b}.hash)), 1, {KEEP})") for out, (a, b) in pairs.items()}
    df = df.withColumns(both).withColumns({f"{out}_in": F.expr(f"array_intersect({out}_both, array_intersect({a}.hash, {b}.hash))") for out, (a, b) in pairs.items()})

    def place(sketch: str) -> str:
        return f"{sketch}[CAST(array_position({sketch}.hash, h) - 1 AS INT)].place"

    df = df.withColumns({f"{out}_met": F.expr(f"sort_array(transform({out}_in, h -> struct({place(a)} AS place, {place(b)} - {place(a)} AS shift)))") for out, (a, b) in pairs.items()})

    def share(out: str, a: str, b: str) -> Column:
        def near(d: int) -> str:
            return f"coalesce(abs(x.shift - get({out}_met, i + {d}).shift) <= {SLACK}, FALSE)"

        counted = f"size(filter({out}_met, (x, i) -> size({out}_met) = 1 OR {near(-1)} OR {near(1)}))"
        return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE {counted} / CAST(size({out}_both) AS DOUBLE) END")

    df = df.withColumns({out: share(out, a, b) for out, (a, b) in pairs.items()})
    return df.drop(*[f"{out}_{x}" for out in pairs for x in ("both", "in", "met")])


def positional_matches(anchors: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, other_id, shift, hits): anchors in common with the first document that has them, by difference in place.

    Each anchor hash links its documents to the smallest id that has it, not to each other, so that the rows grow
    with the anchors. A run of hits at one shift is a copied passage.
    """
    flat = anchors.select(F.col(id_col).alias("id"), F.explode("anchors").alias("a")).select("id", F.col("a.place").alias("place"), F.col("a.hash").alias("hash"))
    first = flat.groupBy("hash").agg(F.min(F.struct("id", "place")).alias("first"))
    return flat.join(first, "hash").where(F.col("id") > F.col("first.id")).groupBy("id", F.col("first.id").alias("other_id"), (F.col("place") - F.col("first.place")).alias("shift")).agg(F.count("*").alias("hits"))


def _below(cuts: list[int], key: str) -> Column:
    """How many of the ascending ``cuts`` lie below a key; of many, first how many stretches of them do, then how many in one."""
    if not cuts:
        return F.lit(0)

    def literal(values: list[int]) -> str:
        return f"CAST(split('{','.join(map(str, values))}', ',') AS ARRAY<BIGINT>)"

    if len(cuts) <= 64:
        return F.expr(f"size(filter({literal(cuts)}, c -> c < {key}))")
    step = int(len(cuts) ** 0.5)
    heads = f"size(filter({literal(cuts[::step])}, c -> c < {key}))"
    within = f"(g - 1) * {step} + size(filter(slice({literal(cuts)}, (g - 1) * {step} + 1, {step}), c -> c < {key}))"
    return F.expr(f"element_at(transform(array({heads}), g -> CASE WHEN g = 0 THEN 0 ELSE {within} END), 1)")


def in_runs(df: DataFrame, id_col: str) -> DataFrame:
    """Deals rows with a text into runs of ids (_run), ordered by _key and _h; with a copy (_copy = 1) of the row after each run's last.

    A run has about RUN_BYTES of text; an id that fills several runs is parted by the hash of the text. In descending order
    of runs, each gets a copy of the first row of the next one, the last of the first.
    """
    n_part = partitions(df.sparkSession)
    df = df.withColumns({"_key": F.coalesce(F.col(id_col), F.lit(LEAST)), "_h": F.xxhash64("text")})
    n = max(8 * n_part, -(-(df.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // RUN_BYTES))
    cuts = df.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], max(10_000, 4 * n)).alias("cuts")).first()["cuts"] or []
    parts = F.lit(0)
    for key, often in Counter(cuts).items():
        if often > 1:
            parts = F.when(F.col("_key") == key, F.lit(often + 1)).otherwise(parts)
    part = F.when(parts > 0, 1 + F.least(F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * parts), parts - 1)).otherwise(0)
    df = df.withColumn("_run", _below(sorted(set(cuts)), "_key").cast("long") * (1 << 32) + part.cast("long"))
    heads = df.groupBy("_run").agg(F.max(F.struct("_key", "_h")).alias("top"))  # a row per run
    down = Window.orderBy(F.desc("_run"))
    last = F.min("_run").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.coalesce(F.lag("_run").over(down), last).alias("_into"), F.col("top._key").alias("_top"), F.col("top._h").alias("_toph"))
    copies = df.join(F.broadcast(heads), (F.col("_key") == F.col("_top")) & (F.col("_h") == F.col("_toph"))).dropDuplicates(["_into"])
    copies = copies.withColumn("_run", F.col("_into")).drop("_into", "_top", "_toph")
    return df.withColumn("_copy", F.lit(0)).unionByName(copies.withColumn("_copy", F.lit(1)))


def with_next(dealt: DataFrame, carried: list[str]) -> DataFrame:
    """Adds ``next_<c>`` of the next row in descending id (equal ids, and nulls, the last: descending hash of the text), after the last the first."""
    order = Window.partitionBy("_run").orderBy("_copy", F.desc("_key"), F.desc("_h"))
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).where("_copy = 0").drop("_key", "_h", "_run", "_copy")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints each text, its edited text and says how like they are; see the query's contract."""
    docs = in_runs(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    docs = with_next(with_sketches(docs, {"text": "sketch"}), ["text", "sketch"])
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third)))
    docs = with_likeness(with_sketches(docs, {"edited": "edited_sketch"}), {"near_edited": ("sketch", "edited_sketch"), "near_next": ("sketch", "next_sketch")})
    return docs.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("sketch").alias("fingerprint"), as_text("edited_sketch").alias("edited_fingerprint"), "near_edited", "near_next")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
