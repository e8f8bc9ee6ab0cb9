"""MinHash near-dedup: universal hash minima, banding, signature check, exact check, star components.

Texts with equal shingle sets form a class, whose smallest id stands for it. Only these representatives are
banded. Each bucket's smallest id is its first. In round one each member is checked against that first with which it
shares the most buckets, in round two against the firsts of all its buckets. Links between texts that are already
connected are not looked for. Round three takes the buckets in which separate components remain: their members
are compared by signature, in large buckets by blocks of bounded size, and what passes is checked, so that no candidate
link that would connect something is lost.

A check first compares 128 bits of the two signatures (an estimate that a pair of likeness 0.75 fails less than
once in 10^8), then the whole sets, recomputed from the whole texts.

Null or empty texts and texts of white space have an empty set and link with nothing. Rows with a null id keep
their row, with a null component, and are kept. Rows that repeat an id with the same text count as one document; where
they differ, each has its own text's component. Very long texts are compared whole, one at a time in a task. An empty
table gives an empty result. Columns besides id and text are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.llm import shingles as sh
from tonelake.llm.common import counted, in_arrow, remove, table, tidy, unused, written
from tonelake.llm.components import components
from tonelake.session import ready

#: Bands of rows: a pair of likeness 0.75 shares no band once in 190,000 pairs, one of 0.5 shares one in 7 of 8.
BANDS, ROWS = 32, 4
#: A link: 100 * intersection >= LINK * union.
LINK = 75
#: Of 128 signature bits, as many may differ; a pair of likeness 0.75 differs in 16 on average, deviation 3.7; with fewer hashes and more bits of each, in 14, deviation 4.7.
MOST_BITS = 37
#: Members of a bucket up to which what is left of it is compared by a join, beyond in blocks of DOWN by ACROSS signatures.
HOT, DOWN, ACROSS = 32, 256, 1024
#: Shingles of the rows of a block of sets, four times as many of its columns, and how many are compared at a time.
SHINGLES, COLUMNS = 1 << 16, 4096
#: Rows whose keys of 16 bytes may be broadcast: 4 MB.
MOST_BROADCAST = 250_000


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, h, n, k1, k2, s1, s2, bands) of (id, text): hash of the text, set size, 128-bit hash of the set, signature bits, band hashes."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = sh.signature(*sh.sets_of(batch.column(2).cast(pa.binary()).to_pylist()), bands, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["id", "h", "n", "k1", "k2", "s1", "s2", "bands"])

    return in_arrow(docs.select("id", F.xxhash64("text").alias("h"), "text"), sign, f"id long, h long, {sh.SIGNATURE}")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, None)
    for batch in batches:
        a, b, h = (batch.column(c).to_pylist() for c in ("a", "b", "hb"))
        found: list[tuple[int, int]] = []
        for i, (x, y) in enumerate(zip(a, b)):
            if last[0] != (y, h[i]):
                last = ((y, h[i]), sh.shingle_set(batch.column("text_b")[i].as_buffer().to_pybytes()))
            both, union = sh.likeness(sh.shingle_set(batch.column("text_a")[i].as_buffer().to_pybytes()), last[1])
            if 100 * both >= LINK * union and both:
                found.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


#: Finds the texts (id, h, text) of keys (id, h), one each; the number is how many keys there are at most.
Texts = Callable[[DataFrame, int], DataFrame]


def checked(pairs: DataFrame, n: int, texts_of: Texts) -> tuple[DataFrame, str, int]:
    """Of ``n`` pairs (a, ha, b, hb) those whose whole texts link: a table (a, b), its path and rows. Only texts that some pair names are shuffled."""
    spark = pairs.sparkSession
    ids = pairs.select(F.col("a").alias("id"), F.col("ha").alias("h")).union(pairs.select("b", "hb")).distinct()
    t, t_at = written(texts_of(ids, 2 * n).select("id", "h", F.encode("text", "UTF-8").alias("text")), "texts")
    both = pairs
    for x in "ab":
        both = both.join(t.select(F.col("id").alias(x), F.col("h").alias(f"h{x}"), F.col("text").alias(f"text_{x}")), [x, f"h{x}"])
    made, at, seen = counted(in_arrow(both.select("a", "b", "hb", "text_a", "text_b"), _check, "a long, b long"), "linked")
    remove(spark, t_at)
    return made, at, seen["n"]


def few(df: DataFrame, n: int) -> DataFrame:
    """Broadcast where the counted rows, of some 16 bytes each, are few."""
    return F.broadcast(df) if n <= MOST_BROADCAST else df


def texts_by_id(docs: DataFrame) -> Texts:
    """Finds texts in (id, text)."""
    hashed = docs.select("id", F.xxhash64("text").alias("h"), "text")
    return lambda keys, n: hashed.join(few(keys, n), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])


def _alike(x: str, y: str) -> Column:
    """Whether sizes and signature bits of two rows allow a link."""
    differ = F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1"))) + F.bit_count(F.col(f"{x}.s2").bitwiseXOR(F.col(f"{y}.s2")))
    sizes = (100 * F.least(f"{x}.n", f"{y}.n")) >= LINK * F.greatest(f"{x}.n", f"{y}.n")
    return sizes & (differ <= MOST_BITS)


def _could_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, ..) that the signature check lets through, with the hashes of their texts."""
    x, y = (nodes.select(F.col("id").alias(c), F.col("h").alias(f"h{c}"), "n", "s1", "s2").alias(k) for c, k in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").where(_alike("x", "y")).select("ha", "hb", *pairs.columns)


def _placed(rows: DataFrame, found: DataFrame, id_col: str = "id", out: str = "c") -> DataFrame:
    """Adds the component of an id, itself where it has none."""
    at = found.select(F.col("id").alias(id_col), F.col("component").alias(out))
    return rows.join(at, id_col, "left").withColumn(out, F.coalesce(out, id_col))


def grouped(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, h, n, component) for each row of (id long, text string), h a hash of its text. ``docs`` is read several times."""
    all_, _ = written(signed(docs, bands, rows), "signed")
    return linked(all_, texts_by_id(docs))


def linked(all_: DataFrame, texts_of: Texts, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, h, n, component, ..) for each row of a written table of ``signed`` columns, with the columns ``keep``.

    ``texts_of`` finds the texts (id, h, text) of keys (id, h).
    """
    spark = ready(all_.sparkSession)
    whole = F.struct("id", "h", "n", "s1", "s2", "bands")
    nodes, nodes_at = written(all_.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2").agg(F.min(whole).alias("m")).select("k1", "k2", "m.*"), "nodes")
    flat = nodes.select("id", F.explode("bands").alias("bucket"))
    shared = flat.groupBy("bucket").agg(F.min("id").alias("first"), F.count("*").alias("size")).where("size > 1")
    shared, shared_at = written(shared, "shared")  # a table, so that Spark deals it anew and can split a large bucket
    members, members_at = written(flat.join(shared, "bucket"), "buckets")
    remove(spark, shared_at)
    tidy(spark)
    ids = nodes.select("id", "h", "n", "s1", "s2")
    stars = members.where("id != first").groupBy(F.col("id").alias("a"), F.col("first").alias("b")).agg(F.count("*").alias("shared"))
    likely, likely_at, seen = counted(_could_link(stars, ids), "likely")
    links: list[tuple[DataFrame, str, int]] = []

    def link(pairs: DataFrame, n: int) -> bool:
        """Checks at most ``n`` pairs; adds what links to ``links`` and says whether any did."""
        links.append(checked(pairs.select("a", "ha", "b", "hb"), n, texts_of))
        return links[-1][2] > 0

    def grown(found_at: str | None) -> tuple[DataFrame, str]:
        """The components of all links so far."""
        remove(spark, *filter(None, [found_at]))
        return components(functools.reduce(DataFrame.union, [made for made, _, _ in links]), sum(n for _, _, n in links))

    found, found_at = spark.createDataFrame([], "id long, component long"), None
    if seen["n"]:
        best = likely.groupBy("a", "ha").agg(F.max_by(F.struct("b", "hb"), F.struct("shared", -F.col("b"), "hb")).alias("m")).select("a", "ha", "m.*")
        if link(best, seen["n"]):
            found, found_at = grown(found_at)
        others, others_at, seen = counted(_placed(_placed(likely, found, "a", "ca"), found, "b", "cb").where("ca != cb").join(best.select("a", "ha", "b", "hb"), ["a", "ha", "b", "hb"], "left_anti").select("a", "ha", "b", "hb"), "others")
        if seen["n"] and link(others, seen["n"]):
            found, found_at = grown(found_at)
        remove(spark, others_at)
    open_, open_at, seen = counted(_open(members, found, ids), "open", hot=F.count_if(F.col("size") > HOT))
    if seen["n"]:
        left, left_at, pairs = counted(_left(open_.where(F.col("size") <= HOT)), "left")
        late = link(left, pairs["n"]) if pairs["n"] else False
        remove(spark, left_at)
        if seen["hot"]:
            links.append(_hot_links(open_.where(F.col("size") > HOT), found, ids, texts_of))
            late |= links[-1][2] > 0
        if late:
            found, found_at = grown(found_at)
    classes, classes_at = written(_placed(nodes.select("k1", "k2", F.col("id").alias("rep")), found, "rep", "component"), "classes")
    remove(spark, nodes_at, members_at, likely_at, open_at, *[at for _, at, _ in links], *filter(None, [found_at]))
    tidy(spark)
    out = all_.select("id", "h", "n", "k1", "k2", *keep).join(classes.drop("rep"), ["k1", "k2"], "left")
    return out.select("id", "h", "n", *keep, F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def _open(members: DataFrame, found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The members of buckets in which separate components remain, with the bucket's largest component and sizes."""
    placed = _placed(members.where("size > 2").select("bucket", "id", "size"), found)
    sizes = placed.groupBy("bucket", "c").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("bucket").agg(F.max_by("c", F.struct("n", -F.col("c"))).alias("main"), F.max("n").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    return placed.join(shape.select("bucket", "main", "most"), "bucket").join(nodes, "id")


def _left(small: DataFrame) -> DataFrame:
    """Pairs (a, ha, b, hb) left to check: in one bucket, of different components, alike by signature.

    Of each bucket, the members outside its largest component meet all others; that component's own members don't
    meet each other.
    """
    x, y = small.where("c != main").alias("x"), small.alias("y")
    once = (F.col("y.c") == F.col("y.main")) | (F.col("x.c") < F.col("y.c"))
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") != F.col("y.c")) & once & _alike("x", "y"))
    return pairs.select(F.col("x.id").alias("a"), F.col("x.h").alias("ha"), F.col("y.id").alias("b"), F.col("y.h").alias("hb")).distinct()


def _dealt(rows: DataFrame, outside: Column, n_down: Column, n_across: Column, keep: list[str]) -> DataFrame:
    """Deals rows into blocks: those outside the main component (side 0) by row, all (side 1) by column of blocks."""

    def side(rows: DataFrame, k: int, own: Column, other: Column) -> DataFrame:
        rows = rows.select("*", F.pmod(F.xxhash64("id"), own).cast("int").alias("_mine"), F.explode(F.sequence(F.lit(0), other - 1)).alias("_each"))
        down, across = ("_mine", "_each") if k == 0 else ("_each", "_mine")
        return rows.select(F.col(down).alias("down"), F.col(across).alias("across"), F.lit(k).alias("side"), *keep)

    n_down, n_across = n_down.cast("int"), n_across.cast("int")
    return side(rows.where(outside), 0, n_down, n_across).union(side(rows, 1, n_across, n_down))


def _kin(rows: pa.Table) -> pa.Table:
    """Of one block's members that sizes and signatures let link across components, each with the smallest id they lead to."""
    side = rows["side"].to_numpy()
    x, y = ({c: rows[c].to_numpy()[side == k] for c in ("id", "c", "n", "s1", "s2")} for k in (0, 1))
    may = np.zeros((len(x["id"]), len(y["id"])), bool)
    for i in range(0, len(may), 64):
        of = {c: v[i : i + 64, None] for c, v in x.items()}
        differ = np.bitwise_count((of["s1"] ^ y["s1"]).view(np.uint64)) + np.bitwise_count((of["s2"] ^ y["s2"]).view(np.uint64))
        sizes = 100 * np.minimum(of["n"], y["n"]) >= LINK * np.maximum(of["n"], y["n"])
        may[i : i + 64] = (differ <= MOST_BITS) & sizes & (of["c"] != y["c"])
    some, to = may.any(axis=1), may.any(axis=0)
    may, ids, others = may[some][:, to], x["id"][some], y["id"][to]
    far, own, least = np.iinfo(np.int64).max, ids.copy(), others.copy()
    while len(ids):  # the least id spreads both ways until it stays
        new = np.minimum(own, np.where(may, least, far).min(axis=1))
        least_new = np.minimum(least, np.where(may, new[:, None], far).min(axis=0))
        if (new == own).all() and (least_new == least).all():
            break
        own, least = new, least_new
    return pa.table({"a": np.concatenate([ids, others]), "b": np.concatenate([own, least])})


def _block(rows: pa.Table) -> pa.Table:
    """Links between the members of one block outside the main component and the others: one per component they reach."""
    side = rows["side"].to_numpy()
    ids, comps = ([rows[c].to_numpy()[side == k] for k in (0, 1)] for c in ("id", "c"))
    if not len(ids[0]) or not len(ids[1]):
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    all_ = [np.frombuffer(v.as_buffer(), np.uint64) for v in rows["values"]]
    sets = [[all_[i] for i in np.flatnonzero(side == k)] for k in (0, 1)]
    known = np.unique(np.concatenate(sets[0]))
    sizes = [np.array([len(x) for x in side]) for side in sets]
    rows_of = [np.repeat(np.arange(len(side)), n) for side, n in zip(sets, sizes)]
    all_of = [np.concatenate(side) for side in sets]
    places = [np.minimum(np.searchsorted(known, x), len(known) - 1) for x in all_of]
    have = [known[at] == x for at, x in zip(places, all_of)]
    both = np.zeros((len(ids[0]), len(ids[1])), np.float32)
    for at in range(0, len(known), COLUMNS):
        part = []
        for k in range(2):
            own = have[k] & (places[k] >= at) & (places[k] < at + COLUMNS)
            part.append(np.zeros((len(sizes[k]), COLUMNS), np.float32))
            part[k][rows_of[k][own], places[k][own] - at] = 1
        both += part[0] @ part[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    apart = comps[0][:, None] != comps[1][None, :]
    i, j = np.nonzero(apart & (both > 0) & (100 * both >= LINK * union))
    first = {(a, c): b for a, c, b in zip(ids[0][i].tolist(), comps[1][j].tolist(), ids[1][j].tolist())}
    return pa.table({"a": pa.array([a for a, _ in first], pa.int64()), "b": pa.array(list(first.values()), pa.int64())})


def _with_sets(texts: DataFrame) -> DataFrame:
    """(id, h, values): the sorted shingle hashes of each text, 8 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sh.shingle_set(t).tobytes() for t in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], names=["id", "h", "values"])

    return in_arrow(texts.select("id", "h", "text"), run, "id long, h long, values binary")


def _hot_links(members: DataFrame, found: DataFrame, ids: DataFrame, texts_of: Texts) -> tuple[DataFrame, str, int]:
    """Links (a, b) still missing among the members of large buckets: exact, and without a row per pair.

    Each bucket is compared by signature, in blocks of DOWN by ACROSS at most, of which only a link to the smallest id of
    kin leaves. What these links connect is a family: all pairs that may still link lie within one. Those outside
    a family's largest component are then compared with all of its members, in blocks of about SHINGLES of whole sets.
    """
    spark = ready(members.sparkSession)
    outside = F.col("size") - F.col("most")
    blocks = _dealt(members, F.col("c") != F.col("main"), F.ceil(outside / DOWN), F.ceil(F.col("size") / ACROSS), ["bucket", "id", "c", "n", "s1", "s2"])
    kin, kin_at, seen = counted(blocks.groupBy("bucket", "down", "across").applyInArrow(_kin, "a long, b long").distinct(), "kin")
    families, families_at = components(kin, seen["n"])
    placed, placed_at, seen = counted(_placed(families.withColumnRenamed("component", "family"), found).join(ids.select("id", "h", "n"), "id"), "placed")
    sizes = placed.groupBy("family", "c").agg(F.sum("n").alias("n"))
    shape = sizes.groupBy("family").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count("*").alias("parts")).where("parts > 1")
    shape, shape_at, shapes = counted(shape.select("family", "main", F.ceil(F.col("all") / (4 * SHINGLES)).alias("n_across"), F.ceil((F.col("all") - F.col("most")) / SHINGLES).alias("n_down")), "shape")
    open_ = placed.join(few(shape, shapes["n"]), "family")
    sets, sets_at = written(_with_sets(texts_of(open_.select("id", "h").distinct(), seen["n"])), "sets")
    blocks = _dealt(open_, F.col("c") != F.col("main"), F.col("n_down"), F.col("n_across"), ["family", "id", "h", "c"])
    made, at, seen = counted(blocks.join(sets, ["id", "h"]).groupBy("family", "down", "across").applyInArrow(_block, "a long, b long"), "linked")
    remove(spark, kin_at, families_at, placed_at, shape_at, sets_at)
    return made, at, seen["n"]


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents (doc_id, text, ..) without the near copies of a smaller doc_id.

    Of rows that repeat a doc_id, only the one with the smallest hash of its text takes part and is kept; of equal texts,
    any one. Rows with a null doc_id stay.
    """
    spark = docs.sparkSession
    twice, twice_at, seen = counted(docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if seen["n"]:
        n_, of_ = unused(docs.columns, "_n", "_of")
        again = few(twice.select(F.col("doc_id").alias(of_)), seen["n"])
        own = docs.join(again, F.col("doc_id") == F.col(of_)).drop(of_)
        own = own.withColumn(n_, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where(F.col(n_) == 1).drop(n_)
        docs = docs.join(again, F.col("doc_id") == F.col(of_), "left_anti").unionByName(own)
    else:
        remove(spark, twice_at)
    all_, all_at = written(signed(docs.select(F.col("doc_id").alias("id"), "text"), BANDS, ROWS), "signed")
    found = linked(all_, texts_by_id(docs.select(F.col("doc_id").alias("id"), "text")))
    gone, _, seen = counted(found.where("id != component").select(F.col("id").alias("doc_id")), "gone")
    remove(spark, all_at)
    return docs.join(few(gone, seen["n"]), "doc_id", "left_anti").select(*docs.columns)


def op3_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return grouped(docs).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
