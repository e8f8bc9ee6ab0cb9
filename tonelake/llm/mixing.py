"""Mixing sources to target weights: subset-sum budget fitting.

A source's budget is its target in words. Whole copies of the source are taken while they fit. For the rest, documents
are counted by exact length; every length gives the same share of its documents, what rounding leaves being carried on
from each length to the next from a seeded start, so that every range of lengths gives that share at any size of the
source. Bounded-knapsack dynamic programming then takes or gives back a few documents, of lengths spread over all, to
fit the budget, to the word where a choice does; it gets more documents only while none does. Which documents of a
length are taken follows a seeded hash of doc_id and text, so reruns agree.

A document is taken 0, 1 or 2 times. Texts without a word, null included, have size 0 and are taken 0 times. Null is a
source of its own, the last. Rows that repeat count each; where a length's quota ends among rows with equal id and text,
exactly as many of these are taken as are left of it, whatever their layout: such rows are counted by all their columns, and
come out again as often as they were counted. An empty table gives an empty result. Other columns are kept, whatever their names.

A length that very many documents of a source share is split by hash into parts of about PART, whose counts decide in
which part the quota ends; only there hashes are ranked. One row per source reaches the driver.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonelake.llm.common import WORD, counted, remove, table, unused, written
from tonelake.session import ready

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
MOST_COPIES = 2
PART = 1000
#: Rows that repeat and come out again at a time.
REPEATS = 1 << 16
#: Lengths of a source (rows of the plan) that may be broadcast: about 100 bytes each.
MOST_BROADCAST = 100_000
#: Lengths that the dynamic programme may change at first.
FEW = 4


def shared_out(sizes: list[int], weights: list[float], total: float, most: float = MOST_COPIES) -> list[float]:
    """``total`` in proportion to weights, each at most ``most`` times its size; the excess goes to the others likewise."""
    out, open_ = [0.0] * len(sizes), {i for i, s in enumerate(sizes) if s > 0 and weights[i] > 0}
    left = min(total, most * sum(sizes[i] for i in open_))
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole >= most * sizes[i]}
        if not full:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in full:
            out[i] = float(most * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def _knapsack(lengths: np.ndarray, have: np.ndarray, most: int) -> np.ndarray:
    """How many of each length to take so that they sum to ``most`` or as little below as can be."""
    take, reach, steps = np.zeros(len(lengths), np.int64), 1, []
    for i in range(len(lengths)):  # binary parts of each count: every number of them can be had
        spare, part = min(int(have[i]), most // int(lengths[i])), 1
        while spare > 0 and not reach >> most & 1:
            n = min(part, spare)
            steps.append((i, n, reach))
            reach |= (reach << n * int(lengths[i])) & ((1 << most + 1) - 1)
            spare, part = spare - n, part * 2
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            take[i] += n
            at -= n * int(lengths[i])
    return take


def fitted(lengths: np.ndarray, have: np.ndarray, budget: int, start: float = 0.5) -> np.ndarray:
    """How many documents of each length to take, so that their lengths sum to ``budget`` or just below.

    ``start``, from 0 to below 1, is what the first length is handed on by rounding.
    """
    order = np.argsort(lengths, kind="stable")
    size, n = lengths.astype(np.int64)[order], have.astype(np.int64)[order]
    whole = int((size * n).sum())
    if budget >= whole:
        return have.astype(np.int64)
    handed = int(start * whole)
    upto = [0, *((c * budget + handed) // whole for c in np.cumsum(n).tolist())]
    take = np.diff(np.array(upto, np.int64))
    few, each = FEW, 1
    out_of_reach = budget % int(np.gcd.reduce(size[n > 0]))  # every sum is a multiple of it
    while True:
        at = np.unique(np.linspace(0, len(size) - 1, few).round().astype(np.int64))
        back, more = np.minimum(take[at], each), np.minimum(n[at] - take[at], each)
        rest = budget - int((take * size).sum() - (back * size[at]).sum())
        whole_pool = len(at) == len(size) and each >= int(n.max())
        if rest >= 0:
            changed = _knapsack(size[at][::-1], (back + more)[::-1], rest)[::-1]
            if int((changed * size[at]).sum()) == rest - out_of_reach or whole_pool:
                break
        few, each = few * 2, each + (few >= len(size)) * each
    take[at] += changed - back
    out = np.empty_like(take)
    out[order] = take
    return out


def _plan(rows: pa.Table, seed: int) -> pa.Table:
    """For the lengths of one source: how many documents get a copy more than ``full``."""
    size, n = rows["size"].to_numpy(), rows["n"].to_numpy()
    whole, budget = int((size * n).sum()), round(rows["target"][0].as_py())
    full = min(MOST_COPIES, budget // whole) if whole else 0
    quota, some = np.zeros(len(size), np.int64), size > 0
    if whole and full < MOST_COPIES:
        quota[some] = fitted(size[some], n[some], budget - full * whole, np.random.default_rng([seed, whole]).random())
    return rows.append_column("full", pa.array(np.full(len(size), full, np.int64))).append_column("quota", pa.array(quota))


def _sized(docs: DataFrame, seed: int, size: str, mark: str) -> DataFrame:
    """Adds a text's words and the seeded hash of its row, which decides whether the row is taken."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({size: words, mark: F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))})


def planned(sized: DataFrame, weights: tuple, total: float, seed: int) -> tuple[DataFrame, bool]:
    """(source, size, n, source_size, target, full, last_part, last, tied, same) of (source, size, mark), a row per length of a
    source; and whether there are lengths whose quota ends among rows of one mark.

    Of the rows of a length those are taken once more than ``full`` whose part is below ``last_part`` or whose mark in that
    part is below ``last``, and of the ``same`` with that very mark (rows that repeat) ``tied``.
    """
    spark = ready(sized.sparkSession)
    by_length, _ = written(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    sources = [tuple(r) for r in by_length.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s")).collect()]
    sources.sort(key=lambda r: (r[0] is None, r[0] or ""))
    targets = shared_out([s for _, s in sources], [weights[i % len(weights)] for i in range(len(sources))], total * sum(s for _, s in sources))
    known = spark.createDataFrame([(k, s, t) for (k, s), t in zip(sources, targets)], "k string, source_size long, target double")
    rows = by_length.join(known, F.col("source").eqNullSafe(F.col("k"))).drop("k")
    plan, _, seen = counted(rows.select("source", "size", "n", "source_size", "target").groupBy("source").applyInArrow(lambda rows: _plan(rows, seed), "source string, size long, n long, source_size long, target double, full long, quota long"), "plan")
    open_ = plan.where("quota > 0 AND quota < n").select("source", "size", "n", "quota")
    at = _joined(sized, open_, seen["n"], ["source", "size"]).withColumn("part", _part())
    key = ["source", "size", "part"]
    parts = at.groupBy(*key, "quota").agg(F.count("*").alias("in"))
    before = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("in").over(before), F.lit(0))).where("before < quota AND before + in >= quota").drop("in")
    cells = _joined(at.drop("quota", "n"), parts, seen["n"], key).groupBy(*key, "quota", "before", "mark").agg(F.count("*").alias("in"))
    upto = F.col("before") + F.sum("in").over(Window.partitionBy(*key).orderBy("mark"))
    cells = cells.withColumn("upto", upto).where("upto >= quota AND upto - in < quota")
    last = cells.select("source", "size", F.col("part").alias("last_part"), F.col("mark").alias("last"), (F.col("quota") - F.col("upto") + F.col("in")).alias("tied"), F.col("in").alias("same"))
    named = last.withColumnsRenamed({"source": "p_source", "size": "p_size"})
    plan = plan.join(named, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")), "left").drop("p_source", "p_size")
    plan = plan.withColumn("full", F.col("full") + ((F.col("quota") == F.col("n")) & (F.col("n") > 0) & (F.col("size") > 0)).cast("long"))
    table_, _, seen = counted(plan.drop("quota"), "mix", unsure=F.count_if(F.col("tied") < F.col("same")))
    return table_, seen["unsure"] > 0


def _part(mark: str = "mark", n: str = "n") -> Column:
    return F.pmod(F.xxhash64(mark, F.lit("part")), F.ceil(F.col(n) / PART))


def _joined(rows: DataFrame, plan: DataFrame, n: int, key: list[str]) -> DataFrame:
    """Rows with what the plan says of their key; sources may be null."""
    named = plan.withColumnsRenamed({k: f"p_{k}" for k in key})
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in key])
    return rows.join(F.broadcast(named) if n <= MOST_BROADCAST else named, on).drop(*[f"p_{k}" for k in key])


def _at_mark(mark: str, plan: str) -> tuple[Column, Column]:
    """Whether a row lies before the mark at which its length's quota ends, and whether it has that very mark."""
    part, last_part, last = _part(mark, f"{plan}n"), F.col(f"{plan}last_part"), F.col(f"{plan}last")
    before = (part < last_part) | ((part == last_part) & (F.col(mark) < last))
    return F.coalesce(before, F.lit(False)), F.coalesce((part == last_part) & (F.col(mark) == last), F.lit(False))


def _counted(rows: DataFrame, mark: str, plan: str, copies: str, unsure: bool) -> DataFrame:
    """Adds ``copies``, how often each row is taken, by the plan's columns, whose names begin with ``plan``.

    Rows that repeat at the mark where a quota ends are folded into one with their number before they are shuffled; so many
    of them as the quota leaves get the copy more, in the order of a hash of all columns.
    """
    before, at = _at_mark(mark, plan)
    open_ = at & (F.col(f"{plan}tied") < F.col(f"{plan}same"))
    more = F.col(f"{plan}full") + (before | (at & ~open_)).cast("long")
    sure = (rows.where(~open_) if unsure else rows).withColumn(copies, F.when(F.col(f"{plan}size") > 0, more).otherwise(0))
    if not unsure:
        return sure
    times, upto, given, part = unused([*rows.columns, copies], "_times", "_upto", "_given", "_part")
    one = rows.where(open_).groupBy(*rows.columns).agg(F.count("*").alias(times))
    order = Window.partitionBy(f"{plan}source", f"{plan}size", mark).orderBy(F.xxhash64(*rows.columns)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = one.withColumn(upto, F.sum(times).over(order)).withColumn(given, F.greatest(F.lit(0), F.least(F.col(times), F.col(f"{plan}tied") - F.col(upto) + F.col(times))))
    halves = F.array(*[F.struct((F.col(f"{plan}full") + k).alias("c"), n.alias("n")) for k, n in ((1, F.col(given)), (0, F.col(times) - F.col(given)))])
    one = one.withColumn(part, F.explode(halves)).where(F.col(part)["n"] > 0).withColumn(copies, F.col(part)["c"])
    again = one.withColumn(times, F.explode(F.expr(f"sequence(1L, `{part}`.n, {REPEATS}L)"))).withColumn(times, F.explode(F.expr(f"sequence(`{times}`, least(`{times}` + {REPEATS - 1}, `{part}`.n))")))
    return sure.unionByName(again.select(*rows.columns, copies))


def decided(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, seed: int = 17) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of (doc_id, text, source)."""
    sized, _ = written(_sized(docs.select("doc_id", "source", "text"), seed, "size", "mark").drop("text"), "sizes")
    plan, unsure = planned(sized, weights, total, seed)
    plan = plan.withColumnsRenamed({c: f"p_{c}" for c in plan.columns})
    at = sized.join(F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size")))
    return _counted(at, "mark", "p_", "copies", unsure).select("doc_id", "source", "size", F.col("p_source_size").alias("source_size"), F.col("p_target").alias("target"), "copies")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, seed: int = 17) -> DataFrame:
    """The rows of documents (doc_id, text, source, ..) as often as the mix takes each; texts aren't shuffled while the plan is small."""
    sized, sized_at = written(_sized(docs.select("doc_id", "source", "text"), seed, "size", "mark").select("source", "size", "mark"), "sizes")
    plan, unsure = planned(sized, weights, total, seed)
    remove(docs.sparkSession, sized_at)
    size, mark, copy = unused(docs.columns, "_size", "_mark", "_copy")
    stem = "_p"
    while any(c.lower().startswith(stem) for c in docs.columns):
        stem += "p"
    plan = plan.withColumnsRenamed({c: f"{stem}_{c}" for c in plan.columns})
    rows = _sized(docs, seed, size, mark).join(F.broadcast(plan) if plan.count() <= MOST_BROADCAST else plan, F.col("source").eqNullSafe(F.col(f"{stem}_source")) & (F.col(size) == F.col(f"{stem}_size")))
    taken = _counted(rows, mark, f"{stem}_", copy, unsure).where(F.col(copy) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy).cast("int")))).select(*docs.columns)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
