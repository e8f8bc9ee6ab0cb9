"""Connected components by alternating large-star and small-star, on DataFrames of links.

A large-star gives each node's larger neighbours its smallest neighbour, a small-star its smaller ones and itself; both
take turns until nothing changes. Each round over many links is a Spark job whose result goes to the shared folder. Up to
FEW links (8 MB) the same rounds run on arrays in one task, so that small inputs don't cost a job a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonelake.llm.common import counted, remove, tidy, written
from tonelake.session import ready

#: Links, as counted, up to which one task does the rounds.
FEW = 250_000


def _least(e: DataFrame, m: Column) -> DataFrame:
    """(u, m): one row per node, dealt anew by m, so that the join with all links of a hub shuffles both sides itself
    and Spark can split the hub, which in the aggregate's own partitions would stay in one task.
    """
    return e.groupBy("u").agg(m.alias("m")).repartition("m")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = _least(both, F.least(F.min("v"), F.min("u")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, F.min("v"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def starred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids with a link and the smallest id that links lead to, by the same rounds on arrays."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    pairs, n = at.reshape(2, -1).T, len(ids)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    while True:
        least = np.arange(n)
        np.minimum.at(least, pairs[:, 0], pairs[:, 1])
        np.minimum.at(least, pairs[:, 1], pairs[:, 0])
        both = np.concatenate([pairs, pairs[:, ::-1]])
        both = both[both[:, 1] > both[:, 0]]
        large = np.stack([both[:, 1], least[both[:, 0]]], axis=1)  # never equal: the least is below both
        least = np.arange(n)
        np.minimum.at(least, large[:, 0], large[:, 1])
        small = np.stack([large[:, 1], least[large[:, 0]]], axis=1)
        own = np.stack([large[:, 0], least[large[:, 0]]], axis=1)
        new = np.concatenate([small, own])
        new = np.unique(new[new[:, 0] != new[:, 1]], axis=0)
        if len(new) == len(pairs) and (new == np.sort(pairs, axis=1)[:, ::-1]).all():
            break
        pairs = new
    least = np.arange(n)
    least[pairs[:, 0]] = pairs[:, 1]
    some = np.unique(pairs)
    return ids[some], ids[least[some]]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [[batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)] for batch in batches]
    a, b = (np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in starred(a, b)], names=["id", "component"])


def components(links: DataFrame, n: int | None = None) -> tuple[DataFrame, str]:
    """(id, component): each linked id and the smallest id that links lead to, a table; also its path.

    ``links`` has two long columns, in any order and direction, ``n`` rows if that is known; loops and repeats are
    harmless, rows with a null are left out, and ids without a link have no row.
    """
    a, b = links.columns
    spark = ready(links.sparkSession)
    links = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    if n is not None and n <= FEW:
        return written(links.coalesce(1).mapInArrow(_in_one_task, "id long, component long"), "components")
    mark = {"h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    e, path, now = counted(links.distinct(), "links", **mark)
    seen = None
    while now != seen and now["n"]:
        seen, last = now, path
        e, path, now = counted(_small_star(_large_star(e)), "links", **mark)
        remove(spark, last)
        tidy(spark)
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    out, out_path = written(nodes, "components")
    remove(spark, path)
    return out, out_path
