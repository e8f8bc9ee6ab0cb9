"""Substring dedup: paragraphs, and passages inside them, that repeat across documents.

Paragraphs of ``min_words`` words and more are single lines, and lines joined as ``_joined`` says. They are compared by
MinHash banding tuned for high recall, exact Jaccard of 5-word shingles of the whole paragraphs and star components, as
documents are in ``neardup``. Components that several documents hold decide what is removed.

A passage pasted into the middle of a longer paragraph shares too little of that paragraph, so each text, line ends
ignored, is also searched for passages of ``min_words`` that another document holds word for word, in two steps. First,
of every stretch of ``min_words`` words the least hash of its grams of half as many (the rightmost of equal ones) is an
anchor: equal stretches have equal anchors, so one can only recur if its anchor does. In what these anchors leave, windows
of four fifths of ``min_words`` are chosen by the same rule, so that each verbatim passage of ``min_words`` holds one whole,
and compared by a 64-bit hash of their words. Overlapping windows of the same fate join into runs. Each end of a run is then
followed to the last word in common with the first document that holds the window there (of the first itself: with
the last that does), from the first or the last place where that one has the window, whichever leads further. What has fewer than ``min_words`` words after that is left alone. A run that lies inside a
paragraph's span of the same fate adds nothing and is left out, as is a kept one inside a removed one.

A component (of paragraphs, or of equal windows) counts if several documents hold it. Its occurrence in the smallest
doc_id stays, the others are removed. Spans give code points, the end excluded. A kept run may overlap a removed one,
since another passage can begin inside a passage that a smaller id holds.

Null and empty texts have no spans; null ids are left out; rows that repeat an id count as one document. Very long texts
are searched whole. An empty table gives an empty result. ``repeats`` ignores other columns, ``without_repeats`` keeps them.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm import neardup
from tonelake.llm import shingles as sh
from tonelake.llm.common import WORD, counted, in_arrow, remove, table, tidy, unused, written

MIN_WORDS = 50
#: Bands of rows for paragraphs: a pair of likeness 0.75 shares no band once in 700 pairs, one of 0.9 once in 6 million.
BANDS, ROWS = 12, 3
#: What ends a sentence at the end of a line, with closing quotes and brackets behind it.
_SENTENCE_END = re.compile("(?:[.!?:;]|…|。|！|？)(?:[\"')\\]]|”|’|»)*$".encode())
#: Rows of spans that may be broadcast: 8 MB or so.
MOST_BROADCAST = 200_000


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in bytes, of the words."""
    b = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~((b == 32) | ((b >= 9) & (b <= 13))), [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


#: The base of the words' rolling hash and its inverse, both modulo 2 to the 64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


@functools.lru_cache(8)
def _many_powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, base)]))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of a base."""
    return _many_powers(base, max(4096, 1 << n.bit_length()))[:n]


class Words:
    """The words of several texts in a row: places, hashes and documents."""

    def __init__(self, texts: list[bytes | None]) -> None:
        whole = [t or b"" for t in texts]
        self.text = b"\n".join([*whole, b""])
        self.starts, self.ends = word_spans(self.text)
        self.hashes = sh.hashes_at(self.text.lower(), self.starts, self.ends)
        sizes = np.array([len(t) + 1 for t in whole], np.int64)
        self.at = np.cumsum(sizes) - sizes  # where each text begins
        self.doc = np.searchsorted(self.at, self.starts, side="right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))  # each text's first word
        self.upto = np.searchsorted(self.doc, np.arange(len(texts)), side="right")
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.hashes * _powers(_BASE, len(self.hashes)))])

    def whole(self, n: int) -> np.ndarray:
        """Whether each run of ``n`` words lies in one text."""
        many = max(0, len(self.sums) - n)
        return self.doc[:many] == self.doc[n - 1 : n - 1 + many]

    def grams(self, n: int) -> np.ndarray:
        """The hash of each run of ``n`` words."""
        many = max(0, len(self.sums) - n)
        return sh.mixed((self.sums[n:] - self.sums[:many]) * _powers(_INVERSE, many) + np.uint64(n)).view(np.int64)

    def points(self, places: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Byte places as code points of their texts."""
        before = np.concatenate([[0], np.cumsum((np.frombuffer(self.text, np.uint8) & 0xC0) != 0x80)])
        return before[places] - before[self.at[docs]]


def leasts(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of the least, of equal ones the rightmost."""
    least, at, have = values, np.arange(len(values)), 1
    while have < width and len(least):
        step = min(have, width - have)
        n = max(0, len(least) - step)
        right = least[step:] <= least[:n]
        least, at = np.where(right, least[step:], least[:n]), np.where(right, at[step:], at[:n])
        have += step
    return at


def _joined(w: Words, turn: np.ndarray, gap: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the paragraphs of several lines, which begin at the words ``turn``, ``gap`` lines further on.

    Lines under ``least`` words in a row are one where the text has blank lines, which then part paragraphs, or where
    a line ends inside a sentence. Longer lines stand for themselves.
    """
    breaks, gap = turn[1:-1], gap[1:]
    other = w.doc[breaks] != w.doc[breaks - 1]
    blank = (gap > 1) & ~other
    long = turn[1:] - turn[:-1] >= least
    apart = blank | other | long[1:] | long[:-1]
    edge = np.concatenate([[0], breaks[apart], turn[-1:]])
    inner = breaks[~apart]
    spaced = np.zeros(len(w.at), bool)
    spaced[w.doc[breaks[blank]]] = True
    wrapped = np.zeros(len(w.starts) + 1, bool)
    loose = spaced[w.doc[inner]]
    wrapped[inner[loose]] = True
    inner = inner[~loose]
    wrapped[inner] = [not _SENTENCE_END.search(w.text[max(0, i - 32) : i]) for i in w.ends[inner - 1].tolist()]
    some = np.add.reduceat(wrapped, edge[:-1]) > 0
    own = some & (edge[1:] - edge[:-1] >= least)
    return edge[:-1][own], edge[1:][own]


def paragraphs(w: Words, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and ends of the paragraphs of ``least`` words and more, in order."""
    if not len(w.starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(w.text, np.uint8) == 10), w.starts)
    turn = np.concatenate([[0], np.flatnonzero(np.diff(line)) + 1, [len(line)]])
    gap = np.diff(line[turn[:-1]], prepend=0)
    own = turn[1:] - turn[:-1] >= least
    a, b = (np.concatenate(x) for x in zip((turn[:-1][own], turn[1:][own]), _joined(w, turn, gap, least)))
    order = np.argsort(a)
    return a[order], b[order]


_UNITS = f"doc long, h long, anchors array<long>, start long, stop long, n_words long, {sh.SIGNATURE}"


def _chosen(values: np.ndarray, width: int, of: np.ndarray) -> np.ndarray:
    """The places, in order, of the leasts of those windows that ``of`` marks."""
    at = leasts(values, width)[: len(of)][of]  # never falls, so equal ones lie in a row
    return at[np.diff(at, prepend=-1) != 0]


def cut(docs: DataFrame, least: int) -> DataFrame:
    """A row for each text with its distinct anchors, and one for each paragraph with its signature."""
    gram = least // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column(2).cast(pa.binary()).to_pylist())
            grams, inside = w.grams(gram), w.whole(least)
            at = _chosen(grams, least - gram + 1, inside)
            ends = np.searchsorted(w.doc[at], np.arange(len(batch) + 1))
            keys, sizes = sh.distinct_parts(grams[at], ends[:-1], ends[1:])
            some = np.flatnonzero(sizes)
            n = len(some)
            a, b = paragraphs(w, least)
            values = sh.shingles(w.hashes) if len(a) else np.empty(0, np.uint64)
            signs = sh.signature(*sh.distinct_parts(values, a, b - sh.SHINGLE + 1), BANDS, ROWS)
            m, of = len(a), w.doc[a]
            ids, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            anchors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[some])]), pa.int32()), pa.array(keys))
            first = [pa.array(ids[some]), pa.array(h[some]), anchors, *[pa.nulls(n, pa.int64())] * 8, pa.nulls(n, pa.list_(pa.int64()))]
            places = [pa.array(x, pa.int64()) for x in (w.points(w.starts[a], of), w.points(w.ends[b - 1], of), b - a)]
            then = [pa.array(ids[of]), pa.array(h[of]), pa.nulls(m, pa.list_(pa.int64())), *places, *signs]
            names = ["doc", "h", "anchors", "start", "stop", "n_words", "n", "k1", "k2", "s1", "s2", "bands"]
            for cols in (first, then):
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return in_arrow(docs.select("id", "h", "text"), run, _UNITS)


def _side(least: int) -> int:
    """By how many words the chosen windows are shorter than ``least``; consecutive ones are no more than one word further apart."""
    return max(2, least // 5)


def windows(near: DataFrame, least: int) -> DataFrame:
    """Of (row, doc, text, keys) the chosen windows near an anchor among the keys: first word, hash, and where the text has the hash first and last."""
    gram, side = least // 2, _side(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column(2).cast(pa.binary()).to_pylist())
            grams, of = w.grams(gram), w.whole(least)
            at = leasts(grams, least - gram + 1)[: len(of)]
            wanted = np.zeros(len(grams), bool)
            tried = _chosen(grams, least - gram + 1, of)
            wanted[tried[np.isin(grams[tried], batch.column(3).flatten().to_numpy())]] = True
            of &= wanted[at]
            keys = w.grams(least - side)
            at = _chosen(keys, side + 1, of)
            n, key = w.doc[at], keys[at]
            row, doc = (batch.column(c).to_numpy()[n] for c in (0, 1))
            at -= w.first[n]
            cols = [row, doc, at, key, *_ends_of(n, key, at)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["row", "doc", "at", "key", "low", "high"])

    return in_arrow(near.select("row", "doc", "text", "keys"), run, "row long, doc long, at long, key long, low long, high long")


def _ends_of(n: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, which ascend in each row ``n``, the first and the last one of the same row and key."""
    order = np.lexsort((key, n))
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = (np.diff(n[order]) != 0) | (np.diff(key[order]) != 0)
    low, high, group = np.empty_like(at), np.empty_like(at), np.cumsum(new[:-1]) - 1
    low[order], high[order] = at[order[new[:-1]]][group], at[order[new[1:]]][group]
    return low, high


def _merged(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Of (row, doc, found) the runs that overlapping windows of one fate make, in words, and where their ends lie in another holder.

    A holder may have a window several times, as in words that repeat with a period; a run then has a row with the first of
    the places and one with the last.
    """
    for batch in batches:
        of = batch.column(2)
        at, first, kept, other, low, high = (of.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(6))
        n = np.repeat(np.arange(len(batch)), np.diff(of.offsets.to_numpy()))
        order = np.lexsort((at, kept, n))
        at, first, kept, other, low, high, n = (x[order] for x in (at, first, kept, other, low, high, n))
        new = np.ones(len(at), bool)
        new[1:] = (n[1:] != n[:-1]) | (kept[1:] != kept[:-1]) | (at[1:] >= at[:-1] + window)
        i = np.flatnonzero(new)
        j = np.concatenate([i[1:], [len(at)]])[: len(i)] - 1
        least = np.minimum.reduceat(first, i) if len(i) else first[:0]
        again = np.flatnonzero((low[i] != high[i]) | (low[j] != high[j]))
        for place, some in ((low, slice(None)), (high, again)):
            x, y = i[some], j[some]
            row, doc = (batch.column(c).to_numpy()[n[x]] for c in (0, 1))
            cols = [row, doc, at[x], at[y] + window, other[x], place[x], other[y], place[y] + window, least[some]]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(kept[x].astype(bool))], names=["row", "doc", "a", "b", "row_a", "at_a", "row_b", "at_b", "component_id", "kept"])


def _around(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """Of (row, text, places) the hashes of ``side`` words before and from each place (0 outside the text), and where they start and end in code points."""
    for batch in batches:
        w = Words(batch.column(1).cast(pa.binary()).to_pylist())
        places = batch.column(2)
        n = np.repeat(np.arange(len(batch)), np.diff(places.offsets.to_numpy()))
        at = places.flatten().to_numpy() + w.first[n]
        before, after = at[:, None] + np.arange(-side, 0), at[:, None] + np.arange(side)
        lists, last = [], max(0, len(w.starts) - 1)
        for words in (before, after):
            known = (words >= w.first[n][:, None]) & (words < w.upto[n][:, None])
            lists.append(np.where(known, (w.hashes | np.uint64(1))[np.clip(words, 0, last)].view(np.int64), 0))
        for words, edge in ((np.concatenate([before, at[:, None]], axis=1), w.starts), (np.concatenate([at[:, None] - 1, after], axis=1), w.ends)):
            words = np.clip(words, 0, last)
            lists.append(w.points(edge[words.ravel()], np.repeat(n, side + 1)).reshape(words.shape))
        cols = [pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int64())) for x in lists]
        yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[n]), places.flatten(), *cols], names=["row", "place", "before", "after", "starts", "ends"])


def _extended(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    """Follows runs at both ends as far as the words of the other holder are the same."""
    for batch in batches:
        def part(c: str, n: int) -> np.ndarray:
            return batch.column(c).flatten().to_numpy().reshape(len(batch), n)

        far = []
        for own, other, turn in (("before", "other_before", -1), ("after", "other_after", 1)):
            x = part(own, side)
            same = (x == part(other, side)) & (x != 0)
            far.append(np.logical_and.accumulate(same[:, ::turn], axis=1).sum(axis=1))
        each = np.arange(len(batch))
        start, stop = part("starts", side + 1)[each, side - far[0]], part("ends", side + 1)[each, far[1]]
        first, end = batch.column("a").to_numpy() - far[0], batch.column("b").to_numpy() + far[1]
        own = ["row", "doc", "a", "b", "component_id", "kept"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, own), *(pa.array(x, pa.int64()) for x in (start, stop, first, end))], names=[*own, "start", "stop", "first", "end"])


def _runs_of(docs: DataFrame, units: DataFrame, least: int) -> tuple[DataFrame, str]:
    """The verbatim passages, a table; also its path."""
    spark, side = docs.sparkSession, _side(least)
    window = least - side
    anchors = units.where("anchors IS NOT NULL").select("doc", "h", F.explode("anchors").alias("key"))
    again = anchors.groupBy("key").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a != b").select("key")
    keys = anchors.join(again, "key").groupBy(F.col("doc").alias("id"), "h").agg(F.collect_set("key").alias("keys"))
    near, near_at = written(docs.join(keys, ["id", "h"]).select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("doc"), "h", "text", "keys"), "near")
    tidy(spark)
    made, made_at = written(windows(near, least), "windows")
    holder = F.struct("doc", "row", "low", "high")
    ends = made.groupBy("key").agg(F.min(holder).alias("x"), F.max(holder).alias("y")).where("x.doc != y.doc")
    ends, ends_at = written(ends, "holders")  # a table, so that Spark deals it anew and can split what many documents hold
    kept = F.col("doc") == F.col("x.doc")
    other = F.when(kept, F.col("y")).otherwise(F.col("x"))
    pairs = made.join(ends, "key").select("row", "doc", F.struct("at", F.col("x.doc").alias("first"), kept.alias("kept"), other["row"].alias("other"), other["low"].alias("low"), other["high"].alias("high")).alias("f"))
    runs = in_arrow(pairs.groupBy("row", "doc").agg(F.collect_list("f").alias("found")), functools.partial(_merged, window=window), "row long, doc long, a long, b long, row_a long, at_a long, row_b long, at_b long, component_id long, kept boolean")
    runs, runs_at = written(runs, "runs")
    remove(spark, made_at, ends_at)
    tidy(spark)
    asked = [runs.select(F.col(r).alias("row"), F.col(c).alias("place")) for r, c in (("row", "a"), ("row", "b"), ("row_a", "at_a"), ("row_b", "at_b"))]
    asked = functools.reduce(DataFrame.union, asked).groupBy("row").agg(F.collect_set("place").alias("places"))
    told = in_arrow(near.join(asked, "row").select("row", "text", "places"), functools.partial(_around, side=side), "row long, place long, before array<long>, after array<long>, starts array<long>, ends array<long>")
    told, told_at = written(told, "ends")
    full = runs
    for r, c, names in (("row", "a", {"before": "before", "starts": "starts"}), ("row", "b", {"after": "after", "ends": "ends"}), ("row_a", "at_a", {"before": "other_before"}), ("row_b", "at_b", {"after": "other_after"})):
        full = full.join(told.select(F.col("row").alias(r), F.col("place").alias(c), *[F.col(k).alias(v) for k, v in names.items()]), [r, c])
    full = in_arrow(full, functools.partial(_extended, side=side), "row long, doc long, a long, b long, component_id long, kept boolean, start long, stop long, first long, end long")
    full = full.groupBy("row", F.col("doc").alias("doc_id"), "a", "b", "component_id", "kept").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("end") - F.min("first")).alias("n_words"))
    full, full_at = written(full.drop("a", "b").where(F.col("n_words") >= least).join(near.select("row", "h"), "row").drop("row").distinct(), "passages")
    remove(spark, near_at, runs_at, told_at)
    gone = full.where("NOT kept").select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "h", "start", "stop")])
    inside = F.col("kept") & (F.col("doc_id") == F.col("_doc_id")) & (F.col("h") == F.col("_h")) & (F.col("start") >= F.col("_start")) & (F.col("stop") <= F.col("_stop"))
    return full.join(gone, inside, "left_anti"), full_at


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, h, kind, start, stop, n_words, component_id, kept): spans of (id, text) that several documents hold.

    ``component_id`` is the smallest doc_id that holds the paragraph's component or a window of the run, ``h`` a hash of
    the text. The result is a table in the shared folder.
    """
    docs = docs.where("id IS NOT NULL").select("id", F.xxhash64("text").alias("h"), "text")
    spark = docs.sparkSession
    units, units_at = written(cut(docs, min_words).withColumn("id", F.monotonically_increasing_id()), "units")
    runs, runs_at = _runs_of(docs, units, min_words)

    told = units.where("anchors IS NULL").drop("anchors")

    def texts_of(keys: DataFrame, n: int) -> DataFrame:
        keys = neardup.few(keys, n)
        at = neardup.few(told.join(keys, ["id", "h"], "left_semi").select(F.col("id").alias("_id"), F.col("doc").alias("id"), "h", "start", "stop"), n)
        part = F.substring("text", F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
        return docs.join(at, ["id", "h"]).select(F.col("_id").alias("id"), "h", part.alias("text")).dropDuplicates(["id", "h"])

    named = neardup.linked(told, texts_of, keep=("doc", "start", "stop", "n_words"))
    held = named.groupBy("component").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first != last").drop("last")
    lines = named.join(held, "component").select(F.col("doc").alias("doc_id"), "h", "start", "stop", "n_words", F.col("first").alias("component_id"), (F.col("first") == F.col("doc")).alias("kept")).distinct()
    lines, lines_at = written(lines, "paragraphs")
    wide = lines.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "h", "kept", "start", "stop")])
    inside = (F.col("start") >= F.col("_start")) & (F.col("stop") <= F.col("_stop"))
    for c in ("doc_id", "h", "kept"):
        inside &= F.col(c) == F.col(f"_{c}")
    out = runs.join(wide, inside, "left_anti").withColumn("kind", F.lit("run")).unionByName(lines.withColumn("kind", F.lit("paragraph")))
    out, _ = written(out.select("doc_id", "h", "kind", "start", "stop", "n_words", "component_id", "kept"), "spans")
    remove(spark, units_at, runs_at, lines_at)
    tidy(spark)
    return out


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of documents (doc_id, text, ..) with the spans that aren't kept cut out; texts without a word go."""
    id_, h_, spans_ = unused(docs.columns, "_id", "_h", "_spans")
    found = repeats(docs.select(F.col("doc_id").alias("id"), "text"), min_words).where("NOT kept")
    found, _, seen = counted(found.groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h_)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans_)), "cuts", spans=F.sum(F.size(spans_)))
    few = seen["n"] <= MOST_BROADCAST and (seen["spans"] or 0) <= MOST_BROADCAST
    df = docs.join(F.broadcast(found) if few else found, (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(h_)), "left")
    names = docs.columns

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column(len(names)).to_pylist()):
                if gone and text:
                    parts, at = [], 0
                    for span in gone:
                        parts.append(text[at : max(at, span["start"])])
                        at = max(at, span["stop"])
                    text = "".join([*parts, text[at:]])
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return in_arrow(df.select(*[docs[c] for c in names], spans_), cut_out, docs.schema).where(F.col("text").rlike(WORD))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).drop("h")
