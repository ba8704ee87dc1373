"""Benchmark decontamination by greedy string tiling.

1. The benchmark is the stated query set. Its seeds, the hashes of MATCH consecutive words of its items, are a table with
   a row for each seed and item; a Bloom filter of bounded size stands for them in the tasks.
2. One pass over the documents, however large the benchmark, keeps the seeds that may be the benchmark's, once for each
   text. Joined with the seed table by hash, they give the pairs of text and item that share a seed; equal texts count
   as one. What no item shares drops out here.
3. Each pair is tiled word by word: the longest match of unmarked words is marked on both sides, again and again, until no
   match of MATCH words is left. The longest length is searched with running Karp-Rabin hashes (of a window from those of
   two prefixes), places are visited in order, and equal hashes count only where the words are equal too. A task holds one
   text and one item at a time, and for them a few numbers for each word, also where both repeat one word.

Coverage is the marked share of the item's words. As tiles may lie in any order, a passage whose sentences were moved is
still covered. A document is contaminated from THRESHOLD on. Of the longest matches the one that comes first in the
document, then in the item, is marked first; of items with equal coverage the one with the smaller id is the best.

Items with fewer than MATCH words match as a whole. Items without words match nothing. Null and empty texts have coverage
0. Very long texts are tiled whole. Rows that repeat an id are judged each. An item with a null id counts like any other;
where it is the best item, the result's item_id is null, and among equal coverages an item with an id comes first. Items
that repeat an id count each. Empty tables: no documents, no rows; no benchmark, nothing is contaminated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import bloom, cut, id_text, map_slices, probed
from millrace.llm.words import grams, mix, utf8, words_of

MATCH = 5
THRESHOLD = 0.5

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Running:
    """Karp-Rabin hashes of all windows of a sequence, each from two prefix hashes; marked words are in no window."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, n = words, words.size
        terms = mix(words.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n)
        self.prefix = np.append(np.uint64(0), np.cumsum(terms, dtype=np.uint64))
        self.back = _powers(_BACK, n)
        self.marked = np.zeros(n, bool)

    def free(self, size: int) -> np.ndarray:
        """Places of windows without a marked word."""
        before = np.append(0, np.cumsum(self.marked))
        return np.flatnonzero(before[size:] == before[:-size]) if size <= self.words.size else np.zeros(0, np.int64)

    def windows(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.prefix[at + size] - self.prefix[at]) * self.back[at]


def _near(doc: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """The document without words outside of shared seeds; -1 stands for what was left out."""
    d, q = Running(doc), Running(item)
    hit = np.flatnonzero(np.isin(d.windows(d.free(least), least), q.windows(q.free(least), least)))
    edge = np.zeros(doc.size + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + least, -1)
    inside = np.cumsum(edge[:-1]) > 0
    first = inside & ~np.append(False, inside[:-1])
    keep = inside | np.append(first[1:], False)
    return np.where(inside, doc, -1)[keep]


def tile(doc: np.ndarray, item: np.ndarray, least: int) -> np.ndarray:
    """Marks of the item's words after greedy tiling with matches of `least` words or more. Words are numbers >= 0."""
    if not least or doc.size < least or item.size < least:
        return np.zeros(item.size, bool)
    doc = _near(doc, item, least)
    d, q = Running(doc), Running(item)
    d.marked |= doc < 0
    longest = item.size
    while True:
        low, high = least - 1, min(longest, doc.size)  # the longest shared length lies in [low, high]
        while low < high:
            size = (low + high + 1) // 2
            if np.isin(d.windows(d.free(size), size), q.windows(q.free(size), size)).any():
                low = size
            else:
                high = size - 1
        if low < least:
            return q.marked
        size, longest = low, low
        places: dict[int, list[int]] = {}
        own = q.free(size)
        for at, h in zip(own[::-1].tolist(), q.windows(own, size)[::-1].tolist(), strict=True):
            places.setdefault(h, []).append(at)  # the first place comes last
        at, done = d.free(size), 0
        hashes = d.windows(at, size)
        shared = np.isin(hashes, np.fromiter(places, np.uint64, len(places)))
        marks = 0
        for p, h in zip(at[shared].tolist(), hashes[shared].tolist(), strict=True):
            if p < done:
                continue
            ways = places[h]
            while ways and q.marked[ways[-1] : ways[-1] + size].any():
                ways.pop()
            if ways and (item[ways[-1] : ways[-1] + size] == doc[p : p + size]).all():
                k = ways.pop()
                q.marked[k : k + size] = True
                d.marked[p : p + size] = True
                done, marks = p + size, marks + 1
        if not marks:  # only unequal words with equal hashes: look for shorter matches
            longest = size - 1


def _seed(hashes: np.ndarray, size: int) -> np.ndarray:
    return mix(grams(hashes, size) + np.uint64(size))


def seeds_of(items: DataFrame, match: int = MATCH) -> DataFrame:
    """(size, g, k): the distinct seeds of each item (k, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w, sizes, found, keys = words_of(batch.column("text")), [], [], []
        for k, a, b in zip(batch.column("k").to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b > a:
                g = np.unique(_seed(w.hashes[a:b], min(match, b - a)))
                found.append(g)
                sizes += [min(match, b - a)] * g.size
                keys += [k] * g.size
        if not found:
            return None
        return pa.record_batch([pa.array(sizes, pa.int32()), pa.array(np.concatenate(found).view(np.int64)), pa.array(keys, pa.int64())], ["size", "g", "k"])

    return map_slices(items.select("k", "text"), run, "size int, g bigint, k bigint")


def _hits(texts: DataFrame, sizes: list[int], sieve: bytes) -> DataFrame:
    """(t, g, raw): for each text with seeds that pass the sieve a row with its bytes, and a row for each such seed."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w, rows = words_of(batch.column("text")), []
        for size in sizes:
            g = _seed(w.hashes, size)
            at = np.flatnonzero(probed(sieve, g))
            doc = np.searchsorted(w.first, at, "right") - 1
            inside = at + size <= w.first[doc + 1]
            rows.append(np.stack([doc[inside].astype(np.uint64), g[at[inside]]], axis=1))
        rows = np.unique(np.concatenate(rows), axis=0) if rows else np.zeros((0, 2), np.uint64)
        if not rows.size:
            return None
        data, offsets = utf8(batch.column("text"))
        docs, back = np.unique(rows[:, 0].astype(np.int64), return_inverse=True)
        raw = [data[offsets[d] : offsets[d + 1]].tobytes() for d in docs.tolist()]
        names = pa.array([hashlib.md5(x).hexdigest() for x in raw])
        n = docs.size
        t = pa.concat_arrays([names, names.take(pa.array(back))])
        g = pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(np.ascontiguousarray(rows[:, 1]).view(np.int64))])
        return pa.record_batch([t, g, pa.concat_arrays([pa.array(raw, pa.binary()), pa.nulls(rows.shape[0], pa.binary())])], ["t", "g", "raw"])

    return map_slices(texts, run, "t string, g bigint, raw binary")


def _tiled(work: DataFrame, match: int) -> DataFrame:
    """(t, item_id, coverage) of rows (t, k, item_id, raw): of each t first the text, with a null k, then its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        doc = np.zeros(0, np.int64)
        for batch in batches:
            out: list[tuple] = []
            for t, k, item_id, raw in zip(*(batch.column(c).to_pylist() for c in ("t", "k", "item_id", "raw")), strict=True):
                words = _WORD.findall(raw.lower())
                if k is None:
                    numbers = {}
                    doc = np.array([numbers.setdefault(x, len(numbers)) for x in words], np.int64)
                else:
                    item = np.array([numbers.get(x, len(numbers)) for x in words], np.int64)
                    out.append((t, item_id, float(tile(doc, item, min(match, item.size)).mean())))
            if out:
                columns = [pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.float64()), strict=True)]
                yield pa.record_batch(columns, ["t", "item_id", "coverage"])

    return work.repartition("t").sortWithinPartitions(F.col("t"), F.col("k").asc_nulls_first()).mapInArrow(run, "t string, item_id bigint, coverage double")


def _texts(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """(t, raw) of the texts in pairs, once each. The others, which only seem to share a seed, go before the exchange."""
    paired = cut(pairs.select("t").distinct(), "paired")
    maybe = bloom(paired.select(F.xxhash64("t"))).column(F.xxhash64("t"))
    return hits.filter("g is null").filter(maybe).groupBy("t").agg(F.first("raw").alias("raw")).join(paired, "t", "left_semi")


def found_in(texts: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, match: int = MATCH) -> DataFrame | None:
    """(t, item_id, coverage, n_items) by MD5 of the text, for texts that share a seed with an item; None without seeds."""
    items = cut(id_text(benchmark, "item_id", "text").withColumn("k", F.monotonically_increasing_id()), "items")
    seeds = cut(seeds_of(items, match), "seeds")
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most MATCH
    if not sizes:
        return None
    hits = cut(_hits(texts, sizes, bloom(seeds.select("g").distinct()).bitmap), "hits")
    pairs = hits.filter("g is not null").select("t", "g").distinct().join(seeds.select("g", "k"), "g").select("t", "k").distinct()
    pairs = cut(pairs, "pairs")
    own = _texts(hits, pairs)
    own = own.select("t", F.lit(None).cast("bigint").alias("k"), F.lit(None).cast("bigint").alias("item_id"), "raw")
    theirs = pairs.join(items, "k").select("t", "k", F.col("doc_id").alias("item_id"), F.col("text").cast("binary").alias("raw"))
    tiled = _tiled(own.unionByName(theirs), match).filter("coverage > 0")
    rank = F.struct(-F.col("coverage"), F.col("item_id").isNull(), "item_id")
    best = tiled.groupBy("t").agg(F.min_by(F.struct("item_id", "coverage"), rank).alias("b"), F.count_if(F.col("coverage") >= threshold).cast("int").alias("n_items"))
    return cut(best.select("t", "b.item_id", "b.coverage", "n_items"), "found")


def overlaps(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, further columns to keep, item_id and coverage of the best item, n_items at or above the threshold,
    contaminated."""
    keep = keep or []
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)]
    )
    found = found_in(rows.select("text"), benchmark, threshold)
    clean = {"item_id": F.lit(None).cast("bigint"), "coverage": F.lit(0.0), "n_items": F.lit(0)}
    if found is None:
        out = rows.withColumns(clean)
    else:  # only rows that may have an entry meet the table; all others pass by
        t = F.md5(F.col("text").cast("binary"))
        maybe = bloom(found.select(F.xxhash64("t"))).column(F.xxhash64(t))
        hit = rows.filter(maybe).withColumn("t", t).join(found, "t", "left").drop("t").fillna({"coverage": 0.0, "n_items": 0})
        out = rows.filter(~maybe).withColumns(clean).unionByName(hit)
    return out.select(
        "doc_id", "text", *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "item_id", "coverage", "n_items", (F.col("coverage") >= threshold).alias("contaminated")
    )
