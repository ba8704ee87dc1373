"""Near-duplicate documents: MinHash bands find candidates, odd sketches screen them, full shingle sets confirm them.

1. Rows with the same shingle set form a class (128-bit set hash). Everything later runs on one document per class, so
   groups of copies cost one partial aggregate, whatever their size.
2. Each class has SAMPLES MinHash values, as BANDS bands of ROWS values; a pair at similarity 0.75 meets in a band with
   probability 1 - (1 - 0.75**4)**32 = 0.999995. The samples are also folded into an odd sketch: a bitmap of parities
   whose XOR population count estimates how many samples differ.
3. Each bucket joins its members to its smallest one. Components of that graph are families: every pair that meets in a
   band lies in one family. Families of up to BLOCK classes are one group of texts; larger ones are dealt to groups by a
   hash, and a few pivots of the family go to each group. Within a group, pairs whose sketches are close are confirmed on
   their full sets, closest first, unless they are connected already; only links that connect are emitted.
4. Larger families of several components are split again by their rare shingles. In any common order two sets of a and b
   shingles that are linked share one of their first a - m + 1 and b - m + 1, where m = 3 (a + b) / 7 is the least
   intersection; the order here is by frequency in a sample of the family, rarest first. The largest component gives only
   the shingles that others of the family look at. Components of the graph of these shared shingles are exact in that no
   link lies between them; texts that share a template, but no link, fall apart here, as their rarest shingles are their
   own. Within what is left, everything outside the largest component meets all members, in blocks of bounded size. So no
   link between different components of a family is lost, and a family of thousands of near copies, which step 3 has
   joined through its pivots, costs little more.

Full sets are compared only where neither the sketches nor the triangle inequality of the Jaccard distance (through
exact distances to common pivots, which is exact) rules a link out.

Very long texts are compared by their full sets. Equal sets never meet as pairs, so ties need no rule; a component's id is
its smallest doc_id. Rows: null and empty texts have no shingles and stand alone. Repeated rows with one doc_id and equal texts give equal
result rows; with different texts they count as one document that has all these texts. A row with a null doc_id links
with nothing and is kept. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import bloom, cut, discard, id_text, map_slices, probed, slices
from millrace.llm.graph import components
from millrace.llm.words import mix, shingle_sets, words_of

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
SKETCH_WORDS = SKETCH_BITS // 64
#: Estimates below this are not confirmed; at a true similarity of 0.75 that is over five deviations away.
SCREEN = 0.5
#: Texts in a group, and pivots of a large family in each of its groups.
BLOCK = 128
PIVOTS = 8
#: Texts of a large family that say which shingles are rare in it, texts that are looked at with them at a time, and the
#: factor by which classes of set sizes grow.
SAMPLE, FEW = 8, 32
CLASS = 1.06
#: Bytes of text that are hashed at a time.
MOST_TEXT = 500_000
#: intersection * DENOMINATOR >= union * NUMERATOR
NUMERATOR, DENOMINATOR = 75, 100

_rng = np.random.default_rng(751)
_XOR = _rng.integers(0, 1 << 63, SAMPLES, dtype=np.int64).astype(np.uint64)
_MUL = _rng.integers(0, 1 << 62, SAMPLES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))

SIGNATURES = "doc_id bigint, n_shingles bigint, h1 bigint, h2 bigint, bands array<bigint>"


def minhash(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SAMPLES minima (documents, SAMPLES) over non-empty sets laid back to back."""
    out = np.empty((offsets.size - 1, SAMPLES), np.uint64)
    for i in range(SAMPLES):
        x = (sets ^ _XOR[i]) * _MUL[i]
        x ^= x >> np.uint64(32)
        out[:, i] = np.minimum.reduceat(x, offsets[:-1])
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    grouped = samples.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(_SALT[:BANDS], grouped.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ grouped[:, :, r])
    return key


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (documents, SKETCH_WORDS): sample i with value v flips one bit chosen by (i, v)."""
    n = samples.shape[0]
    bit = (mix(samples ^ _SALT) % np.uint64(SKETCH_BITS)).astype(np.int64)
    flips = np.bincount((bit + np.arange(n)[:, None] * SKETCH_BITS).ravel(), minlength=n * SKETCH_BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(n, SKETCH_BITS), axis=1).view(np.uint64)


def similarity(differing_bits: np.ndarray) -> np.ndarray:
    """Estimated share of equal samples from the XOR's population count (Mitzenmacher, Pagh and Pham, 2014)."""
    free = np.maximum(1 - 2 * differing_bits / SKETCH_BITS, 1e-9)
    return 1 + SKETCH_BITS / (4 * SAMPLES) * np.log(free)


def _lists(x: np.ndarray, width: int) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(x).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.shape[0] * width + 1, width, dtype=np.int32)), flat)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: set size, 128-bit set hash and band keys (null for empty sets)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets, offsets = shingle_sets(words_of(batch.column("text")))
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        h1, h2 = np.zeros(sizes.size, np.uint64), np.zeros(sizes.size, np.uint64)
        bands = pa.nulls(sizes.size, pa.list_(pa.int64()))
        if full.size:
            own = offsets[np.append(full, sizes.size)]
            h1[full] = np.add.reduceat(mix(sets), own[:-1])
            h2[full] = np.add.reduceat(mix(sets ^ _XOR[0]), own[:-1])
            place = np.full(sizes.size, -1)
            place[full] = np.arange(full.size)
            bands = _lists(band_keys(minhash(sets, own)), BANDS).take(pa.array(place, mask=place < 0))
        columns = [batch.column("doc_id"), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), bands]
        return pa.record_batch(columns, ["doc_id", "n_shingles", "h1", "h2", "bands"])

    return map_slices(id_text(docs, id_col, text_col), run, SIGNATURES, MOST_TEXT)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if a.size > b.size:
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == b.size] = 0
    return int((b[at] == a).sum())


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    n = _shared(a, b)
    return DENOMINATOR * n >= NUMERATOR * (a.size + b.size - n)


def link(sets: list[np.ndarray], nodes: list[int], comps: list[int], queries: np.ndarray) -> list[tuple[int, int]]:
    """Links (a, b) that connect components. Pairs with at least one query are looked at; all are queries in step 3."""
    n = len(sets)
    offsets = np.concatenate([[0], np.cumsum([x.size for x in sets])])
    sketch = odd_sketch(minhash(np.concatenate(sets), offsets))
    close = np.empty((n, n), np.float32)
    for i in range(n):
        close[i] = similarity(np.bitwise_count(sketch[i] ^ sketch).sum(axis=1))
    maybe = np.triu((close >= SCREEN) & (queries[:, None] | queries[None, :]), 1)
    if n > 4 * PIVOTS:
        most = 1 - NUMERATOR / DENOMINATOR + 1e-9
        for p in range(0, n, -(-n // PIVOTS)):
            shared = np.array([_shared(sets[p], x) for x in sets])
            far = 1 - shared / (sets[p].size + np.diff(offsets) - shared)
            maybe &= np.abs(far[:, None] - far[None, :]) <= most
    parent = {c: c for c in (*comps, *nodes)}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for node, comp in zip(nodes, comps, strict=True):  # rows of one document are one node
        parent[find(node)] = find(comp)
    i, j = np.nonzero(maybe)
    out = []
    for k in np.argsort(-close[i, j], kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        x, y = find(nodes[a]), find(nodes[b])
        if x != y and similar(sets[a], sets[b]):
            parent[y] = x
            out.append((min(nodes[a], nodes[b]), max(nodes[a], nodes[b])))
    return out


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_GROUP = ["family", "qb", "ab"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group; rows arrive group by group, so a task holds one group's sets."""
    key, sets, nodes, comps, queries = None, [], [], [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(sets) > 1:
            found = link(sets, nodes, comps, np.array(queries, bool))
            if found:
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]}, schema=_PAIR)

    for batch in batches:
        for part in slices(batch, most=MOST_TEXT):
            own, offsets = shingle_sets(words_of(part.column("text")))
            keys = zip(*(part.column(c).to_pylist() for c in _GROUP), strict=True)
            rows = zip(keys, part.column("node").to_pylist(), part.column("comp").to_pylist(), part.column("q").to_pylist(), strict=True)
            for i, (at, node, comp, q) in enumerate(rows):
                if at != key:
                    yield from done()
                    key, sets, nodes, comps, queries = at, [], [], [], []
                if offsets[i + 1] > offsets[i]:
                    sets.append(own[offsets[i] : offsets[i + 1]].copy())
                    nodes.append(node)
                    comps.append(comp)
                    queries.append(q)
    yield from done()


def _stars(bands: DataFrame) -> DataFrame:
    """Links (a, b) that join every bucket: each member to the bucket's smallest node.

    A node with several such links keeps the one to the smallest and joins the others to that one, which leaves about one
    link for each node however large its family is. A node's list is bounded by its bands or its shingles.
    """
    least = bands.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("key", "a")
    stars = bands.join(cut(least, "least"), "key").filter("node <> a").select("a", F.col("node").alias("b"))
    own = stars.groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("all"))
    links = own.select(F.col("m").alias("a"), F.explode(F.concat("all", F.array("b"))).alias("b"))
    return links.filter("a <> b").distinct()


def _confirmed(groups: DataFrame) -> DataFrame:
    """Links within the groups (family, qb, ab) of rows (node, comp, q, text)."""
    return _dealt(groups, F.xxhash64("family", "qb"), F.col("ab"), *_GROUP, "node").mapInArrow(_groups, "a bigint, b bigint")


def _first_round(members: DataFrame) -> DataFrame:
    """Groups of up to about BLOCK members, with the family's pivots in each."""
    count = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = ["node", F.col("node").alias("comp"), F.lit(True).alias("q"), "text"]
    own = members.select("family", F.lit(0).alias("qb"), F.pmod(F.xxhash64("node"), count).cast("int").alias("ab"), *rest)
    pivots = members.filter((F.col("n") > BLOCK) & (F.pmod(F.xxhash64("node", F.lit(1)), "n") < PIVOTS))
    return own.unionByName(pivots.select("family", F.lit(0).alias("qb"), F.explode(F.sequence(F.lit(0), count - 1)).alias("ab"), *rest))


def _classes(size: int) -> tuple[int, list[tuple[int, int]]]:
    """The size class of a set, and for it and each smaller class that a linked partner may have the number of rare shingles
    to look at: of its first so many in any order, it shares one with each linked partner of that class."""
    own = int(np.floor(np.log(size) / np.log(CLASS)))
    low = int(np.log(max(size * NUMERATOR / DENOMINATOR - 1, 1)) / np.log(CLASS)) - 1
    out = []
    for other in range(low, own + 1):
        least = int(np.floor(CLASS**other * (1 - 1e-9)))  # no set of that class is smaller
        fewest = -(-NUMERATOR * (size + least) // (NUMERATOR + DENOMINATOR))
        if size - fewest + 1 > 0:
            out.append((other, size - fewest + 1))
    return own, out


_KEYS = pa.schema([("node", pa.int64()), ("key", pa.int64()), ("own", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])


def _dealt(groups: DataFrame, start: Column, number: Column, *order: str) -> DataFrame:
    """Rows with equal `start` and `number` in one partition; consecutive numbers in consecutive ones, so that the groups of
    one large family never pile up."""
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.repartitionById(n, F.pmod(start + number, F.lit(n).cast("bigint")).cast("int")).sortWithinPartitions(*order)


def _prefixes(groups: DataFrame, sieve: bytes | None) -> DataFrame:
    """(node, key, own, low, high) of rows (family, ab, kind, node, text), kind 0 a sample of the family, which each of its
    groups gets: one key for each of a member's rarest shingles, rare meaning in few texts of the sample, with the member's
    class and the range of classes for the smaller of two sets in which the shingle is looked at. With a sieve only keys in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sample, tokens, counts = None, [], None, None
        for batch in batches:
            for part in slices(batch, most=MOST_TEXT):
                own, offsets = shingle_sets(words_of(part.column("text")))
                out = []
                for i, (family, ab, kind, node) in enumerate(zip(*(part.column(c).to_pylist() for c in ("family", "ab", "kind", "node")), strict=True)):
                    if (family, ab) != group:
                        group, sample, tokens = (family, ab), [], None
                    x = own[offsets[i] : offsets[i + 1]]
                    if kind == 0:
                        sample.append(x.copy())
                        continue
                    if tokens is None:
                        tokens, counts = np.unique(np.concatenate([np.zeros(1, np.uint64), *sample]), return_counts=True)
                    at = np.minimum(np.searchsorted(tokens, x), tokens.size - 1)
                    x = x[np.lexsort((x, np.where(tokens[at] == x, counts[at], 0)))]
                    place = mix(np.array([family], np.int64).view(np.uint64))
                    mine, others = _classes(x.size)
                    low, most = others[0]  # larger classes look at fewer shingles
                    high = np.full(most, low, np.int32)
                    for other, n in others:
                        high[:n] = other
                    keys = mix(x[:most] ^ mix(place))
                    seen = slice(None) if sieve is None else probed(sieve, keys)
                    keys, high = keys[seen], high[seen]
                    out.append((np.full(keys.size, node), keys.view(np.int64), np.full(keys.size, mine, np.int32), np.full(keys.size, low, np.int32), high))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=_KEYS)

    return _dealt(groups, F.xxhash64("family"), F.col("ab"), "family", "ab", "kind", "node").mapInArrow(run, "node bigint, key bigint, own int, low int, high int")


def _rare_links(large: DataFrame) -> DataFrame:
    """Links (a, b) between members (family, node, comp, top, n, text) of a family that share a key of rare shingles, such that
    no two linked ones of different components stay apart. `top` is the family's largest component."""
    count = F.ceil(F.col("n") / FEW).cast("int")
    sample = large.filter(F.pmod(F.xxhash64("node", F.lit(3)), "n") < SAMPLE)
    sample = sample.select("family", F.explode(F.sequence(F.lit(0), count - 1)).alias("ab"), F.lit(0).alias("kind"), "node", "text")
    own = large.select("family", F.pmod(F.xxhash64("node"), count).cast("int").alias("ab"), F.lit(1).alias("kind"), "node", "text", (F.col("comp") != F.col("top")).alias("q"))
    queries = cut(_prefixes(sample.unionByName(own.filter("q").drop("q")), None), "query-keys")
    others = cut(_prefixes(sample.unionByName(own.filter("not q").drop("q")), bloom(queries.select("key")).bitmap), "other-keys")
    keys = queries.withColumn("q", F.lit(True)).unionByName(others.withColumn("q", F.lit(False)))
    # of a shingle in several sets, only classes that one of these has and a query looks at
    held = keys.groupBy("key").agg(
        F.min("node").alias("a"),
        F.max("node").alias("z"),
        F.collect_set("own").alias("classes"),
        F.min(F.when(F.col("q"), F.col("low"))).alias("qlow"),
        F.max(F.when(F.col("q"), F.col("high"))).alias("qhigh"),
    )
    shared = keys.join(held.filter("a < z and qlow is not null").drop("a", "z"), "key")
    least, most = F.greatest("low", "qlow"), F.least("high", "qhigh")
    placed = shared.select("node", "own", "q", "key", F.explode(F.filter("classes", lambda c: (c >= least) & (c <= most))).alias("other"))
    placed = cut(placed.select("node", "own", "q", "other", F.xxhash64("key", "other").alias("key")), "placed")
    both = placed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.bool_or(F.col("own") == F.col("other")).alias("small"), F.bool_or("q").alias("q"))
    both = both.filter("a < z and small and q").select("key")  # several sets, of which one is of the smaller class and one a query
    return _stars(cut(placed.select("node", "key").join(both, "key").select("node", "key"), "keys"))


def _second_round(members: DataFrame, labels: DataFrame) -> DataFrame | None:
    """In families of several groups and components: what shares rare shingles, blocks of what lies outside the largest
    component against blocks of all. None if nothing is left to compare."""
    large = members.filter(F.col("n") > BLOCK).join(labels, "node", "left").select("family", "n", "node", F.coalesce("label", "node").alias("comp"), "text")
    large = cut(large, "large")
    tops = large.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("m")).groupBy("family").agg(F.count(F.lit(1)).alias("comps"), F.max_by("comp", F.struct("m", "comp")).alias("top"))
    tops = cut(tops.filter("comps > 1").select("family", "top"), "several")
    split = components(_rare_links(large.join(tops, "family"))).withColumnRenamed("label", "part")
    placed = cut(large.select("node", "comp").join(split, "node"), "parts")
    sizes = placed.groupBy("part", "comp").agg(F.count(F.lit(1)).alias("n"))
    top = sizes.groupBy("part").agg(
        F.count(F.lit(1)).alias("comps"),
        F.max_by("comp", F.struct("n", "comp")).alias("top"),
        F.ceil(F.sum("n") / BLOCK).cast("int").alias("na"),
        F.ceil((F.sum("n") - F.max("n")) / BLOCK).cast("int").alias("nq"),
    )
    top = cut(top.filter("comps > 1").drop("comps"), "top")
    if top.limit(1).count() == 0:
        return None
    placed = placed.join(top, "part").join(large.select("node", "text"), "node").withColumnRenamed("part", "family")
    spread = F.xxhash64("node", F.lit(2))
    every = placed.select(
        "family", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"), F.pmod(spread, "na").cast("int").alias("ab"), "node", "comp", F.lit(False).alias("q"), "text"
    )
    queries = placed.filter("comp <> top").select(
        "family", F.pmod(spread, "nq").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("na") - 1)).alias("ab"), "node", "comp", F.lit(True).alias("q"), "text"
    )
    return every.unionByName(queries)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each input row; see the module's description."""
    texts = id_text(docs, id_col, text_col)
    signed = cut(signatures(texts), "signatures")
    filled = signed.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("node")), "classes")
    placed = filled.join(classes, ["h1", "h2"])
    bands = cut(placed.filter("doc_id = node").select("node", F.explode("bands").alias("key")), "bands")
    # a document whose rows have different texts is a member of several classes and links them
    own = placed.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("a", "b")
    own = cut(own, "own")
    families = components(_stars(bands)).withColumnRenamed("label", "family")
    sizes = cut(families.groupBy("family").agg(F.count(F.lit(1)).alias("n")), "sizes")
    families = families.join(sizes, "family")
    near = texts.filter(bloom(families.select(F.xxhash64("node"))).column(F.xxhash64("doc_id")))  # others pass by the join
    members = cut(near.join(families.hint("merge"), F.col("doc_id") == F.col("node")).select("family", "n", "node", "text"), "members")
    first = cut(_confirmed(_first_round(members)).unionByName(own), "links")
    labels = components(first)
    if sizes.filter(F.col("n") > BLOCK).limit(1).count():
        second = _second_round(members, labels)
        more = None if second is None else cut(_confirmed(second), "links")
        if more is not None and more.limit(1).count():
            labels = components(first.unionByName(more))
    discard(bands, members)
    named = cut(classes.join(labels, "node", "left").select("h1", "h2", F.coalesce("label", "node").alias("component_id")), "named")
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(named, ["h1", "h2"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"))
