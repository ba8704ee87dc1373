"""Repeated runs of lines: a suffix array over line-ID sequences, by distributed prefix doubling.

1. Equal texts are one document, the one with the smallest id; the sequences are those of distinct texts. Each is cut into
   segments of lines that occur more than once, and only segments of MIN_WORDS words or more stay: no repeated run of that
   length leaves its segment. A suffix is what follows a line up to the segment's end.
2. Each line of a segment gets a number in the order of doc_id, text and line, which names its suffix too. Prefix doubling:
   rank k orders all suffixes by their first 2**k lines; rank k + 1 sorts the pairs (rank at i, rank at
   i + 2**k). A rank is the place of a pair in a range-partitioned sort of the distinct pairs, so no task sees all of them
   and a hot line is one row there. It ends when a level tells no more suffixes apart, or at the longest segment.
3. Suffix array. A range-partitioned sort by the last rank, ties by number, puts all suffixes in order.
4. Longest common prefixes of neighbours. Where the lines before both are equal, the prefix is that of the suffixes one
   line earlier, less one line. For all others the two segments are compared from there on, in pieces that grow by GROW, so
   what is shipped for a pair is at most GROW times its prefix and one piece.
5. Intervals. All suffixes that share their first m lines are an interval of the array. The earliest suffix of an interval
   keeps its lines, later ones lose them; so each suffix loses its longest prefix that an earlier one shares, found by a
   stack over the array forwards and backwards, if that has MIN_WORDS words. Each partition of the sort is streamed on its
   own. What it passes to the others is a staircase: for each length, the earliest suffix that shares as many lines with
   the suffix at its edge. A staircase, like the stack, has at most a step for each line of the longest repeated run; the
   driver puts together two for each partition.

All documents that copy an earlier one whole lose all lines, if they have MIN_WORDS words. The earliest copy of every line
stays. Copies may overlap in one document.

Null and empty texts are one empty line and never change. Very long texts are split whole. Rows that repeat a doc_id with
the same text are one document, and each of them gets its result; with different texts they are different documents, in
the order of a hash of the text. A null doc_id comes first in the order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.frames import bloom, cut, discard

#: Fewest words of a repeated run.
MIN_WORDS = 50
FIRST = -(1 << 63)
DOC = ["did", "th"]
#: Lines in the first pieces of two suffixes that are compared, and the factor by which pieces grow.
PIECE, GROW = 16, 8


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with the key (did, th) that orders them; (th, t2) are the 128 bits of the text's MD5."""
    named = docs.withColumn("did", F.coalesce("doc_id", F.lit(FIRST))).withColumn("md5", F.md5(F.col("text").cast("binary")))
    half = [F.conv(F.substring("md5", at, 16), 16, -10).cast("bigint").alias(n) for at, n in ((1, "th"), (17, "t2"))]
    return named.select("*", *half).drop("md5")


def _words(line: Column) -> Column:
    return F.size(F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def _ranked(keys: DataFrame, *by: str) -> DataFrame:
    """Adds `r`, increasing in the sort order of the distinct keys."""
    return cut(keys.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("r", F.monotonically_increasing_id()), "ranks")


def _segments(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of the lines of segments: (pos, did, th, i) and (pos, start, end, c, nw, r, before).

    `pos` numbers the lines in the order of (did, th, i), without gaps in a segment, which lies from `start` to `end`; c is
    the number of words of the segment up to the line, r the line's rank and `before` that of the line before.
    """
    lines = docs.select(*DOC, F.posexplode(F.split("text", "\n")).alias("i", "line"))
    lines = lines.select(*DOC, "i", F.unhex(F.md5(F.col("line").cast("binary"))).alias("key"), _words(F.col("line")).alias("nw"))
    twice = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    again = lines.join(cut(twice, "twice"), "key").repartitionByRange(*DOC)
    doc = Window.partitionBy(*DOC).orderBy("i")
    seg = Window.partitionBy(*DOC, "seg")
    upto = seg.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    parts = again.withColumn("seg", F.col("i") - F.row_number().over(doc))
    parts = parts.withColumns({"all": F.sum("nw").over(seg), "size": F.count(F.lit(1)).over(seg), "at": F.row_number().over(seg.orderBy("i")), "c": F.sum("nw").over(upto)})
    parts = parts.filter(F.col("all") >= min_words).withColumn("pos", F.monotonically_increasing_id())
    parts = parts.withColumns({"start": F.col("pos") - F.col("at") + 1, "end": F.col("pos") - F.col("at") + F.col("size")})
    parts = cut(parts.select("pos", "start", "end", *DOC, "i", "c", "nw", "key"), "segments")
    ranked = parts.select("pos", "start", "end", "c", "nw", "key").join(_ranked(parts.select("key").distinct(), "key"), "key").drop("key")
    level = cut(ranked.withColumn("before", F.lag("r").over(Window.partitionBy("start").orderBy("pos"))), "level")
    return parts.select("pos", "start", *DOC, "i"), level


def _next_rank(level: DataFrame, step: int) -> tuple[DataFrame, int]:
    """The suffixes' ranks by twice as many lines, and the number of different ranks. A suffix may end before."""
    ahead = F.max("r").over(Window.partitionBy("start").orderBy("pos").rangeBetween(step, step))
    pairs = cut(level.select("pos", "start", "end", F.col("r").alias("a"), F.coalesce(ahead, F.lit(-1)).alias("b")), "pairs")
    ranks = _ranked(pairs.select("a", "b").distinct(), "a", "b")
    out = cut(pairs.join(ranks, ["a", "b"]).select("pos", "start", "end", "r"), "level")
    count = ranks.count()
    discard(pairs, ranks)
    return out, count


def _ranks(first: DataFrame) -> DataFrame:
    """(pos, start, end, r): ranks that tell apart all suffixes that differ."""
    level, step = cut(first.select("pos", "start", "end", "r"), "level"), 1
    longest = first.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0] or 0
    count = level.select("r").distinct().count()
    while step < longest:
        more, now = _next_rank(level, step)
        discard(level)
        level = more
        if now == count:
            break
        step, count = 2 * step, now
    return level


def _neighbours(last: DataFrame, first: DataFrame) -> DataFrame:
    """The suffix array in order `o`: each suffix with its left neighbour (x, x_start), whether the lines before both are equal
    (same) and whether the suffixes are (equal)."""
    rows = last.withColumnRenamed("r", "top").join(first.select("pos", "c", "nw", "before"), "pos")
    by = ["top", "pos"]
    ordered = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("o", F.monotonically_increasing_id()), "array")
    own = F.struct("pos", "start", "before", "top")
    part = F.shiftright("o", 33)
    inside = ordered.withColumn("part", part).withColumn("x", F.lag(own).over(Window.partitionBy("part").orderBy("o")))
    edge = ordered.groupBy(part.alias("part")).agg(F.max_by(own, "o").alias("x"))  # a row for each partition of the sort
    edge = edge.select(F.lead("part").over(Window.orderBy("part")).alias("part"), F.col("x").alias("edge")).filter("part is not null")
    met = inside.join(F.broadcast(edge), "part", "left").withColumn("x", F.coalesce("x", "edge"))
    equal, same = (F.coalesce(F.col(n) == F.col(f"x.{n}"), F.lit(False)).alias(m) for n, m in (("top", "equal"), ("before", "same")))
    return cut(met.select("o", "pos", "start", "end", "c", "nw", F.col("x.pos").alias("x"), F.col("x.start").alias("x_start"), same, equal), "neighbours")


def _common(pairs: DataFrame, first: DataFrame) -> DataFrame:
    """(pos, own): how many lines the suffixes of pairs (pos, start, x, x_start) share, by comparing their segments."""
    ids = cut(first.groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "r"))).alias("l")).select("start", F.col("l.r").alias("ids")), "ids")
    now, done, size = pairs.select("pos", "start", "x", "x_start", F.lit(0).alias("own")), None, PIECE
    while True:
        ask = [now.select(F.col(s).alias("start"), F.struct((F.col(p) - F.col(s) + F.col("own") + 1).cast("int").alias("at"), "pos", F.lit(k).alias("side")).alias("q")) for p, s, k in (("pos", "start", 0), ("x", "x_start", 1))]
        asked = ask[0].unionByName(ask[1]).groupBy("start").agg(F.collect_list("q").alias("qs"))  # a line is asked for twice at most
        given = ids.join(asked, "start").select("ids", F.explode("qs").alias("q"))
        pieces = given.select("q.pos", "q.side", F.slice("ids", F.col("q.at"), size).alias("piece"))
        sides = pieces.groupBy("pos").agg(*[F.max(F.when(F.col("side") == k, F.col("piece"))).alias(n) for k, n in ((0, "y"), (1, "z"))])
        differs = F.array_position(F.zip_with("y", "z", lambda a, b: a.eqNullSafe(b)), False)
        more = F.when(differs > 0, differs - 1).otherwise(F.size("y")).cast("int")
        grown = cut(now.join(sides.select("pos", more.alias("more")), "pos").withColumn("own", F.col("own") + F.col("more")), "grown")
        ended = grown.filter(F.col("more") < size).select("pos", "own")
        done = ended if done is None else done.unionByName(ended)
        now, size = grown.filter(F.col("more") == size).drop("more"), size * GROW
        if now.limit(1).count() == 0:
            return done


def _shared(array: DataFrame, first: DataFrame, min_words: int) -> DataFrame:
    """(o, pos, l): the suffix array with the lines that each suffix shares with its left neighbour; 0 where these have too
    few words."""
    own = F.when(F.col("equal"), F.col("end") - F.col("pos") + 1).when(~F.col("same"), F.coalesce("own", F.lit(0)))
    common = _common(array.filter("x is not null and not same and not equal"), first)
    known = array.join(common, "pos", "left").withColumn("stop", own + F.col("pos"))
    # where the lines before both are equal, the common prefix stops where that of the suffixes before stops
    seg = Window.partitionBy("start").orderBy("pos")
    full = known.withColumn("l", F.greatest(F.last("stop", ignorenulls=True).over(seg) - F.col("pos"), F.lit(0)))
    full = full.select("o", "pos", F.col("l").cast("int").alias("l"), (F.col("c") - F.col("nw")).alias("p"))
    ends = first.select(F.col("pos").alias("e"), F.col("c").alias("ce"))
    met = full.withColumn("e", F.when(F.col("l") > 0, F.col("pos") + F.col("l") - 1)).join(ends, "e", "left")
    return cut(met.select("o", "pos", F.when(F.col("ce") - F.col("p") >= min_words, F.col("l")).otherwise(0).alias("l")), "shared")


Step = tuple[int, int]
FAR = 1 << 30


def beyond(near: list[Step], across: int, far: list[Step]) -> list[Step]:
    """The staircase of an edge: its near steps, then those seen from another edge, which shares `across` lines with it.

    Steps (lines shared with the edge, pos) fall in both; a step is the earliest suffix that shares so many lines.
    """
    out = list(near)
    for n, pos in far:
        n = min(n, across)
        if n == 0:
            break
        if not out or pos < out[-1][1]:
            if out and out[-1][0] == n:
                out.pop()
            out.append((n, pos))
    return out


class Stack:
    """Steps from the suffix at hand to one side of the array, the nearest last: (lines shared with it, earliest pos)."""

    def __init__(self, steps: list[Step] = ()) -> None:
        self.entries = list(steps)[::-1]

    def push(self, pos: int, lines: int) -> int:
        """Moves on to the next suffix, which shares `lines` with the one at hand (FAR if the steps are its own already).
        Returns the longest prefix that it shares with an earlier suffix on this side."""
        entries, last = self.entries, None
        while entries and entries[-1][0] >= lines:
            last = entries.pop()
        if last and lines:
            entries.append((lines, last[1]))
        while entries and entries[-1][1] > pos:
            entries.pop()
        out = entries[-1][0] if entries else 0
        entries.append((FAR, pos))
        return out


_EDGES = "part bigint, lines int, across int, right array<struct<n:int,pos:bigint>>, left array<struct<n:int,pos:bigint>>"
_EDGE = pa.list_(pa.struct([("n", pa.int32()), ("pos", pa.int64())]))
_EDGES_SCHEMA = pa.schema([("part", pa.int64()), ("lines", pa.int32()), ("across", pa.int32()), ("right", _EDGE), ("left", _EDGE)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("part", "pos", "l")), strict=True)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part: lines shared across its left edge, the fewest shared within, and the steps of both edges."""
    part, stack, first, across, left = None, Stack(), 0, FAR, []

    def done() -> pa.RecordBatch:
        steps = [[{"n": n, "pos": p} for n, p in x] for x in (stack.entries[::-1], left)]
        return pa.RecordBatch.from_pylist([{"part": part, "lines": first, "across": across, "right": steps[0], "left": steps[1]}], schema=_EDGES_SCHEMA)

    for at, pos, lines in _rows(batches):
        if at != part:
            if part is not None:
                yield done()
            part, stack, first, across, left = at, Stack(), lines, FAR, [(FAR, pos)]
            stack.push(pos, FAR)
        else:
            across = min(across, lines)
            stack.push(pos, lines)
            left = beyond(left, FAR, [(across, pos)] if across else [])
    if part is not None:
        yield done()


def _meet(edges: list[dict]) -> tuple[dict[int, list[Step]], dict[int, list[Step]]]:
    """By part the steps from its first suffix to the left and from its last one to the right, other parts included."""
    to_left: dict[int, list[Step]] = {}
    to_right: dict[int, list[Step]] = {}
    for a, b in zip(edges, edges[1:], strict=False):
        to_left[b["part"]] = beyond(beyond([], b["lines"], a["right"]), min(b["lines"], a["across"]), to_left.get(a["part"], []))
    for b, a in zip(edges[:0:-1], edges[-2::-1], strict=False):
        to_right[a["part"]] = beyond(beyond([], b["lines"], b["left"]), min(b["lines"], b["across"]), to_right.get(b["part"], []))
    return to_left, to_right


_LATER = pa.schema([("pos", pa.int64()), ("m", pa.int32())])


def _earlier(steps: dict[int, list[Step]], backwards: bool):  # noqa: ANN202
    """(pos, m) of suffixes that share m lines with an earlier one on one side; rows come part by part, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack, carried = None, Stack(), 0
        for batch in batches:
            out = []
            for at, pos, lines in _rows([batch]):
                shared = carried if backwards else lines
                if at != part:
                    part, stack, shared = at, Stack(steps.get(at, [])), FAR
                m = stack.push(pos, shared)
                carried = lines
                if m:
                    out.append((pos, m))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _LATER, strict=True)], schema=_LATER)

    return run


def _later(shared: DataFrame) -> DataFrame:
    """(pos, m): the first m lines of the suffix at pos occur earlier; of each interval but for its earliest suffix."""
    dealt = shared.withColumn("part", F.shiftright("o", 33)).repartition("part")
    forwards = dealt.sortWithinPartitions("part", "o")
    edges = [r.asDict(recursive=True) for r in forwards.mapInArrow(_edges, _EDGES).orderBy("part").collect()]  # a row for each partition
    for e in edges:
        for side in ("right", "left"):
            e[side] = [(x["n"], x["pos"]) for x in e[side]]
    to_left, to_right = _meet(edges)
    one = forwards.mapInArrow(_earlier(to_left, False), "pos bigint, m int")
    other = dealt.sortWithinPartitions("part", F.desc("o")).mapInArrow(_earlier(to_right, True), "pos bigint, m int")
    return one.unionByName(other).groupBy("pos").agg(F.max("m").alias("m"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(did, th, gone): for each document that loses lines, their sorted numbers. `docs` are distinct texts (did, th, text)."""
    places, first = _segments(docs, min_words)
    last = _ranks(first)
    array = _neighbours(last, first)
    shared = _shared(array, first, min_words)
    discard(array, last)
    reach = F.max(F.col("pos") + F.col("m")).over(Window.partitionBy("start").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    lines = places.join(_later(shared), "pos", "left").withColumn("reach", reach).filter("reach > pos")
    return lines.groupBy(*DOC).agg(F.array_sort(F.collect_list("i")).alias("gone"))


def _mask(gone: Column) -> Column:
    """True at the given sorted places of an array that ends at the last of them."""
    gaps = F.transform(gone, lambda g, k: g - F.coalesce(F.get(gone, k - 1), F.lit(-1)) - 1)
    return F.flatten(F.transform(gaps, lambda n: F.concat(F.array_repeat(F.lit(False), n), F.array(F.lit(True)))))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, further columns to keep, n_lines, n_removed, text for each input row: the text without later copies of
    repeated runs."""
    keep = keep or []
    own = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    keyed = _keyed(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *own))
    named = keyed.groupBy("th", "t2").agg(F.min("did").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = cut(named.select("th", "t2", "first"), "copies")
    copied = bloom(copies.select("th")).column(F.col("th"))
    one = keyed.filter(copied).groupBy("th", "t2").agg(F.min("did").alias("did"), F.first("text").alias("text"))
    gone = repeated_lines(keyed.filter(~copied).select(*DOC, "text").unionByName(one.select(*DOC, "text")), min_words)
    gone = cut(gone.select(*DOC, F.size("gone").alias("n_removed"), _mask(F.col("gone")).alias("mask")), "gone")
    # only documents that change meet the table of what they lose; all others pass by
    whole = keyed.filter(copied).filter(_words(F.col("text")) >= min_words).select(*DOC, "t2").distinct().join(copies, ["th", "t2"]).filter("did > first")
    fate = cut(gone.withColumn("whole", F.lit(False)).unionByName(whole.select(*DOC, F.lit(0).alias("n_removed"), F.lit(None).cast("array<boolean>").alias("mask"), F.lit(True).alias("whole"))), "fate")
    changed = bloom(fate.select(F.xxhash64(*DOC))).column(F.xxhash64(*DOC))
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.coalesce(F.get("mask", i), F.lit(False))), "\n")
    met = keyed.filter(changed).join(fate, DOC, "left")
    kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(keep)]
    met = met.select(
        "doc_id", *kept, F.size(lines).alias("n_lines"), F.when(F.col("whole"), F.size(lines)).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("whole"), F.lit("")).when(F.col("mask").isNull(), F.col("text")).otherwise(left).alias("text"),
    )
    return keyed.filter(~changed).select("doc_id", *kept, F.size(lines).alias("n_lines"), F.lit(0).alias("n_removed"), "text").unionByName(met)
