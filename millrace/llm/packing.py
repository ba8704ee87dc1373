"""Packing documents into token sequences with a grouping genetic algorithm.

Tokens: a document's ids, as the plain tokenizer gives them (strings of its special tokens become those tokens), and one
end id. Documents longer than a sequence are cut into sequences and a rest. Pieces of full length are sequences of their
own; the others are dealt by a hash of their row to blocks of about BLOCK pieces, so copies never meet in one block.

Each block is a packing problem that ISLANDS islands solve apart, from populations of random packings. A chromosome is a
list of bins. The crossover copies whole well-filled bins of one parent into the other, removes the other's bins that hold
copies of the same pieces or are not filled, and puts the displaced pieces back by best fit, largest first. Mutation
dissolves the bins that are not filled and some others and puts their pieces back in the same way. Fewer bins win, then the larger mean squared fill. An epoch
is GENERATIONS generations at most; after it each island's elite, its best packing, migrates to the next island of the
block's ring, where it takes the place of the worst. Epochs go on in blocks above their lower bound, as long as one of
them gets better.

Of a block's best packing the bins that are filled up to SLACK settle. The pieces of all other bins are dealt to the fewer
blocks of the next round. Where a round fills less than a part in PROGRESS of its pieces into such bins (pieces that fill
no sequence together), all bins but the emptiest of each block settle. Rounds end when one block is left, or when there
would not be fewer blocks; then all bins settle. A task holds one block at a time.

Null and empty texts are the end id alone. Rows that repeat an id are packed each. Very long texts give many pieces. Equal
lengths are interchangeable: which of them shares a sequence is not defined. An empty table gives no rows.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import cut, id_text, map_slices
from millrace.llm.words import words_of

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
END = 1
#: Pieces of a block, and islands that work on it.
BLOCK = 4096
ISLANDS = 2
POPULATION = 6
GENERATIONS = 10
PATIENCE = 3
#: Least and largest share of a donor's filled bins that a crossover injects, and of filled bins that a mutation leaves.
GIFT, STAY = (0.3, 0.9), (0.5, 1.0)
#: Free places up to which a bin counts as filled.
SLACK = 4
PROGRESS = 8
#: Tasks of an epoch, at most.
MOST_TASKS = 4096
#: Words of up to LONG bytes that a Python worker remembers, their ids (at most), and parts of words.
REMEMBER, LONG = 500_000, 64
MOST_IDS, PARTS = 4_000_000, 30_000
#: Texts are encoded in slices of about so many bytes: a slice's arrays take some forty times that.
SLICE = 500_000

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

#: Fixed values of the vocabulary's pre-tokenizer.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Kinds of bytes: 1 for letters of ASCII, 2 for its other signs but the apostrophe, 0 for all else.
_KIND = np.zeros(256, np.uint8)
_KIND[33:128] = _KIND[:9] = _KIND[14:32] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 0


def _breaks(data: np.ndarray) -> np.ndarray:
    """Bytes before which the pre-tokenizer always parts a word: between a letter of ASCII or Latin-1 and a sign of ASCII.
    None of its tokens but those that start with an apostrophe has both, and normalising joins nothing there."""
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of times and division
    kind[lead] = kind[lead + 1] = 1
    out = np.zeros(data.size, bool)
    np.equal(kind[1:] + kind[:-1], 3, out=out[1:])
    return out


class WordTokenizer:
    """Ids of the texts of a slice, from a memory of words.

    The pre-tokenizer never joins characters across white space, nor letters of ASCII or Latin-1 and signs of ASCII but the
    apostrophe; a text's ids are those of the words between, one after the other. The distinct words of a slice (by 64-bit
    hash, A-Z lower-cased) are normalised and split as the tokenizer does it, and its model encodes each new one once; the
    ids of all words are then gathered as arrays. Texts with U+001C to U+001F, which Python takes for white space and the
    tokenizer does not, and texts that may hold a special token go through the tokenizer itself.

    The memory is three arrays (sorted hashes, where each word's ids start, how many) and the ids: some 30 bytes a word, of
    bounded size. When it is full, the words of the slice at hand stay.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.tokenize = self.whole.model.tokenize
        added = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.odd = re.compile(b"|".join([rb"[\x1c-\x1f]", *map(re.escape, added)]), re.IGNORECASE)
        self.odd_start = np.zeros(256, bool)  # first bytes of what is odd
        self.odd_start[[*range(0x1C, 0x20), *(b for t in added for b in (t[:1].lower() + t[:1].upper()))]] = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.byte_level = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.short = lru_cache(PARTS)(self._encoded)
        self.hashes, self.ids_of = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.at, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _encoded(self, part: str) -> list[int]:
        spelt = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.byte_level)
        return [t.id for t in self.tokenize(spelt)]

    def _part(self, part: str) -> list[int]:
        return self.short(part) if len(part) <= LONG else self._encoded(part)

    def _word(self, word: bytes) -> list[int]:
        text = word.decode()
        if word.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in text]) if "\u03a3" in text else text.lower()  # a final sigma is like any other
            if len(chunks := text.split()) > 1:
                return [i for chunk in chunks for part in _SPLIT.findall(chunk) for i in self._part(part)]
        if text.isalpha():
            return self._encoded(text)  # remembered as a word
        return [i for part in _SPLIT.findall(text) for i in self._part(part)]

    def _remember(self, hashes: np.ndarray, at: np.ndarray, sizes: np.ndarray, pool: np.ndarray, new: np.ndarray, short: np.ndarray) -> None:
        """Adds the short new words of a slice; `at` and `sizes` give the ids of all its words in the pool."""
        add = new & short
        n = int(sizes[add].sum())
        if self.hashes.size + np.count_nonzero(add) > REMEMBER or self.ids_of.size + n > MOST_IDS:
            self.hashes, self.ids_of = self.hashes[:0], self.ids_of[:0]
            self.at, self.sizes = self.at[:0], self.sizes[:0]
            add = short & (np.cumsum(short) <= REMEMBER) & (np.cumsum(sizes * short) <= MOST_IDS)
        hashes, at, sizes = hashes[add], at[add], sizes[add]
        ends = np.cumsum(sizes, dtype=np.int64)
        own = pool[np.repeat(at - ends + sizes, sizes) + np.arange(sizes.sum())]
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")  # merges two sorted runs
        self.hashes = every[order]
        self.at = np.concatenate([self.at, self.ids_of.size + ends - sizes])[order]
        self.sizes = np.concatenate([self.sizes, sizes])[order]
        self.ids_of = np.concatenate([self.ids_of, own])

    def ids(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        w = words_of(column, _breaks)
        raw = w.data.tobytes()
        hashes, one, back = np.unique(w.hashes, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, hashes)
        known = np.append(self.hashes, np.uint64(0))[place] == hashes
        known &= place < self.hashes.size
        new = one[~known]
        own = [self._word(raw[s:e]) for s, e in zip(w.starts[new].tolist(), w.ends[new].tolist(), strict=True)]
        n_own = np.fromiter(map(len, own), np.int32, len(own))
        pool = np.concatenate([self.ids_of, np.fromiter(chain.from_iterable(own), "<u4", int(n_own.sum()))])
        at, sizes = np.zeros(hashes.size, np.int64), np.zeros(hashes.size, np.int32)
        at[known], sizes[known] = self.at[place[known]], self.sizes[place[known]]
        sizes[~known] = n_own
        at[~known] = self.ids_of.size + np.cumsum(sizes[~known], dtype=np.int64) - sizes[~known]
        self._remember(hashes, at, sizes, pool, ~known, w.ends[one] - w.starts[one] <= LONG)
        counts = sizes[back]
        ends = np.append(0, np.cumsum(counts))
        every = pool[np.repeat(at[back] - ends[:-1], counts) + np.arange(ends[-1])]
        bounds = ends[w.first]
        out = [every[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        at = np.flatnonzero(self.odd_start[w.data])
        if at.size:
            for k in np.unique(np.searchsorted(w.offsets, at, "right") - 1).tolist():
                a, b = int(w.offsets[k]), int(w.offsets[k + 1])
                if self.odd.search(raw, a, b):
                    out[k] = np.array(self.whole.encode(raw[a:b].decode(), add_special_tokens=False).ids, "<u4")
        return out


@cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each document: number, start, length and CRC-32 of its ids."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, ids in zip(part.column("doc_id").to_pylist(), _tokenizer(path).ids(part.column("text")), strict=True):
            ids = np.append(ids, np.array([END], "<u4"))
            for k, at in enumerate(range(0, ids.size, length)):
                own = ids[at : at + length]
                rows.append((key, k, at, own.size, zlib.crc32(own.tobytes())))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return map_slices(id_text(docs, id_col, text_col), run, PIECES, SLICE)


Bins = list[list[int]]


def best_fit(items: list[int], sizes: list[int], bins: Bins, length: int) -> Bins:
    """Adds each item to the bin that it fills best, or to a new one. The bins are changed."""
    free: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0
    for k, b in enumerate(bins):
        room = length - sum(sizes[i] for i in b)
        free[room].append(k)
        mask |= 1 << room
    for i in items:
        need = sizes[i]
        fitting = mask >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            k = free[room].pop()
            if not free[room]:
                mask ^= 1 << room
            bins[k].append(i)
        else:
            room, k = length, len(bins)
            bins.append([i])
        rest = room - need
        if not free[rest]:
            mask |= 1 << rest
        free[rest].append(k)
    return bins


def _fills(bins: Bins, sizes: list[int]) -> list[int]:
    return [sum([sizes[i] for i in b]) for b in bins]


@dataclass
class Packing:
    """A chromosome: bins and their fills. Fewer bins come first, then the larger sum of squared fills."""

    bins: Bins
    fills: list[int]

    @classmethod
    def of(cls, bins: Bins, sizes: list[int]) -> Packing:
        return cls(bins, _fills(bins, sizes))

    def __post_init__(self) -> None:
        self.worth = (len(self.bins), -sum([f * f for f in self.fills]))

    def filled(self, length: int) -> Bins:
        return [b for b, f in zip(self.bins, self.fills, strict=True) if f >= length - SLACK]


def _least(sizes: list[int], length: int) -> int:
    """No packing has fewer bins."""
    return max(-(-sum(sizes) // length), sum(2 * s > length for s in sizes))


def _repaired(kept: Bins, sizes: list[int], length: int) -> Packing:
    """The bins to keep, and all other pieces put back by best fit, largest first. `sizes` descend."""
    displaced = [True] * len(sizes)
    for b in kept:
        for i in b:
            displaced[i] = False
    return Packing.of(best_fit([i for i, d in enumerate(displaced) if d], sizes, [list(b) for b in kept], length), sizes)


def crossover(base: Packing, donor: Packing, sizes: list[int], length: int, chance: random.Random) -> Packing:
    """Injects some of the donor's well-filled bins into the base. Base bins that hold copies of their pieces, and those
    that are not filled, lose their pieces, which best fit puts back."""
    gift = donor.filled(length)
    if not gift:  # then the fullest quarter
        order = sorted(range(len(donor.bins)), key=lambda k: -donor.fills[k])
        gift = [donor.bins[k] for k in order[: max(1, len(order) // 4)]]
    gift = chance.sample(gift, max(1, int(len(gift) * chance.uniform(*GIFT))))
    given = {i for b in gift for i in b}
    return _repaired(gift + [b for b in base.filled(length) if given.isdisjoint(b)], sizes, length)


def mutate(base: Packing, sizes: list[int], length: int, chance: random.Random) -> Packing:
    """Dissolves the bins that are not filled and some others; best fit puts their pieces back."""
    filled = base.filled(length)
    return _repaired(chance.sample(filled, int(len(filled) * chance.uniform(*STAY))), sizes, length)


def evolve(sizes: list[int], length: int = LENGTH, seed: int = 0, population: list[Bins] | None = None) -> tuple[list[Bins], int]:
    """One epoch of an island: its population, the best packing first, and the number of crossovers.

    `sizes` descend. Without a population it starts from random ones. It ends early when as few bins as possible are left
    and the best packing has not got better for PATIENCE generations. Deterministic for given sizes, population and seed.
    """
    chance = random.Random(seed)
    bound, crossovers, idle = _least(sizes, length), 0, 0
    if not population:
        every = range(len(sizes))
        population = [best_fit(chance.sample(every, len(sizes)), sizes, [], length) for _ in range(POPULATION)]
    ranked = sorted((Packing.of(b, sizes) for b in population), key=lambda x: x.worth)
    for _ in range(GENERATIONS):
        best, other = ranked[0], ranked[chance.randrange(1, len(ranked))] if len(ranked) > 1 else ranked[0]
        children = [crossover(best, other, sizes, length, chance), crossover(other, best, sizes, length, chance), mutate(best, sizes, length, chance)]
        crossovers += 2
        ranked = sorted(ranked + children, key=lambda x: x.worth)[:POPULATION]
        idle = idle + 1 if ranked[0].worth == best.worth else 0
        if ranked[0].worth[0] <= bound and idle >= PATIENCE:
            break
    return [x.bins for x in ranked], crossovers


#: An island's state. `rids` and `sizes` are its block's pieces; a packing has the bin of each piece; the best comes first.
ISLAND = "block int, island int, rids array<bigint>, sizes array<int>, packings array<array<int>>, bins int, bound int, squares bigint, crossovers bigint"


def _bins(packing: np.ndarray) -> Bins:
    out: Bins = [[] for _ in range(int(max(packing)) + 1)]
    for i, k in enumerate(packing):
        out[int(k)].append(i)
    return out


def _packing(bins: Bins, n: int) -> list[int]:
    out = [0] * n
    for k, b in enumerate(bins):
        for i in b:
            out[i] = k
    return out


def _epoch(islands: DataFrame, count: int, epoch: int, length: int) -> DataFrame:
    """Evolves each island (a row) by an epoch; `guest` is the elite that migrates to it, null in the first epoch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                sizes = [int(s) for s in r["sizes"]]
                population = None
                if r["guest"] is not None:
                    population = [_bins(p) for p in r["packings"]][: POPULATION - 1] + [_bins(r["guest"])]
                population, crossovers = evolve(sizes, length, (int(r["block"]) * ISLANDS + int(r["island"])) * 1009 + epoch, population)
                bins, squares = Packing.of(population[0], sizes).worth
                row = {k: r[k] for k in ("block", "island", "rids", "sizes")}
                row |= {"packings": [_packing(b, len(sizes)) for b in population], "bins": bins, "bound": _least(sizes, length)}
                yield pd.DataFrame([row | {"squares": -squares, "crossovers": int(r["crossovers"]) + crossovers}])

    return islands.repartition(max(1, min(count, MOST_TASKS)), "block", "island").mapInPandas(run, ISLAND)


def _ring(state: DataFrame) -> DataFrame:
    """Each island with the elite of the one before it in its block's ring."""
    elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("packings")[0].alias("guest"))
    return state.join(elite, ["block", "island"])


def _solved(waiting: DataFrame, blocks: int, number: int, length: int, report: list[dict] | None) -> DataFrame:
    """The best island of each block, after as many epochs as make some block better; (block, rids, sizes, packing)."""
    dealt = waiting.select(F.pmod(F.xxhash64("rid", F.lit(number)), F.lit(blocks)).cast("int").alias("block"), "rid", F.col("length").cast("int").alias("length"))
    problems = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "rid")), asc=False).alias("p"))
    none = F.lit(None)
    state = problems.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.col("p.rid").alias("rids"), F.col("p.length").alias("sizes"),
        none.cast("array<array<int>>").alias("packings"), F.lit(0).cast("bigint").alias("crossovers"), none.cast("array<int>").alias("guest"),
    )
    out, epoch, before, count = None, 0, None, blocks
    best = F.min_by(F.struct("rids", "sizes", F.col("packings")[0].alias("packing")), F.struct("bins", -F.col("squares"), "island")).alias("b")
    while True:
        state = cut(_epoch(state, count * ISLANDS, epoch, length), "islands")
        per_block = cut(state.groupBy("block").agg(*[f(c).alias(c) for f, c in ((F.min, "bins"), (F.max, "bound"), (F.sum, "crossovers"))]), "blocks")
        open_blocks = per_block.filter("bins > bound")
        sums = per_block.agg(*[F.sum(c).alias(c) for c in ("bins", "bound", "crossovers")], F.sum(F.when(F.col("bins") > F.col("bound"), F.col("bins"))).alias("open_bins"), F.count_if(F.col("bins") > F.col("bound")).alias("open")).first()
        if report is not None:
            report.append({"round": number, "epoch": epoch, "blocks": count, **sums.asDict()})
        last = not sums["open"] or (before is not None and sums["bins"] >= before)
        solved = state if last else state.join(open_blocks.select("block"), "block", "left_anti")
        solved = solved.groupBy("block").agg(best).select("block", "b.*")
        out = solved if out is None else out.unionByName(solved)
        if last:
            return out
        state = _ring(state.join(open_blocks.select("block"), "block", "left_semi"))
        before, count, epoch = sums["open_bins"], sums["open"], epoch + 1


PLACED = "rid bigint, sequence_id bigint, offset bigint, filled boolean, emptiest boolean"


def _placed(solved: DataFrame, number: int, length: int) -> DataFrame:
    """A row for each piece: its sequence, its place there, and whether that is filled or the emptiest of its block."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                bin_of, sizes = np.asarray(r["packing"], np.int64), np.asarray(r["sizes"], np.int64)
                order = np.argsort(bin_of, kind="stable")
                before = np.cumsum(sizes[order]) - sizes[order]
                first = np.searchsorted(bin_of[order], bin_of[order])
                fill = np.bincount(bin_of, sizes)
                yield pd.DataFrame(
                    {
                        "rid": np.asarray(r["rids"], np.int64)[order],
                        "sequence_id": (number << 56) | (int(r["block"]) << 24) | bin_of[order],
                        "offset": before - before[first],
                        "filled": fill[bin_of[order]] >= length - SLACK,
                        "emptiest": bin_of[order] == fill.argmin(),
                    }
                )

    return solved.select("block", "rids", "sizes", "packing").mapInPandas(run, PLACED)


def pack(table: DataFrame, length: int = LENGTH, block: int | None = None, report: list[dict] | None = None) -> DataFrame:
    """Adds sequence_id and offset to pieces. `report` gets a dict for each epoch: bins, lower bound, crossovers so far."""
    columns = table.columns
    table = cut(table.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    alone = table.filter(F.col("length") >= length).withColumn("sequence_id", -1 - F.col("rid")).withColumn("offset", F.lit(0).cast("bigint"))
    out, waiting, number = alone.select(*columns, "sequence_id", "offset"), table.filter(F.col("length") < length).select("rid", "length"), 1
    count = waiting.count()
    while count:
        blocks = -(-count // (block or BLOCK))
        done = cut(_placed(_solved(waiting, blocks, number, length, report), number, length), "placed")
        going = ~F.col("filled")
        left = done.filter(going).count()
        if count - left < count // PROGRESS:
            going = F.col("emptiest")
            left = done.filter(going).count()
        if -(-left // (block or BLOCK)) >= blocks or blocks == 1:
            going, left = F.lit(False), 0
        final = done.filter(~going).select("rid", "sequence_id", "offset")
        out = out.unionByName(table.join(final, "rid").select(*columns, "sequence_id", "offset"))
        if left:
            waiting = table.join(done.filter(going).select("rid"), "rid").select("rid", "length")
        count, number = left, number + 1
    return out


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document."""
    return pack(pieces(docs, path or public_tokenizers.path(VOCABULARY), length, id_col, text_col), length)
