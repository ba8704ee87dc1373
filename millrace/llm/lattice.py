"""Language-model scores from a subword lattice.

The vocabulary is an existing one: pieces with scores, of which some begin a word, 256 spell single bytes and one ends a
text. A text is its words, each behind the word mark, and the end. Its lattice holds every segmentation into pieces;
characters without a piece of their own are spelt in bytes. The forward recursion in log space sums over all
segmentations and gives the text's marginal probability. No piece has the word mark inside, so the lattice of a text is the
chain of its words' lattices, and a word's lattice is computed once, however often it occurs.

Two sets of piece weights give two scores. `vocabulary_score` takes the vocabulary's scores as they are; the file at hand
gives merge ranks, and rank r gets the weight 1 / (r + 3). `score` learns from the training texts: ROUNDS rounds of
expectation maximisation (forward-backward over all segmentations of all training words, weighted by their counts) begin
at the vocabulary's weights, which also stay as a prior of PRIOR times the training tokens. Nothing but pieces is an arc.

Counting, fitting and scoring are one pass each over texts, words and words. Scores reach the texts through a table of
the TOP most frequent words (a fixed bound) that each task holds; all other words of a text are joined by hash.

Null and empty texts are the end alone. Very long texts are scored whole; words over LONG characters are worked on one at
a time. Rows that repeat an id are scored each. A null doc_id is held out. Without any training text N is 0; base_score
then takes c = V = 0, and score is null. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import cut, held_out, id_text, slices
from millrace.llm.words import words_of

VOCABULARY = "piece_bpe_32k.model"
FOLDS, FOLD = 5, 1
ROUNDS = 3
#: Weight of the vocabulary's scores when pieces are counted, as a share of the training tokens.
PRIOR = 0.01
TOP = 1 << 17
SLOT_BITS = 20
#: Longer words are worked on one at a time.
LONG = 48
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Vocabulary:
    """Pieces by hash, with the weights of their scores; `byte` holds the ids of the 256 byte pieces, `end` that of the end."""

    pieces: list[str]
    prior: np.ndarray
    byte: np.ndarray
    keys: np.ndarray
    ids: np.ndarray
    maybe: np.ndarray
    by_text: dict[str, int]
    longest: int
    end: int


def _hash_text(text: str) -> int:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for ch in text:
            h = h * _BASE + np.uint64(ord(ch) + 1)
    return int(h)


@cache
def vocabulary(path: str) -> Vocabulary:
    """Reads a sentencepiece model. Scores of a BPE model are minus the merge rank; rank r gets the weight 1 / (r + 3)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    byte, weight, by_text = np.zeros(256, np.int64), np.zeros(n), {}
    for i, p in enumerate(pieces):
        if model.is_byte(i):
            byte[int(p[3:5], 16)] = i
            weight[i] = 1 / (n + 3)
        elif not (model.is_control(i) or model.is_unknown(i)):
            by_text[p] = i
            weight[i] = 1 / (3 - model.get_score(i))
        elif i == model.eos_id():
            weight[i] = 1 / 3  # a score of 0, like the first rank's
    hashes = sorted((_hash_text(p), i) for p, i in by_text.items())
    keys = np.array([h for h, _ in hashes], np.uint64)
    maybe = np.zeros(1 << 22, bool)
    maybe[(keys * _SPREAD) >> np.uint64(42)] = True
    return Vocabulary(pieces, weight / weight.sum(), byte, keys, np.array([i for _, i in hashes]), maybe, by_text, max(map(len, by_text)), model.eos_id())


def _edges(vocab: Vocabulary, chars: np.ndarray) -> tuple[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], list[tuple[int, np.ndarray]]]:
    """Of words of one length as code points (words, L): {(start, end): (word rows, piece ids)}, and by place the rows
    whose character there has no piece."""
    _, length = chars.shape
    arcs, unknown = {}, []
    for i in range(length):
        h = np.zeros(chars.shape[0], np.uint64)
        for end in range(i + 1, min(length, i + vocab.longest) + 1):
            h = h * _BASE + (chars[:, end - 1] + np.uint64(1))
            rows = np.flatnonzero(vocab.maybe[(h * _SPREAD) >> np.uint64(42)])
            at = np.searchsorted(vocab.keys, h[rows])
            at[at == vocab.keys.size] = 0
            hit = vocab.keys[at] == h[rows]
            rows, ids = rows[hit], vocab.ids[at[hit]]
            if end == i + 1 and rows.size < chars.shape[0]:
                missing = np.ones(chars.shape[0], bool)
                missing[rows] = False
                unknown.append((i, np.flatnonzero(missing)))
            if rows.size:
                arcs[(i, end)] = (rows, ids)
    return arcs, unknown


def _spelling(vocab: Vocabulary, code: int) -> np.ndarray:
    return vocab.byte[list(chr(code).encode("utf-8", "surrogatepass"))]


class Lattice:
    """All segmentations of words of one length, given as code points (words, L)."""

    def __init__(self, vocab: Vocabulary, chars: np.ndarray) -> None:
        self.vocab, (self.n, self.length) = vocab, chars.shape
        self.arcs, unknown = _edges(vocab, chars)
        self.spelt = {}
        for i, rows in unknown:
            codes, back = np.unique(chars[rows, i].astype(np.int64), return_inverse=True)
            self.spelt[i] = (rows, [_spelling(vocab, c) for c in codes], back)

    def _spelt(self, i: int, logp: np.ndarray) -> np.ndarray:
        _, spellings, back = self.spelt[i]
        return np.array([logp[x].sum() for x in spellings])[back]

    def forward(self, logp: np.ndarray) -> np.ndarray:
        """Log sums over all segmentations of the first 0, 1, ... characters (L + 1, words); the last row is the marginal."""
        alpha = np.full((self.length + 1, self.n), -np.inf)
        alpha[0] = 0.0
        with np.errstate(invalid="ignore"):
            for end in range(1, self.length + 1):
                for i in range(max(0, end - self.vocab.longest), end):
                    if (i, end) in self.arcs:
                        rows, ids = self.arcs[(i, end)]
                        alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[i, rows] + logp[ids])
                if end - 1 in self.spelt:
                    rows = self.spelt[end - 1][0]
                    alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - 1, rows] + self._spelt(end - 1, logp))
        return alpha

    def uses(self, logp: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over all segmentations of the words, by their weights."""
        alpha = self.forward(logp)
        total = alpha[self.length]
        beta = np.full((self.length + 1, self.n), -np.inf)
        beta[self.length] = 0.0
        used = np.zeros(logp.size)
        with np.errstate(invalid="ignore"):
            for i in range(self.length - 1, -1, -1):
                for end in range(i + 1, min(self.length, i + self.vocab.longest) + 1):
                    if (i, end) in self.arcs:
                        rows, ids = self.arcs[(i, end)]
                        tail = beta[end, rows] + logp[ids]
                        beta[i, rows] = np.logaddexp(beta[i, rows], tail)
                        used += np.bincount(ids, np.exp(alpha[i, rows] + tail - total[rows]) * weights[rows], logp.size)
                if i in self.spelt:
                    rows, spellings, back = self.spelt[i]
                    tail = beta[i + 1, rows] + self._spelt(i, logp)
                    beta[i, rows] = np.logaddexp(beta[i, rows], tail)
                    share = np.bincount(back, np.exp(alpha[i, rows] + tail - total[rows]) * weights[rows], len(spellings))
                    for pieces, x in zip(spellings, share.tolist(), strict=True):
                        np.add.at(used, pieces, x)
        return used


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points with the word mark) of words of equal length, in groups of bounded size."""
    rows = defaultdict(list)
    for k, w in enumerate(words):
        rows[len(w)].append(k)
    for length, ks in rows.items():
        step = max(1, 200_000 // (length + 1)) if length <= LONG else 1
        for at in range(0, len(ks), step):
            own = ks[at : at + step]
            raw = "".join(MARK + words[k] for k in own).encode("utf-32-le", "surrogatepass")
            yield np.array(own), np.frombuffer(raw, np.uint32).reshape(len(own), length + 1).astype(np.uint64)


def marginals(vocab: Vocabulary, logps: list[np.ndarray], words: list[str]) -> np.ndarray:
    """Log marginals (words, weightings)."""
    out = np.zeros((len(words), len(logps)))
    for rows, chars in _by_length(words):
        own = Lattice(vocab, chars)
        for k, logp in enumerate(logps):
            out[rows, k] = own.forward(logp)[-1]
    return out


def _count(docs: DataFrame) -> DataFrame:
    """(word, c): every distinct word of all texts with its count in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                w = words_of(piece.column("text"))
                if w.hashes.size:
                    train = np.repeat(~piece.column("held_out").to_numpy(zero_copy_only=False).astype(bool), np.diff(w.first))
                    _, at, back = np.unique(w.hashes, return_index=True, return_inverse=True)
                    raw = w.data.tobytes()
                    words = [raw[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
                    lower = pa.compute.ascii_lower(pa.array(words, pa.binary()).cast(pa.string()))
                    yield pa.record_batch([lower, pa.array(np.bincount(back[train], minlength=at.size))], ["word", "c"])

    return docs.mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def _logs(weights: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(weights / weights.sum())


def _fit(words: DataFrame, path: str, logp: np.ndarray, texts: int, tokens: int) -> np.ndarray:
    """One round of expectation maximisation over the training words. Gathers one number for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, used = vocabulary(path), np.zeros(logp.size)
        for batch in batches:
            counts = batch.column("c").to_numpy().astype(float)
            for rows, chars in _by_length(batch.column("word").to_pylist()):
                used += Lattice(vocab, chars).uses(logp, counts[rows])
        at = np.flatnonzero(used)
        yield pa.record_batch([pa.array(at), pa.array(used[at])], ["piece", "used"])

    vocab = vocabulary(path)
    got = words.filter("c > 0").mapInArrow(run, "piece bigint, used double").groupBy("piece").agg(F.sum("used").alias("used")).toPandas()
    counts = PRIOR * tokens * vocab.prior
    counts[got["piece"].to_numpy(int)] += got["used"].to_numpy(float)
    counts[vocab.end] += texts
    return _logs(counts)


def _scored(words: DataFrame, path: str, logps: list[np.ndarray], n: int, v: int) -> DataFrame:
    """(h, c, base, s0, s1) of each distinct word: its count, base term and log10 marginal under each weighting."""
    names = [f"s{k}" for k in range(len(logps))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            c = batch.column("c").to_numpy()
            scores = marginals(vocab, logps, batch.column("word").to_pylist()) / np.log(10)
            base = np.log10((c + 0.5) / (n + 0.5 * (v + 1)))
            hashes = words_of(batch.column("word")).hashes
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(c), pa.array(base), *map(pa.array, scores.T)], ["h", "c", "base", *names])

    return words.mapInArrow(run, "h bigint, c bigint, base double, " + ", ".join(f"{x} double" for x in names))


class _Slots:
    """Values of the most frequent words behind two direct-mapped tables; the more frequent word wins a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.keys = np.append(keys, np.uint64(0))
        self.values = np.vstack([values, np.zeros(values.shape[1])])
        self.tables = []
        rest = np.arange(keys.size)[::-1]  # ascending frequency: later writes win
        for shift in (0, 32):
            slot = np.full(1 << SLOT_BITS, keys.size, np.int32)
            at = (keys[rest] >> np.uint64(shift)) & np.uint64((1 << SLOT_BITS) - 1)
            slot[at] = rest
            self.tables.append((np.uint64(shift), slot))
            rest = rest[slot[at] != rest]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Row of each hash, or the last row where it is not held."""
        none = self.keys.size - 1
        out = np.full(hashes.size, none, np.int32)
        for shift, slot in self.tables:
            row = slot[(hashes >> shift) & np.uint64((1 << SLOT_BITS) - 1)]
            hit = (self.keys[row] == hashes) & (row != none)
            out[hit] = row[hit]
        return out


def _parts(docs: DataFrame, slots: _Slots, ends: list[float], end_known: bool) -> DataFrame:
    """A row for each text with the sums over the words that tasks hold and the end, and a row for each other word of it.

    `ends` has the end's base term and its log10 weight under each weighting, in the order of the slots' values.
    """
    sums = ["base_score", *(f"s{k}" for k in range(len(ends) - 1))]
    fields = [("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("h", pa.int64()), ("tf", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64())]
    schema = pa.schema(fields + [(x, pa.float64()) for x in sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for piece in slices(batch):
                w, count = words_of(piece.column("text")), piece.num_rows
                sizes = np.diff(w.first)
                doc = np.repeat(np.arange(count), sizes)
                at = slots.find(w.hashes)
                known = np.rint(np.bincount(doc, slots.values[at, 0], count)).astype(np.int64) + int(end_known)
                totals = [pa.array(np.bincount(doc, slots.values[at, k + 1], count) + e) for k, e in enumerate(ends)]
                none = pa.nulls(count, pa.int64())
                head = [pa.array(row + np.arange(count)), piece.column("doc_id"), piece.column("held_out"), none, none]
                yield pa.RecordBatch.from_arrays([*head, pa.array((sizes + 1).astype(np.int64)), pa.array(known), *totals], schema=schema)
                rest = np.flatnonzero(at == slots.keys.size - 1)
                if rest.size:
                    order = rest[np.lexsort((w.hashes[rest], doc[rest]))]
                    d, h = doc[order], w.hashes[order]
                    new = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])))
                    n, many = np.diff(np.append(new, order.size)), new.size
                    columns = [pa.array(row + d[new]), pa.nulls(many, pa.int64()), pa.nulls(many, pa.bool_()), pa.array(h[new].view(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(many, f.type) for f in list(schema)[5:])], schema=schema)
                row += count

    ddl = "rid bigint, doc_id bigint, held_out boolean, h bigint, tf bigint, n_tokens bigint, n_known bigint, " + ", ".join(f"{x} double" for x in sums)
    return docs.mapInArrow(run, ddl)


def _most_frequent(scored: DataFrame) -> pd.DataFrame:
    """At most TOP of the most frequent words, the most frequent first.

    A histogram over the counts' logarithms, of a few hundred rows, gives the least count to take; only words with that
    count or more go to the driver.
    """
    step = F.floor(F.log2("c") * 32)
    steps = scored.filter("c > 0").groupBy(step.alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("k")).collect()
    total, least = 0, None
    for r in steps:
        total += r["n"]
        if total > TOP:
            break
        least = r["k"]
    held = scored.filter(F.lit(False)) if least is None else scored.filter(step >= least)
    return held.toPandas().sort_values(["c", "h"], ascending=[False, True])


def score_texts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, vocabulary_score for each row."""
    path = path or public_tokenizers.path(VOCABULARY)
    rows = id_text(docs, id_col, text_col).withColumn("held_out", held_out("doc_id", FOLDS, FOLD))
    trained = rows.filter(~F.col("held_out")).count()
    words = cut(_count(rows), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = total["n"] + trained, total["v"] + (1 if trained else 0)
    vocab = vocabulary(path)
    given = _logs(vocab.prior)
    learnt = given
    for _ in range(ROUNDS if trained else 0):
        learnt = _fit(words, path, learnt, trained, n)
    logps = [learnt, given]
    scored = cut(_scored(words, path, logps, n, v), "scored")
    most = _most_frequent(scored)
    values = np.column_stack([(most["c"] > 0).to_numpy(float), most["base"].to_numpy(float), most[["s0", "s1"]].to_numpy(float)])
    slots = _Slots(most["h"].to_numpy(np.int64).view(np.uint64), values)
    ends = [float(np.log10((trained + 0.5) / (n + 0.5 * (v + 1)))), *(float(logp[vocab.end] / np.log(10)) for logp in logps)]
    sums = cut(_parts(rows, slots, ends, trained > 0), "parts")
    rest = sums.filter("h is not null").select("rid", "h", "tf").join(scored, "h").groupBy("rid")
    rest = rest.agg(
        F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).alias("k"), *[F.sum(F.col("tf") * F.col(x)).alias(f"m{x}") for x in ("base", "s0", "s1")]
    )
    texts = sums.filter("h is null").join(rest, "rid", "left")

    def with_rest(own: str, more: str):  # noqa: ANN202
        return F.col(own) + F.coalesce(F.col(more), F.lit(0))

    return texts.select(
        "doc_id", "held_out", "n_tokens", with_rest("n_known", "k").alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"), with_rest("base_score", "mbase").alias("base_score"),
        (with_rest("s0", "ms0") if trained else F.lit(None).cast("double")).alias("score"), with_rest("s1", "ms1").alias("vocabulary_score"),
    )
