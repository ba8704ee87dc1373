"""Toxicity of texts behind obfuscation: restore by a noisy channel, then score the restored words.

Restoring. Suspicious stretches are words with look-alike signs (l0ser, hat3, a$$), with a doubled letter (stuupid), or
three and more single characters apart (i d i o t, i.d.i.o.t). Each becomes a lattice: a sign may be itself or a letter
that it looks like, a repeated letter or a separator may be dropped, each at a channel cost. Viterbi decoding under a
character trigram model, trained on all training texts, picks the most likely original. A stretch that decoding changes
counts as restored, and its raw words give features too, so that a wrong reading hides nothing.

Groups (st up id). When scoring, neighbouring fragments that together spell a kept feature, look-alike signs and repeated
letters included, are decoded as well; what decoding joins gives features.

Scoring. Features are the restored words, the runs of letters in them (you,idiot or idiot/moron), and the beginnings of 4
and 5 letters of both; words over LONG characters are features by their hash. Document counts by label over at most
MAX_LABELLED labelled rows of each label (those with the smallest hash of the id) give each feature its smoothed share of
toxic documents; all features with a share of at least STRONG are kept. Copies of one toxic document
make its harmless words look toxic, so the kept features are fitted together: a noisy-or whose credit for each toxic
document is divided by expectation maximisation. A text's score is the noisy-or of its features and the base rate.

Null and empty texts have the base score. Very long texts are scored whole; ties of readings go to the one found first. Rows are scored each; labels that repeat an id count as toxic if one says so;
null labels and null ids are left out. Without labels every text has the base score. A null doc_id is held out.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import held_out, id_text, slices
from millrace.llm.words import LOWER, SPACE, utf8

FOLDS, FOLD = 4, 2
CUTOFF = 0.3
MAX_LABELLED = 10_000
LEAST = 3
PRIOR_DOCS, STRONG, BASE = 10, 0.35, 0.02
STEPS, WEAKEST = 30, 0.1
EDGES = ".,;:!?\"'()[]{}<>*_~-"
LONG = 64
RUN = re.compile(r"[^\W\d_]+")

#: Signs and the letters they look like, and characters that may stand between spread letters.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
SEPARATORS = " .-_*"
#: Log costs of the channel.
LOOK_COST, DROP_COST = -1.0, -0.7

LETTERS = "abcdefghijklmnopqrstuvwxyzäöüßàâáçéèêëîïíìñôóòûùúœæ"
_SIZE = len(LETTERS) + 2  # and space, other
_SPACE_ID, _OTHER = len(LETTERS), len(LETTERS) + 1
_CODE = np.full(0x110000, _OTHER, np.uint8)
_CODE[[ord(c) for c in LETTERS]] = np.arange(len(LETTERS))
_CODE[[9, 10, 11, 12, 13, 32]] = _SPACE_ID
_IDS = {c: i for i, c in enumerate(LETTERS)} | {c: _SPACE_ID for c in " \n\t"}

#: Where a reading may differ from what is written: at a sign, at a separator inside, or (group 1) at a repeated character.
_TURN = re.compile(f"[{re.escape(''.join(LOOKS))}]|[{re.escape(SEPARATORS)}](?!\\Z)|([{re.escape(''.join(_IDS))}])\\1")
#: Two readings nearer than this are compared by sums over the whole stretch.
_NEAR = 1e-6

_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in LOOKS]] = True
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def char_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities (a, b, c) of character c after a and b, over all given texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            for part in slices(batch):
                raw = ("\n" + "\n\n".join(part.column("text").to_pylist()) + "\n").lower().encode("utf-32-le", "surrogatepass")
                x = _CODE[np.frombuffer(raw, np.uint32)].astype(np.int32)
                counts += np.bincount((x[:-2] * _SIZE + x[1:-1]) * _SIZE + x[2:], minlength=counts.size)
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at), pa.array(counts[at])], ["k", "n"])

    got = docs.mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # at most _SIZE ** 3 rows
    counts = np.zeros(_SIZE**3)
    counts[got["k"].to_numpy(int)] = got["n"].to_numpy(float)
    counts = counts.reshape(_SIZE, _SIZE, _SIZE)
    one = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + _SIZE)
    two = (counts.sum(axis=0) + 5 * one) / (counts.sum(axis=(0, 2))[:, None] + 5)
    return np.log((counts + 5 * two) / (counts.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


class Decoder:
    """Viterbi over the last two restored characters."""

    def __init__(self, model: np.ndarray) -> None:
        self.p = model.ravel().tolist()
        self.decode = lru_cache(50_000)(self._decode)

    def _decode(self, raw: str) -> str:
        p = self.p
        turn = _TURN.search(raw)
        if turn is None:
            return raw
        at = turn.start()
        if turn[1] and _TURN.search(raw, at + 1) is None:  # one letter to keep or to drop: only the characters around it count
            a, c, end = [_IDS.get(x, _OTHER) for x in (raw[at - 1] if at else " ", raw[at], raw[at + 2] if at + 2 < len(raw) else " ")]
            gain = DROP_COST + p[(a * _SIZE + c) * _SIZE + end] - p[(a * _SIZE + c) * _SIZE + c] - p[(c * _SIZE + c) * _SIZE + end]
            if abs(gain) > _NEAR:
                return raw[:at] + raw[at + 1 :] if gain > 0 else raw
        last, value = _SPACE_ID * _SIZE + _SPACE_ID, 0.0
        for ch in raw[:at]:
            at_p = last * _SIZE + _IDS.get(ch, _OTHER)
            value += p[at_p]
            last = at_p % _SIZE**2
        states: dict[int, tuple[float, tuple]] = {last: (value, ((), raw[:at]) if at else ())}
        for k, ch in enumerate(raw[at:], at):
            options = [(ch, _IDS.get(ch, _OTHER), 0.0)] + [(c, _IDS[c], LOOK_COST) for c in LOOKS.get(ch, "")]
            drop = k and ((ch == raw[k - 1] and ch in _IDS) or (ch in SEPARATORS and k + 1 < len(raw)))
            new: dict[int, tuple[float, tuple]] = {}
            for last, (value, path) in states.items():
                for c, i, cost in options:
                    at_p = last * _SIZE + i
                    v = value + cost + p[at_p]
                    key = at_p % _SIZE**2
                    if key not in new or v > new[key][0]:
                        new[key] = (v, (path, c))
                if drop:
                    v = value + DROP_COST
                    if last not in new or v > new[last][0]:
                        new[last] = (v, path)
            states = new
        best = max(((v + p[last * _SIZE + _SPACE_ID], path) for last, (v, path) in states.items()), key=lambda x: x[0])[1]
        out = []
        while best:
            best, c = best
            out.append(c)
        return "".join(reversed(out))


def suspicious(column: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """The lower-cased bytes of a slice, and by row the byte ranges of suspicious stretches, in order."""
    data, offsets = utf8(column)
    data = LOWER[data]
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(column))]
    if data.size < 3:
        return data, out
    word = ~SPACE[data]
    edge = np.zeros(data.size + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word & ~np.append(False, word[:-1] & ~edge[1 : data.size]))
    ends = np.flatnonzero(word & ~np.append(word[1:] & ~edge[1 : data.size], False)) + 1
    if not starts.size:
        return data, out
    signs = np.flatnonzero(_SIGN[data])
    inner = ~edge[1 : data.size]  # a byte and the next are of one row
    double = np.flatnonzero((data[1:] == data[:-1]) & _LETTER[data[1:]] & (data[1:] < 128) & inner)
    wide = dotted = double[:0]
    if data.size > 3:
        within = inner[:-2] & inner[1:-1] & inner[2:]
        wide = np.flatnonzero((data[:-3] >= 192) & (data[:-3] == data[2:-1]) & (data[1:-2] == data[3:]) & within)
        dotted = np.flatnonzero(_LETTER[data[:-3]] & np.isin(data[1:-2], [46, 45, 95, 42]) & _LETTER[data[2:-1]] & np.isin(data[3:], [46, 45, 95, 42]) & within)
    words = np.unique(np.searchsorted(starts, np.concatenate([signs, double, wide, dotted]), "right") - 1)
    words = words[words >= 0]
    single = (ends - starts == 1) & (_LETTER[data[starts]] | _SIGN[data[starts]])
    doc = np.searchsorted(offsets, starts, "right") - 1
    run = single[1:] & single[:-1] & (doc[1:] == doc[:-1]) & (starts[1:] == ends[:-1] + 1)
    turns = np.flatnonzero(np.diff(np.concatenate([[False], run, [False]]).astype(np.int8)))
    turns = turns.reshape(-1, 2)[turns[1::2] - turns[::2] >= 2]
    first, last = np.concatenate([words, turns[:, 0]]), np.concatenate([words, turns[:, 1]])
    order = np.lexsort((-last, first))
    first, last = first[order], last[order]
    free = np.append(-1, np.maximum.accumulate(last))[:-1] < first  # words of a run go with it
    first, last = first[free], last[free]
    ranges = list(zip(starts[first].tolist(), ends[last].tolist(), strict=True))
    bounds = np.searchsorted(doc[first], np.arange(len(column) + 1)).tolist()
    return data, [ranges[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def readings(column: pa.Array, decoder: Decoder) -> list[tuple[str, list[str]]]:
    """Lower-cased texts with suspicious stretches restored, and the raw stretches that this changed."""
    data, found = suspicious(column)
    _, offsets = utf8(column)
    raw = data.tobytes()
    out = []
    for k, ranges in enumerate(found):
        at, parts, changed = int(offsets[k]), [], []
        for a, b in ranges:
            stretch = raw[a:b].decode()
            best = decoder.decode(stretch)
            if best != stretch:
                parts += [raw[at:a], best.encode()]
                at = b
                changed.append(stretch.lower())
        parts.append(raw[at : int(offsets[k + 1])])
        out.append((b"".join(parts).decode().lower(), changed))
    return out


def restore(column: pa.Array, decoder: Decoder) -> list[str]:
    """Lower-cased texts with suspicious stretches restored."""
    return [text for text, _ in readings(column, decoder)]


def _like(letter: str) -> str:
    return letter + "".join(s for s, letters in LOOKS.items() if letter in letters)


def spelt(features: Iterable[str]) -> tuple[re.Pattern, re.Pattern] | None:
    """Matches what spells a feature with separators, look-alike signs and repeated letters; before that, a pattern that
    finds where a word starts with two characters that may begin one, which is quick as it starts with a set."""
    trie: dict = {}
    for f in features:
        word = f.rstrip("~")
        if len(word) > 1 and word.isalpha():
            node = trie
            for c in word:
                node = node.setdefault(c, {})
            node["~" if f.endswith("~") else ""] = {}
    if not trie:
        return None

    def tail(node: dict) -> str:
        ways = []
        for c, then in sorted(node.items(), reverse=True):  # longer words first
            if c == "~":
                ways.append(r"\w*")
            elif c == "":
                ways.append(r"(?!\w)")
            else:
                ways.append(f"[{re.escape(_like(c))}]+" + ("" if then.keys() <= {"", "~"} else f"[{re.escape(SEPARATORS)}]?") + tail(then))
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    def chars(some: Iterable[str]) -> str:
        return f"[{re.escape(''.join(sorted(set(some))))}]"

    first = chars("".join(map(_like, trie)))
    pairs = [f"(?<={chars(_like(c))})(?={chars(SEPARATORS + _like(c) + ''.join(map(_like, then)))})" for c, then in sorted(trie.items())]
    return re.compile(f"{first}(?<!\\w{first})(?:{'|'.join(pairs)})"), re.compile(tail(trie))


def joined(text: str, patterns: tuple[re.Pattern, re.Pattern] | None, decoder: Decoder) -> list[str]:
    """Words of the decoded groups of fragments in a lower-cased text."""
    if patterns is None:
        return []
    start, whole = patterns
    found = {m[0] for s in start.finditer(text) if (m := whole.match(text, s.start()))}
    groups = {g for g in found if any(c in SEPARATORS for c in g)}
    return [w for g in sorted(groups) for w in decoder.decode(g).split()]


def word_features(word: str) -> list[str]:
    w = word.strip(EDGES)
    out = []
    for x in [w] if w.isalpha() else dict.fromkeys([w, *RUN.findall(w)]):
        if x:
            out += [x if len(x) <= LONG else "#" + hashlib.md5(x.encode()).hexdigest()] + ([x[:5] + "~"] if len(x) > 5 else []) + ([x[:4] + "~"] if len(x) > 4 else [])
    return out


def text_features(text: str) -> set[str]:
    return {f for w in set(text.split()) for f in word_features(w)}


def _marked(docs: DataFrame, mark: dict[int, int], model: np.ndarray, fn, ddl: str) -> DataFrame:  # noqa: ANN001
    """fn(ids, feature sets) -> record batch, over slices of the labelled rows."""
    ids = pa.array(list(mark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            for part in slices(batch.filter(pa.compute.is_in(batch.column("doc_id"), ids))):
                yield fn(part.column("doc_id").to_pylist(), [text_features(" ".join([t, *raw])) for t, raw in readings(part.column("text"), decoder)])

    return docs.mapInArrow(run, ddl)


def noisy_or(rows: np.ndarray, features: np.ndarray, shares: np.ndarray, has: np.ndarray, rate: float) -> np.ndarray:
    """Fits the shares of features to labels: pair k says that toxic document rows[k] has features[k]; `has` counts all labelled
    documents with a feature, `rate` is the share of toxic ones. Pairs are worked on in parts of a million."""
    p, count = shares.copy(), int(rows.max(initial=-1)) + 1
    prior = PRIOR_DOCS * rate
    parts = [slice(k, k + 1_000_000) for k in range(0, rows.size, 1_000_000)]
    for _ in range(STEPS):
        clean, credit = np.full(count, np.log(1 - BASE)), np.zeros(p.size)
        for x in parts:
            clean += np.bincount(rows[x], np.log1p(-np.minimum(p[features[x]], 0.999)), count)
        for x in parts:
            credit += np.bincount(features[x], p[features[x]] / np.maximum(1 - np.exp(clean[rows[x]]), 1e-9), p.size)
        p = (credit + prior * p) / (has + PRIOR_DOCS)
    return p


def learn(docs: DataFrame, labels: DataFrame, model: np.ndarray) -> dict[str, float]:
    """Toxic shares of strong features. `docs`: doc_id, text; `labels`: doc_id, toxic."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    mark: dict[int, int] = {}
    for label in (0, 1):
        for r in known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect():
            mark[r["doc_id"]] = label
    if not mark:
        return {}

    def count(keys: list[int], sets: list[set[str]]) -> pa.RecordBatch:
        counts = (Counter(), Counter())
        for key, features in zip(keys, sets, strict=True):
            counts[mark[key]].update(features)
        names = [*counts[0].keys() | counts[1].keys()]
        return pa.record_batch([pa.array(names, pa.string()), *(pa.array([counts[y][f] for f in names], pa.int64()) for y in (1, 0))], ["f", "pos", "neg"])

    sums = _marked(docs, mark, model, count, "f string, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate = sum(mark.values()) / len(mark)
    share = (F.col("pos") + PRIOR_DOCS * rate) / (F.col("pos") + F.col("neg") + PRIOR_DOCS)
    strong = sums.filter(F.col("pos") >= LEAST).withColumn("share", share).filter(F.col("share") >= STRONG)
    kept = strong.orderBy(F.desc("share"), F.desc("pos"), "f").select("f", "share", (F.col("pos") + F.col("neg")).alias("has")).toArrow()  # of the labelled texts only
    if not kept.num_rows:
        return {}
    names = kept.column("f").to_pylist()
    at = {f: k for k, f in enumerate(names)}

    def present(keys: list[int], sets: list[set[str]]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys, pa.int64()), pa.array([sorted(at[f] for f in s if f in at) for s in sets], pa.list_(pa.int32()))], ["doc_id", "x"])

    toxic = {k: y for k, y in mark.items() if y}
    table = _marked(docs, toxic, model, present, "doc_id bigint, x array<int>").orderBy("doc_id").toArrow()  # a row for each toxic text
    x = table.column("x").combine_chunks()
    rows = np.repeat(np.arange(table.num_rows, dtype=np.int32), pa.compute.list_value_length(x).to_numpy())
    fitted = noisy_or(rows, x.flatten().to_numpy(), kept.column("share").to_numpy(), kept.column("has").to_numpy(), rate)
    return {names[k]: float(fitted[k]) for k in np.flatnonzero(fitted >= WEAKEST).tolist()}


def score(docs: DataFrame, model: np.ndarray, shares: dict[str, float], keep: list[str]) -> DataFrame:
    """Adds score and n_restored to the columns to keep; `docs` has these and text."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    patterns = spelt(shares)
    heads = {f[:4] for f in shares}  # all features of a word of letters start like it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        known: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for part in slices(batch):
                out, restored = [], []
                for text, raw in readings(part.column("text"), decoder):
                    clean, hit = 1 - BASE, set()
                    restored.append(len(raw))
                    for w in {*text.split(), *" ".join(raw).split(), *joined(text, patterns, decoder)}:
                        x = w if w.isalpha() else w.strip(EDGES)
                        if x[:4] not in heads and len(x) <= LONG and x.isalpha():
                            continue
                        own = known.get(w)
                        if own is None:
                            if len(known) > 500_000:
                                known.clear()
                            own = tuple(f for f in word_features(w) if f in shares)
                            if len(w) <= LONG:
                                known[w] = own
                        if own:
                            hit.update(own)
                    for f in sorted(hit):
                        clean *= 1 - shares[f]
                    out.append(1 - clean)
                columns = [part.column(c) for c in keep]
                yield pa.record_batch([*columns, pa.array(out, pa.float64()), pa.array(restored, pa.int32())], [*keep, "score", "n_restored"])

    ddl = ", ".join(f"{c} {kinds[c]}" for c in keep)
    return docs.mapInArrow(run, f"{ddl}, score double, n_restored int")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_restored for each row of `docs`."""
    rows = id_text(docs, id_col, text_col).withColumn("held_out", held_out("doc_id", FOLDS, FOLD))
    train = rows.filter(~F.col("held_out")).select("doc_id", "text")
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marks = marks.filter(~held_out("doc_id", FOLDS, FOLD))
    model = char_model(train)
    scored = score(rows, model, learn(train, marks, model), ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"), "n_restored")
