"""Languages of a document as a mixture, by expectation maximisation over n-gram likelihoods.

Learning counts character trigrams (letters lower-cased, everything else a space, centred on a letter) in BINS hashed
bins for each language, over all training documents. A word's likelihood in a language is the product of its trigrams'.
For each document, EM estimates the share of each language, until no share moves by more than TOLERANCE. The set of languages is chosen by penalised likelihood:
from all languages down to one, the smallest share is dropped again and again, the shares are fitted anew, and the set with
the best log likelihood - PENALTY * (size - 1) * log(words) wins. The prediction is the language with the largest share.

Null texts and texts without a letter are `und` with score 0. Very long texts are judged whole. Of equal shares the language
that comes first in the alphabet leads. Rows are judged each, repeated ones alike. Without training rows all is `und`. A
null doc_id counts as held out. An empty table gives no rows. There may be any number of languages; the driver and each
task hold BINS numbers for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frames import held_out, slices

BINS = 1 << 16
SMOOTH = 0.5
PENALTY = 2.0
#: Steps of EM, at most; it ends when no share moves by more than TOLERANCE.
STEPS, TOLERANCE = 100, 0.002
FOLDS, FOLD = 4, 2


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of the trigrams, the first trigram of each word, and the first word of each text (one more at the end)."""
    lower = [(t or "").lower() for t in texts]
    sizes = np.fromiter((len(t) + 1 for t in lower), np.int64, len(lower))
    raw = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    x = np.where(letter, raw, np.uint32(32)).astype(np.uint64)
    at = np.flatnonzero(letter)
    h = x[at - 1] * np.uint64(0x9E3779B97F4A7C15) + x[at] * np.uint64(0xC2B2AE3D27D4EB4F) + x[at + 1] * np.uint64(0x165667B19E3779F9)
    bins = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)
    new = np.flatnonzero(~letter[at - 1])
    starts = np.concatenate([[0], np.cumsum(sizes)]) + 1  # of each text in raw
    return bins, new, np.searchsorted(at[new], starts)


def learn(docs: DataFrame, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their log probabilities (languages, BINS)."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch):
                bins, new, first = trigrams(part.column("text").to_pylist())
                at = np.append(new, bins.size)[first]
                for k, lang in enumerate(part.column("lang").to_pylist()):
                    if lang not in counts:
                        counts[lang] = np.zeros(BINS, np.int64)
                    own = bins[at[k] : at[k + 1]]
                    if own.size > BINS // 8:
                        counts[lang] += np.bincount(own, minlength=BINS)
                    else:
                        np.add.at(counts[lang], own, 1)
        for lang, c in counts.items():
            b = np.flatnonzero(c)
            yield pa.record_batch([pa.array([lang] * b.size, pa.string()), pa.array(b.astype(np.int32)), pa.array(c[b])], ["lang", "bin", "n"])

    summed = rows.mapInArrow(run, "lang string, bin int, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n"))
    one = summed.groupBy("lang").agg(F.collect_list(F.struct("bin", "n")).alias("c")).select("lang", F.col("c.bin").alias("bins"), F.col("c.n").alias("n"))
    langs, rows_of = [], []
    for r in one.orderBy("lang").toLocalIterator():  # a row for each language, with at most BINS counts
        counts = np.full(BINS, SMOOTH)
        counts[np.array(r["bins"], int)] += np.array(r["n"], float)
        langs.append(r["lang"])
        rows_of.append(np.log(counts / counts.sum()).astype(np.float32))
    return langs, np.stack(rows_of) if langs else np.zeros((0, BINS), np.float32)


def _fit(lik: np.ndarray, doc: np.ndarray, first: np.ndarray, shares: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """EM from given shares (documents, languages); zero shares stay zero. Returns shares and log likelihoods.

    Each document leaves once its shares are settled.
    """
    n = np.diff(first, append=doc.size)
    shares = shares.copy()
    rows, own, at, left = lik, doc, first, np.arange(first.size)
    for _ in range(steps):
        joint = rows * shares[own]
        joint /= joint.sum(axis=1, keepdims=True)
        new = np.add.reduceat(joint, at, axis=0) / n[left][:, None]
        moves = np.abs(new - shares[left]).max(axis=1) > TOLERANCE
        shares[left] = new
        if not moves.any():
            break
        if not moves.all():
            left = left[moves]
            still = np.zeros(first.size, bool)
            still[left] = True
            keep = still[own]
            rows, own = rows[keep], own[keep]
            at = np.concatenate([[0], np.cumsum(n[left])[:-1]])
    return shares, np.add.reduceat(np.log((lik * shares[doc]).sum(axis=1)), first)


def infer(bins: np.ndarray, new: np.ndarray, first: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Shares (texts, languages) of the chosen sets; zeros for texts without words."""
    count, langs = first.size - 1, model.shape[0]
    out = np.zeros((count, langs))
    if not new.size or not langs:
        return out
    ll = np.stack([np.add.reduceat(row[bins], new) for row in model], axis=1)
    lik = np.exp(np.maximum(ll - ll.max(axis=1, keepdims=True), -60.0))
    full = np.flatnonzero(np.diff(first))
    sizes = np.diff(first)[full]
    doc, at = np.repeat(np.arange(full.size), sizes), first[full]
    shares, _ = _fit(lik, doc, at, np.full((full.size, langs), 1 / langs), STEPS)
    best, best_value = np.zeros_like(shares), np.full(full.size, -np.inf)
    for size in range(langs, 0, -1):
        order = np.argsort(-shares, axis=1, kind="stable")
        kept = np.zeros_like(shares)
        np.put_along_axis(kept, order[:, :size], 1.0, axis=1)
        shares = (shares + 1e-6) * kept
        shares /= shares.sum(axis=1, keepdims=True)
        shares, value = _fit(lik, doc, at, shares, STEPS if size > 1 else 0)
        value = value - PENALTY * (size - 1) * np.log(sizes + 1)
        better = value >= best_value
        best[better], best_value = shares[better], np.maximum(value, best_value)
    out[full] = best
    return out


def detect(docs: DataFrame, langs: list[str], model: np.ndarray, keep: list[str], text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and lang_mix (language=share of the set, largest first) to the columns to keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model.astype(np.float32))
    source = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("__text"))
    names = [f"k{i}" for i in range(len(keep))]
    source = source.toDF(*names, "text")
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                shares = infer(*trigrams(part.column("text").to_pylist()), shared.value)
                pred, score, mix = [], [], []
                for row in shares:
                    order = [int(i) for i in np.argsort(-row, kind="stable") if row[i] > 0]
                    pred.append(langs[order[0]] if order else "und")
                    score.append(min(1.0, float(row[order[0]])) if order else 0.0)
                    mix.append(",".join(f"{langs[i]}={row[i]:.3f}" for i in order))
                columns = [part.column(i) for i in range(len(names))]
                yield pa.record_batch([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], [*names, "lang_pred", "score", "lang_mix"])

    return source.mapInArrow(run, f"{kinds}, lang_pred string, score double, lang_mix string").toDF(*keep, "lang_pred", "score", "lang_mix")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, lang_mix for each row; learns from rows outside the held-out fold."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("held_out", held_out("doc_id", FOLDS, FOLD))
    langs, model = learn(rows.filter(~F.col("held_out")), "text", "lang")
    return detect(rows, langs, model, ["doc_id", "held_out"])
