import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest

from millrace.llm import lattice

PATH = public_tokenizers.path(lattice.VOCABULARY)


def _all_segmentations(vocab, logp, text):
    """Sum over segmentations and expected piece counts, by enumeration."""
    paths = []

    def walk(at, done):
        if at == len(text):
            paths.append(done)
            return
        for end in range(at + 1, len(text) + 1):
            piece = vocab.by_text.get(text[at:end])
            if piece is not None:
                walk(end, [*done, piece])
            elif end == at + 1:
                walk(end, done + [int(vocab.byte[b]) for b in text[at].encode()])

    walk(0, [])
    values = np.array([sum(logp[p] for p in path) for path in paths])
    total = np.logaddexp.reduce(values)
    used = np.zeros(logp.size)
    for path, v in zip(paths, values, strict=True):
        for p in path:
            used[p] += math.exp(v - total)
    return total, used


@pytest.mark.parametrize("words", [["the", "cat", "ing"], ["straße", "naïve!?"], ["x日本y", "🙂"], ["a"]])
def test_marginals_and_expectations_match_enumeration(words):
    vocab = lattice.vocabulary(PATH)
    with np.errstate(divide="ignore"):
        logp = np.log(vocab.prior)
    got = lattice.marginals(vocab, [logp, logp - 1.0], words)
    assert (got[:, 1] < got[:, 0]).all()
    got, used = got[:, 0], np.zeros(logp.size)
    for _, chars in lattice._by_length(words):
        used += lattice.Lattice(vocab, chars).uses(logp, np.ones(chars.shape[0]))
    want = [_all_segmentations(vocab, logp, lattice.MARK + w) for w in words]
    assert np.allclose(got, [t for t, _ in want])
    assert np.allclose(used, sum(u for _, u in want))


def _plain_scores(vocab, rows, held):
    """{doc_id: (score, vocabulary_score)}: learning and scoring by enumeration of all segmentations of whole texts."""
    with np.errstate(divide="ignore"):
        given = np.log(vocab.prior)
    logp, train = given, [brute.words(t) for k, t in rows if not held[k]]
    tokens = sum(map(len, train)) + len(train)
    for _ in range(lattice.ROUNDS):
        counts = lattice.PRIOR * tokens * vocab.prior
        for ws in train:
            counts[vocab.end] += 1
            for w in ws:
                counts = counts + _all_segmentations(vocab, logp, lattice.MARK + w)[1]
        with np.errstate(divide="ignore"):
            logp = np.log(counts / counts.sum())
    out = {}
    for k, t in rows:
        text = "".join(lattice.MARK + w for w in brute.words(t))  # one lattice over the whole text
        out[k] = tuple((_all_segmentations(vocab, p, text)[0] + p[vocab.end]) / math.log(10) for p in (logp, given))
    return out


def test_scores_match_enumeration_of_whole_texts(spark):
    texts = ["the cat", "a dog", "The cat sat", "ab ba", "", None, "x日", "cat cat", "dogs"]
    rows = [(i, t) for i, t in enumerate(texts)]
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in rows}
    assert any(held.values()) and not all(held.values())
    want = _plain_scores(lattice.vocabulary(PATH), rows, held)
    df = spark.createDataFrame([(k, t, 1) for k, t in [*rows, (0, "the cat")]], "doc_id bigint, text string, h int")
    twice = lattice.score_texts(df.limit(len(rows)))
    got = {x.doc_id: (x.score, x.vocabulary_score) for x in twice.collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], atol=1e-9), k


def test_repeated_rows_are_scored_each(spark):
    df = spark.createDataFrame([(3, "a b"), (3, "a b"), (3, "c"), (4, "a")], "doc_id bigint, text string")
    got = sorted((x.n_tokens, x.train_tokens, round(x.score, 9)) for x in lattice.score_texts(df).filter("doc_id = 3").collect())
    assert len(got) == 3 and got[1] == got[2] and got[0][0] == 2


def test_base_figures_and_score_on_held_out_texts(spark):
    r = random.Random(8)
    heads, tails = ["ba", "lo", "mi", "ter", "son"], ["ing", "ed", "er", "ion", "ly"]
    def text():
        return " ".join(r.choice(heads) + r.choice(heads) + r.choice(tails) for _ in range(r.randrange(5, 40)))
    rows = [(i, text(), "en", 1) for i in range(200)] + [(900, None, None, 1), (901, "", "en", 1), (902, "q" * 3000, "en", 1), (None, "baloing", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, h int")
    held = {k: k is None or zlib.crc32(str(k).encode()) % 5 == 1 for k, *_ in rows}
    counts, ends = Counter(), 0
    for k, t, *_ in rows:
        if not held[k]:
            counts.update(brute.words(t))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    got = {x.doc_id: x for x in lattice.score_texts(df).collect()}
    assert len(got) == len(rows)
    for k, t, *_ in rows:
        x, w = got[k], brute.words(t)
        base = sum(math.log10((counts[a] + 0.5) / (n + 0.5 * (v + 1))) for a in w) + math.log10((ends + 0.5) / (n + 0.5 * (v + 1)))
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(w) + 1, sum(counts[a] > 0 for a in w) + 1, n)
        assert abs(x.base_score - base) < 1e-6
        assert x.score < 0 and math.isfinite(x.score)


def test_words_outside_the_held_table_are_joined(spark, monkeypatch):
    rows = [(i, f"common word{i % 7} rare{i}", "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = {x.doc_id: (x.n_known, round(x.base_score, 9), round(x.score, 9)) for x in lattice.score_texts(df).collect()}
    monkeypatch.setattr(lattice, "TOP", 2)
    assert {x.doc_id: (x.n_known, round(x.base_score, 9), round(x.score, 9)) for x in lattice.score_texts(df).collect()} == whole


def test_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b", None)], "doc_id bigint, text string, lang string")
    x = lattice.score_texts(df).first()
    assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens, x.score) == (True, 3, 0, 0, None)
    assert x.vocabulary_score < 0
    assert lattice.score_texts(df.limit(0)).collect() == []
