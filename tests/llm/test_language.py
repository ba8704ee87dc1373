import zlib

import numpy as np

from millrace.llm import language

ROOT = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 150
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_em_matches_brute_force(monkeypatch):
    r = np.random.default_rng(5)
    model = np.log(r.dirichlet(np.ones(50), 3))
    bins, new, first = r.integers(0, 50, 60), np.arange(0, 60, 3), np.array([0, 20])
    lik = np.exp([[model[k, bins[a : a + 3]].sum() for k in range(3)] for a in new])
    share = np.full(3, 1 / 3)
    for _ in range(4):
        joint = lik * share
        share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
    monkeypatch.setattr(language, "TOLERANCE", 0.0)
    got, value = language._fit(lik, np.zeros(20, int), np.array([0]), np.full((1, 3), 1 / 3), 4)
    assert np.allclose(got[0], share)
    assert np.isclose(value[0], np.log((lik * share).sum(axis=1)).sum())
    assert np.isclose(language.infer(bins, new, first, model).sum(), 1)


def test_four_languages_of_which_two_are_close():
    r = np.random.default_rng(1)
    p = r.dirichlet(np.full(300, 0.3), 4)
    p[3] = 0.7 * p[2] + 0.3 * p[3]
    counts = np.array([260, 300, 280, 160])
    lang = np.repeat(np.arange(4), counts)
    bins = np.concatenate([r.choice(300, 3, p=p[k]) for k in lang])
    got = language.infer(bins, np.arange(0, bins.size, 3), np.array([0, lang.size]), np.log(p + 1e-9))[0]
    assert got.argmax() == 1
    assert np.abs(got - counts / 1000).max() < 0.05


def test_prediction_matches_a_plain_version(spark):
    """Counts, likelihoods, EM and the choice of the set by penalised likelihood, in plain Python."""
    parts = {"en": "the house and the garden with green trees", "de": "das haus und der garten mit schönen bäumen", "fr": "la maison et le jardin avec des arbres verts"}
    r = np.random.default_rng(7)
    rows = [(i, " ".join(r.choice(parts[g].split(), 12)), g) for i in range(120) for g in [["en", "de", "fr"][i % 3]]]
    rows += [(1000 + i, " ".join([*r.choice(parts["en"].split(), a), *r.choice(parts["de"].split(), b), *r.choice(parts["fr"].split(), c)]), None) for i, (a, b, c) in enumerate([(9, 0, 0), (9, 8, 0), (6, 7, 8), (1, 9, 0), (0, 3, 9)])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")

    def words(text):
        bins, new, _ = language.trigrams([text])
        return [bins[a:b] for a, b in zip(new, [*new[1:], bins.size], strict=True)]

    counts = {g: np.full(language.BINS, language.SMOOTH) for g in parts}
    for k, t, g in rows:
        if g and zlib.crc32(str(k).encode()) % 4 != 2:
            for w in words(t):
                np.add.at(counts[g], w, 1)
    langs = sorted(parts)
    logs = [np.log(counts[g] / counts[g].sum()) for g in langs]
    got = {x.doc_id: x for x in language.identify(df).collect()}
    for k, t, _ in rows:
        lik = np.array([[np.exp(p[w].sum()) for p in logs] for w in words(t)])
        share, best = np.full(3, 1 / 3), None

        def settled(share, lik=lik):
            while True:
                joint = lik * share
                new = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
                if np.abs(new - share).max() <= language.TOLERANCE:
                    return new
                share = new

        share = settled(share)
        for size in (3, 2, 1):
            keep = np.argsort(-share, kind="stable")[:size]
            share = np.where(np.isin(np.arange(3), keep), share + 1e-6, 0)
            share = share / share.sum()
            share = settled(share) if size > 1 else share
            value = np.log((lik * share).sum(axis=1)).sum() - language.PENALTY * (size - 1) * np.log(len(lik) + 1)
            if best is None or value >= best[0]:
                best = (value, share)
        assert got[k].lang_pred == langs[int(best[1].argmax())]
        assert abs(got[k].score - best[1].max()) < 0.01


def test_more_than_64_languages_repeats_and_long_texts(spark):
    rows = [(i, f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}qx" * 3, f"l{i:03d}") for i in range(80)]
    text = rows[5][1]
    df = spark.createDataFrame([*rows, (500, (text + " ") * 20_000, None), (500, text, None), (500, text, None)], "doc_id bigint, text string, lang string")
    got = [(r.lang_pred, round(r.score, 6)) for r in language.identify(df).filter("doc_id = 500").collect()]
    assert len(got) == 3 and len(set(got)) <= 2
    assert len({r.lang for r in df.filter("lang is not null").select("lang").distinct().collect()}) == 80


def test_mixture_and_edges(spark):
    train = [(i, t, g) for i in range(0, 400) for t, g in [("the house and the garden with green trees", "en") if i % 2 else ("das haus und der garten mit schönen bäumen", "de")]]
    more = [(1000, "the house and the garden with green trees das haus und der garten mit schönen bäumen", "en"), (1001, None, "en"), (1002, "123 !!", "de"), (1003, "", None), (None, "das haus", None)]
    df = spark.createDataFrame([(*r, 1) for r in train + more], "doc_id bigint, text string, lang string, k0 int")
    got = {r.doc_id: r for r in language.identify(df).collect() if r.doc_id is None or r.doc_id >= 1000}
    assert got[1000].lang_mix.count("=") == 2
    assert abs(got[1000].score - 0.5) < 0.15
    assert [(got[k].lang_pred, got[k].score) for k in (1001, 1002, 1003)] == [("und", 0.0)] * 3
    assert got[None].lang_pred == "de" and got[None].held_out
    assert language.identify(df.limit(0)).collect() == []
    unlabelled = spark.createDataFrame([(1, "das haus", None)], "doc_id bigint, text string, lang string")
    assert [r.lang_pred for r in language.identify(unlabelled).collect()] == ["und"]
