import random
import re
import sys

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import toxicity

ROOT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, "you are an idiot and a stupid moron in the trash said the clown to the good people of the town") for i in range(50)]
    return toxicity.char_model(spark.createDataFrame(rows, "doc_id bigint, text string"))


@pytest.mark.parametrize(
    ("raw", "restored"),
    [("l0ser 1d1ot", None), ("you 1diot", "you idiot"), ("you id1ot now", "you idiot now"), ("a st0p stuuupid x", None), ("a i d i o t x", None), ("the m0r0n", "the moron"), ("stuuuupid", "stupid"), ("i.d.i.o.t", "idiot"), ("the good people", "the good people"), ("$tupid", "stupid"), ("", "")],
)
def test_restoring(model, raw, restored):
    got = toxicity.restore(pa.array([raw, None, raw]), toxicity.Decoder(model))
    assert got[0] == got[2] and got[1] == ""
    if restored is not None:
        assert got[0] == restored
    if "i d i o t" in raw:
        assert "idiot" in got[0]


@pytest.mark.parametrize(("raw", "restored"), [("idiiot", "idiot"), ("moroon", "moron"), ("1 d 1 o t", "idiot"), ("tra$h", "trash"), ("foo", None)])
def test_doubled_letters_and_any_sign(model, raw, restored):
    decoder = toxicity.Decoder(model)
    text, changed = toxicity.readings(pa.array([raw]), decoder)[0]
    assert restored is None or text == restored
    assert changed == ([raw] if text != raw else [])
    assert toxicity.suspicious(pa.array(["foot", "tin"]))[1][1] == []  # the neighbour's last letter is not a double


def test_obfuscated_texts_score_like_plain_ones(spark, model):
    shares = {"stupid": 0.9, "stup~": 0.3, "idiot": 0.9, "moron": 0.8, "you": 0.01}
    plain = ["you stupid man", "you idiot man", "the moron"]
    hidden = ["you stuupid man", "you st up id man", "you st uup 1d man", "you idiiot man", "you idi ot man", "the mo ron", "the m0r0n"]
    rows = spark.createDataFrame(list(enumerate([*plain, *hidden, "the good people of the town"])), "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score(rows, model, shares, ["doc_id"]).collect()}
    want = [got[k] for k in (0, 0, 0, 1, 1, 2, 2)]
    assert all(got[3 + k] >= w - 1e-9 for k, w in enumerate(want))
    assert got[10] == pytest.approx(toxicity.BASE)


def test_words_glued_by_punctuation_and_long_words(spark, model):
    rows = [(0, "you,idiot,you"), (1, "idiot/moron"), (2, "good,people," * 20 + "idiot" + ",of,the,town" * 20), (3, "x" * 70 + "y")]
    shares = {"idiot": 0.9, toxicity.word_features("x" * 70 + "y")[0]: 0.9}
    got = toxicity.score(spark.createDataFrame(rows, "doc_id bigint, text string"), model, shares, ["doc_id"]).collect()
    assert all(r.score > 0.9 for r in got)
    assert len(toxicity.word_features("x" * 70)[0]) < toxicity.LONG


def test_viterbi_matches_enumeration(model):
    d = toxicity.Decoder(model)

    def best(raw):
        found = []

        def walk(k, text, value):
            if k == len(raw):
                found.append((value, text))
                return
            ch = raw[k]
            for c, cost in [(ch, 0.0)] + [(c, toxicity.LOOK_COST) for c in toxicity.LOOKS.get(ch, "")]:
                walk(k + 1, text + c, value + cost)
            if k and (ch == raw[k - 1] and ch in toxicity._IDS or ch in toxicity.SEPARATORS and k + 1 < len(raw)):
                walk(k + 1, text, value + toxicity.DROP_COST)

        walk(0, "", 0.0)

        def score(value, text):
            ids = [toxicity._SPACE_ID] * 2 + [toxicity._IDS.get(c, toxicity._OTHER) for c in text] + [toxicity._SPACE_ID]
            return value + sum(float(model[a, b, c]) for a, b, c in zip(ids, ids[1:], ids[2:], strict=False))

        return max(score(*x) for x in found), {t for v, t in found if abs(score(v, t) - max(score(*y) for y in found)) < 1e-4}

    for raw in ("1d1ot", "stuuupid", "a.b.c", "4557", "m0r0n!!"):
        assert d.decode(raw) in best(raw)[1]


def _lattice(p, raw):
    """The reading by the whole lattice, state by state."""
    states = {(toxicity._SPACE_ID,) * 2: (0.0, "")}
    for k, ch in enumerate(raw):
        drop = k and (ch == raw[k - 1] and ch in toxicity._IDS or ch in toxicity.SEPARATORS and k + 1 < len(raw))
        new = {}
        for (a, b), (value, text) in states.items():
            for c, cost in [(ch, 0.0)] + [(c, toxicity.LOOK_COST) for c in toxicity.LOOKS.get(ch, "")]:
                i = toxicity._IDS.get(c, toxicity._OTHER)
                v = value + cost + float(p[a, b, i])
                if (b, i) not in new or v > new[b, i][0]:
                    new[b, i] = (v, text + c)
            if drop and ((a, b) not in new or value + toxicity.DROP_COST > new[a, b][0]):
                new[a, b] = (value + toxicity.DROP_COST, text)
        states = new
    return max(((v + float(p[a, b, toxicity._SPACE_ID]), text) for (a, b), (v, text) in states.items()), key=lambda x: x[0])[1]


@pytest.mark.parametrize("signs", ["abdeilmnost", "idiotupsé", "aab1$.é", "st0p!-_* 3Éж"])
def test_readings_equal_the_lattices(model, signs):
    r, d = random.Random(5), toxicity.Decoder(model)
    for raw in ["", "aa", "aab", "baa", "stuupid", "idiott", ".", "a.", "..", "éé", "ÉÉ", *["".join(r.choices(signs, k=r.randrange(1, 12))) for _ in range(2000)]]:
        assert d.decode(raw) == _lattice(model, raw), raw


def _lines(fn):
    """Lines of the module that a call runs."""
    n = 0

    def trace(frame, event, _):
        nonlocal n
        n += event == "line" and frame.f_code.co_filename == toxicity.__file__
        return trace

    before = sys.gettrace()
    sys.settrace(trace)
    try:
        fn()
    finally:
        sys.settrace(before)
    return n


def test_one_repeated_letter_needs_no_lattice(model):
    d = toxicity.Decoder(model)
    assert _lines(lambda: d.decode("thegoodpeople" + "ofthetown" * 20)) < 60


def test_groups_start_at_words_only(model):
    patterns = toxicity.spelt(["idiot", "stup~", "éclat"])
    whole = re.compile(r"(?<!\w)(?=(" + patterns[1].pattern + "))")
    r = random.Random(6)
    for _ in range(3000):
        text = "".join(r.choice(["id", "iot", "i", "st", "up", "é", "clat", "1", "$", " ", ".", "x", "5t", "u p"]) for _ in range(r.randrange(9)))
        want = {g for g in whole.findall(text) if any(c in toxicity.SEPARATORS for c in g)}
        assert toxicity.joined(text, patterns, toxicity.Decoder(model)) == [w for g in sorted(want) for w in _lattice(model, g).split()], text


def test_stretches_of_rows(model):
    got = toxicity.suspicious(pa.array(["", "a b c d1 e", "foo a b c", None, "a b", "d e f g oo", "x"]))
    offsets = np.cumsum([0, 0, 10, 9, 0, 3, 10])
    assert [[(a - o, b - o) for a, b in r] for r, o in zip(got[1], offsets, strict=True)] == [[], [(0, 5), (6, 8)], [(0, 3), (4, 9)], [], [], [(0, 7), (8, 10)], []]


def test_noisy_or_moves_credit_to_the_cause():
    rows = np.concatenate([np.arange(20), np.arange(8)])
    features = np.array([0] * 20 + [1] * 8)
    p = toxicity.noisy_or(rows, features, np.array([0.8, 0.5]), np.array([20, 8]), 0.2)
    assert p[0] > 0.6
    assert p[1] < p[0]


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.judge(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    true = sum(r.toxic and r.predicted for r in got)
    assert true / sum(r.predicted for r in got) > 0.8
    assert true / sum(r.toxic for r in got) > 0.7


def test_edges(spark, frame):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id bigint, toxic int")
    rows = [(1, None), (2, ""), (None, "x"), (4, "a" * 50_000), (4, "a" * 50_000), (5, "a b c d e f g h"), (6, "é é é")]
    got = toxicity.judge(frame(rows), labels).collect()
    assert len(got) == 7
    assert all(0 <= r.score <= 1 and r.predicted == 0 for r in got)
    assert toxicity.judge(frame([]), labels).collect() == []
