import brute
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import tokencount

TEXTS = ["one line only", "a b\nc d\n", "\n\n\n", "x\n\n  y \n\n\nz", "tail\n\n", "é ü\n日本語 テキスト\n🙂 ok", "", None, "w " * 5000 + "\n" + "v"]


@pytest.mark.parametrize("rule", ["first", "last"])
def test_counts_match_the_tokenizers_offsets(frame, rule):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    got = {}
    for r in tokencount.section_counts(frame(list(enumerate(TEXTS))), rule=rule).orderBy("doc_id", "section").collect():
        got.setdefault(r.doc_id, []).append(r.n_tokens)
    plain = [k for k, x in enumerate(TEXTS) if "🙂" not in (x or "") and "日" not in (x or "")]  # spans of whole characters
    for k in plain:
        spans = t.encode(TEXTS[k] or "", add_special_tokens=False).offsets
        assert got[k] == brute.section_counts(TEXTS[k], spans, rule), k
    for k, x in enumerate(TEXTS):
        assert sum(got[k]) == len(t.encode(x or "", add_special_tokens=False).ids)


def test_rules_on_a_crossing_token():
    import numpy as np

    ends, bounds = np.array([2, 9, 10]), np.array([3, 5, 10])
    assert tokencount.attribute(ends, bounds, "first")[0].tolist() == [2, 0, 1]
    assert tokencount.attribute(ends, bounds, "last")[0].tolist() == [1, 0, 2]
    assert tokencount.attribute(ends, bounds, "most")[0].tolist() == [1, 0, 2]
    assert tokencount.attribute(ends, bounds, "most")[1].tolist() == [0, 0, 1]


def test_rule_most_matches_brute_force():
    import numpy as np

    r = np.random.default_rng(2)
    for _ in range(200):
        ends = np.unique(r.integers(1, 40, r.integers(1, 15)))
        bounds = np.append(np.unique(r.integers(1, ends[-1] + 1, r.integers(0, 6))), ends[-1])
        bounds = np.unique(bounds)
        want = [0] * bounds.size
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            shares = [sum(lo <= x < hi for x in range(a, b)) for lo, hi in zip([0, *bounds[:-1]], bounds, strict=True)]
            want[shares.index(max(shares))] += 1
        assert tokencount.attribute(ends, bounds, "most")[0].tolist() == want


def test_fields(spark):
    df = spark.createDataFrame([(1, "A title", "Some body text.\nMore", None), (2, None, "", "x")], "doc_id bigint, text string, body string, note string")
    got = [(r.doc_id, r.section, r.start, r.end) for r in tokencount.field_counts(df, ["text", "body", "note"]).orderBy("doc_id", "section").collect()]
    assert got == [(1, 0, 0, 8), (1, 1, 8, 29), (1, 2, 29, 29), (2, 0, 0, 1), (2, 1, 1, 2), (2, 2, 2, 3)]


def test_edges(frame):
    got = [(r.doc_id, r.section, r.n_tokens) for r in tokencount.section_counts(frame([(None, "a"), (3, "b"), (3, "b")])).collect()]
    assert sorted(got, key=str) == [(3, 0, 1), (3, 0, 1), (None, 0, 1)]
    assert tokencount.section_counts(frame([])).collect() == []
    with pytest.raises(ValueError, match="rule"):
        tokencount.section_counts(frame([]), rule="middle")
