import random

import brute
import numpy as np
import pytest

from millrace.llm import decontam

ITEMS = [
    (7, "the quick brown fox jumps over the lazy dog while seven wise owls watch quietly from above"),
    (8, "alpha beta gamma"),
    (9, "one two three four five six seven eight nine ten eleven twelve"),
    (10, None),
    (11, ""),
]


def _result(spark, rows, items=ITEMS, **more):
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {r.doc_id: (r.item_id, round(r.coverage, 6), r.contaminated) for r in decontam.overlaps(docs, bench, **more).collect()}


def test_whole_reordered_and_partial(spark):
    rows = [
        (1, "x " + ITEMS[0][1].upper() + " y"),
        (2, "nine ten eleven twelve one two three four five six seven eight zzz eight nine ten eleven twelve"),
        (3, "one two three four five and so on"),
        (4, "six seven eight nine ten eleven twelve one two three four five"),
        (5, "alpha beta gamma delta"),
        (6, None),
        (0, ""),
    ]
    got = _result(spark, rows)
    assert got[1] == (7, 1.0, True)
    assert got[2] == (9, round(8 / 12, 6), True)
    assert got[3] == (9, round(5 / 12, 6), False)
    assert got[4] == (9, 1.0, True)
    assert got[5] == (8, 1.0, True)
    assert got[6] == got[0] == (None, 0.0, False)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_tiles_match_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = "a b c d".split()
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.randrange(3, 25)))) for k in range(6)]
    rows = [(k, " ".join(r.choice(vocab) for _ in range(r.randrange(0, 60)))) for k in range(30)]
    want = {}
    for k, t in rows:
        best = max(((brute.tile_coverage(t, i), -n) for n, i in items), default=(0, 0))
        want[k] = (-best[1], round(best[0], 6), best[0] >= 0.5) if best[0] else (None, 0.0, False)
    assert _result(spark, rows, items) == want


def test_empty_tables(spark):
    rows = [(1, ITEMS[0][1]), (2, ITEMS[2][1])]
    assert _result(spark, [], ITEMS) == {}
    assert _result(spark, rows, []) == {1: (None, 0.0, False), 2: (None, 0.0, False)}


def test_one_pass_over_the_documents_whatever_the_benchmark(spark):
    items = [(k, " ".join(f"v{k}x{j}" for j in range(20))) for k in range(300)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = spark.createDataFrame([(k, t) for k, t in items if k % 3 == 0], "doc_id bigint, text string")
    out = decontam.overlaps(docs, bench)
    assert "MapInArrow" not in out._jdf.queryExecution().toString()  # the pass is done; its findings are a table
    assert {r.doc_id: r.item_id for r in out.collect()} == {k: k for k in range(0, 300, 3)}


def test_running_hashes_of_all_windows():
    r = np.random.default_rng(1)
    words = r.integers(0, 3, 60)
    runs = decontam.Running(words)
    for size in (1, 2, 7, 60):
        at = runs.free(size)
        by = {}
        for p, h in zip(at.tolist(), runs.windows(at, size).tolist(), strict=True):
            assert by.setdefault(tuple(words[p : p + size]), h) == h
        assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("seed", range(8))
def test_tile_matches_brute_force_on_repetitive_words(seed):
    r = random.Random(seed)
    for _ in range(20):
        doc = [r.choice("aab") for _ in range(r.randrange(0, 70))]
        item = [r.choice("aab") for _ in range(r.randrange(1, 30))]
        got = decontam.tile(np.array(["ab".index(x) for x in doc], np.int64), np.array(["ab".index(x) for x in item], np.int64), min(5, len(item)))
        assert got.mean() == pytest.approx(brute.tile_coverage(" ".join(doc), " ".join(item)))


def test_long_repetitive_text_is_tiled_in_bounded_memory():
    import tracemalloc

    doc, item = np.zeros(400_000, np.int64), np.zeros(300, np.int64)
    doc[::6] = 1 + np.arange(doc[::6].size)  # five equal words, then another
    tracemalloc.start()
    assert decontam.tile(doc, item, 5).all()
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()


def test_repeated_rows_null_ids_and_long_texts(spark):
    rows = [(1, ITEMS[0][1]), (1, ITEMS[0][1]), (1, "x"), (None, ITEMS[2][1]), (5, "w " * 50_000 + ITEMS[0][1])]
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame(ITEMS + ITEMS[:1], "item_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.n_items) for r in decontam.overlaps(docs, bench).collect()))
    assert got == [(0, 9, 1), (1, 0, 0), (1, 7, 2), (1, 7, 2), (5, 7, 2)]


def test_texts_without_a_pair_go_before_the_exchange(spark):
    """Also where the pairs are too many to be broadcast."""
    hits = spark.createDataFrame([(f"t{i}", None, b"x") for i in range(300)], "t string, g bigint, raw binary")
    pairs = spark.createDataFrame([("t7", 1), ("t8", 1), ("t8", 2)], "t string, k bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = decontam._texts(hits, pairs)
        plan = own._jdf.queryExecution().optimizedPlan().toString()
        got = sorted(r.t for r in own.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == ["t7", "t8"]
    assert "getbit" in plan.split("first(raw")[1]


def test_extra_columns_are_kept(spark):
    docs = spark.createDataFrame([(1, "a", 5, "b")], "doc_id bigint, text string, coverage int, k0 string")
    bench = spark.createDataFrame([(1, "q w e r t")], "item_id bigint, text string")
    got = decontam.overlaps(docs, bench, keep=["k0"]).collect()
    assert [(r.doc_id, r.k0, r.coverage) for r in got] == [(1, "b", 0.0)]


def test_items_without_id_contaminate(spark):
    items = [(None, ITEMS[0][1]), *ITEMS[1:], (None, ITEMS[2][1])]
    rows = [(1, "x " + ITEMS[0][1]), (2, ITEMS[2][1]), (3, "nothing of it")]
    assert _result(spark, rows, items) == {1: (None, 1.0, True), 2: (9, 1.0, True), 3: (None, 0.0, False)}
