import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing

PATH = public_tokenizers.path(packing.VOCABULARY)


def _ids(text):
    t = Tokenizer.from_file(PATH)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, packing.END], "<u4")


@pytest.mark.parametrize(
    "text",
    ["", "Hello, World's end!", "it's they'LL we've", "ÀÉ é é ﬁ Σς ΑΣ", "a b c\u0085d", "x\x1cy \x1f!z", "<|endoftext|> <|startoftext|>", "a <|endoftext|>b", "<|ENDOFTEXT|> <|x|> <|", "1234 ab12cd", "日本語 テスト", "a\x00b\x7f c\u00a0d", "word " * 500, "!" * 300, "İstanbul"],
)
def test_ids_equal_the_tokenizers(text):
    got = packing.WordTokenizer(PATH).ids(pa.array([text, "other words", "", text]))
    assert [x.tolist() for x in got] == [_ids(t)[:-1].tolist() for t in (text, "other words", "", text)]


def test_words_with_other_signs_around_are_encoded_once():
    words, marks = ["".join(random.Random(k).choices("abcdeé", k=7)) for k in range(40)], [".", ",", "!!", "(%s)", "1", "###", "[%s]", "-"]
    text = " ".join(m % w if "%" in m else w + m for w in words for m in marks)
    tokenizer = packing.WordTokenizer(PATH)
    assert tokenizer.ids(pa.array([text]))[0].tolist() == _ids(text)[:-1].tolist()
    assert tokenizer.hashes.size <= 40 + 10  # not 40 * 8


@pytest.mark.parametrize("seed", range(4))
def test_words_are_parted_as_the_tokenizer_does(seed):
    r = random.Random(seed)
    signs = [*"abSTé×÷ÃßŒж日Σσİﬁ'’.!=<>|1٣²_\x00\x7f\x1d\u0301\u0338\u0345\u00a0\u00aa\u0085 ", "'s", "'LL", "'", "'re", "e\u0301", "=\u0338", "<|", "<|endoftext|>"]
    texts = ["".join(r.choices(signs, k=r.randrange(1, 9))) for _ in range(1500)]
    got = packing.WordTokenizer(PATH).ids(pa.array(texts))
    whole = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_remembered_words_take_little_memory():
    import tracemalloc

    r = random.Random(3)
    tokenizer = packing.WordTokenizer(PATH)
    tracemalloc.start()
    for size in (9, 9, 9, 80):  # words of over LONG bytes are not remembered at all
        for _ in range(3):
            tokenizer.ids(pa.array([" ".join("".join(r.choices("abcdefghij", k=size)) for _ in range(1_000_000 // size // 4))]))
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert tokenizer.hashes.size > 200_000
    assert kept < 30_000_000


@pytest.mark.parametrize(("words", "ids"), [(40, 10_000), (10_000, 90), (3, 2), (0, 0)])
def test_ids_do_not_depend_on_what_is_remembered(monkeypatch, words, ids):
    monkeypatch.setattr(packing, "REMEMBER", words)
    monkeypatch.setattr(packing, "MOST_IDS", ids)
    r = random.Random(7)
    tokenizer = packing.WordTokenizer(PATH)
    some = ["Alpha", "alpha", "é!", "x1", "l" * 70, "日本", *["".join(r.choices("abcXY'", k=r.randrange(1, 9))) for _ in range(60)]]
    for _ in range(12):
        texts = [" ".join(r.choices(some, k=r.randrange(0, 30))) for _ in range(4)]
        assert [x.tolist() for x in tokenizer.ids(pa.array(texts))] == [_ids(t)[:-1].tolist() for t in texts]
        assert tokenizer.hashes.size <= words and tokenizer.ids_of.size <= ids
        assert (tokenizer.hashes[1:] > tokenizer.hashes[:-1]).all()


def _packed(df, length):
    return packing.pack_documents(df, length=length).collect()


def _valid(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= length
    return len(by)


def test_pieces_and_sequences(frame):
    r = random.Random(4)
    docs = [(i, " ".join(r.choice(["alpha", "be", "gamma!", "d"]) for _ in range(r.randrange(0, 90)))) for i in range(150)] + [(500, None), (501, ""), (502, "a"), (502, "a"), (None, "b")]
    rows = _packed(frame(docs), 64)
    used = _valid(rows, 64)
    assert used <= -(-sum(x.length for x in rows) // 64) + 1
    got = sorted((x.doc_id if x.doc_id is not None else -1, x.piece, x.start, x.length, x.ids_crc32) for x in rows)
    want = []
    for k, t in docs:
        ids = _ids(t)
        want += [(k if k is not None else -1, n, at, len(ids[at : at + 64]), zlib.crc32(ids[at : at + 64].tobytes())) for n, at in enumerate(range(0, len(ids), 64))]
    assert got == sorted(want)


def _optimum(sizes, length):
    """Fewest bins, by trying all partitions into bins."""
    best = len(sizes)

    def walk(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                walk(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        walk(k + 1, [*rooms, length - sizes[k]])

    walk(0, [])
    return best


def test_blocks_shrink_and_elites_migrate(spark, frame):
    docs = [(i, "word " * (i % 50)) for i in range(300)]
    table = packing.pieces(frame(docs), PATH, 64)
    report = []
    rows = packing.pack(table, 64, block=32, report=report).collect()
    assert len(rows) == table.count()
    assert _valid(rows, 64) <= -(-sum(x.length for x in rows) // 64) + 2
    blocks = [r["blocks"] for r in report if r["epoch"] == 0]
    assert blocks == sorted(blocks, reverse=True) and len(blocks) > 1
    assert all(r["crossovers"] > 0 for r in report)


@pytest.mark.parametrize(("low", "high"), [(33, 33), (22, 29)])
def test_pieces_that_fill_no_sequence_together(spark, low, high):
    rows = [(i, 0, 0, low + i % (high - low + 1), 0) for i in range(200)]
    report = []
    got = packing.pack(spark.createDataFrame(rows, packing.PIECES), 64, block=32, report=report).collect()
    assert {r["round"] for r in report} == {1, 2}
    assert _valid(got, 64) == (200 if low > 32 else 100)


def test_elite_replaces_the_neighbours_worst(spark):
    good, bad = [[0, 3], [1, 2]], [[0], [1], [2], [3]]
    sizes = [54, 44, 20, 10]
    rows = [(0, k, [1, 2, 3, 4], sizes, [packing._packing(b, 4)], len(b), 2, 0, 0) for k, b in enumerate((good, bad))]
    ring = {r.island: r for r in packing._ring(spark.createDataFrame(rows, packing.ISLAND)).collect()}
    assert ring[1].guest == packing._packing(good, 4) and ring[0].guest == packing._packing(bad, 4)
    population, _ = packing.evolve(sizes, 64, 1, [packing._bins(p) for p in (ring[1].packings[0], ring[1].guest)])
    assert len(population[0]) == 2


@pytest.mark.parametrize("seed", range(6))
def test_search_finds_the_optimum_of_small_inputs(seed):
    r = random.Random(seed)
    for _ in range(5):
        sizes = sorted((r.randrange(15, 70) for _ in range(r.randrange(1, 12))), reverse=True)
        population, crossovers = packing.evolve(sizes, 100, seed)
        assert crossovers > 0
        assert sorted(i for b in population[0] for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in population[0])
        assert len(population[0]) == _optimum(sizes, 100)


def test_search_is_at_least_as_good_as_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(20):
        sizes = sorted((r.randrange(20, 60) for _ in range(60)), reverse=True)
        population, _ = packing.evolve(sizes, 100)
        assert len(population[0]) <= len(packing.best_fit(list(range(60)), sizes, [], 100))


@pytest.mark.parametrize("change", [packing.crossover, lambda a, _, *rest: packing.mutate(a, *rest)])
def test_changes_keep_every_piece_once(change):
    r = random.Random(2)
    sizes = sorted((r.randrange(1, 50) for _ in range(80)), reverse=True)
    mixed = [packing.Packing.of(packing.best_fit(r.sample(range(80), 80), sizes, [], 60), sizes) for _ in range(2)]
    child = change(*mixed, sizes, 60, r).bins
    assert sorted(i for b in child for i in b) == list(range(80))
    assert all(sum(sizes[i] for i in b) <= 60 for b in child)


def test_empty_table(frame):
    assert _packed(frame([]), 64) == []
