import random

import brute
import numpy as np
import pytest

from millrace.llm import neardup


def _docs(seed, n=120, words=40):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    base = [r.choice(vocab) for _ in range(words)]
    for i in range(n):
        kind = r.random()
        if kind < 0.6:  # versions of one text, some far from it
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4])):
                t[r.randrange(len(t))] = r.choice(vocab)
        elif kind < 0.7:
            t = base[: r.randrange(0, 8)]
        else:
            t = [r.choice(vocab) for _ in range(r.randrange(1, 60))]
        rows.append((i * 3, r.choice([" ", "\n", "\t "]).join(t)))
    return rows


def _check(frame, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(frame(rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_components_match_brute_force(frame):
    _check(frame, _docs(1))


def test_large_families_are_split_without_losing_links(frame, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    _check(frame, _docs(2, 200))


@pytest.mark.parametrize("seed", [3, 4])
def test_split_families_keep_every_link(frame, monkeypatch, seed):
    """Texts that share a template, of many sizes, with near copies among them."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(neardup, "PIVOTS", 1)
    r = random.Random(seed)
    template, rows = [f"t{i}" for i in range(60)], []
    for i in range(90):
        own = [f"o{i}x{j}" for j in range(r.randrange(0, 30))]
        rows.append((i, " ".join(template[: r.randrange(45, 60)] + own)))
    for i in range(90, 130):
        words = rows[r.randrange(90)][1].split()
        words[r.randrange(len(words))] = f"n{i}"
        rows.append((i, " ".join(words[r.randrange(0, 3) :])))
    _check(frame, rows)


def test_template_families_cost_in_proportion(spark, monkeypatch):
    """Rows with full text that the rounds read, of one family without a link."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    read = {}
    for n in (200, 800):
        rows = [(i, " ".join([f"t{j}" for j in range(60)] + [f"o{i}x{j}" for j in range(12)])) for i in range(n)]
        members = spark.createDataFrame([(0, n, i, t) for i, t in rows], "family bigint, n bigint, node bigint, text string")
        none = spark.createDataFrame([], "node bigint, label bigint")
        second = neardup._second_round(members, none)
        read[n] = neardup._first_round(members).count() + (0 if second is None else second.count())
    assert read[800] < 5 * read[200]


def test_rare_shingles_give_one_row_each(spark):
    """Not one for each class of partners: a text gives less than a third of its shingles."""
    rows = [(1, 0, 1, i, " ".join([f"t{j}" for j in range(50)] + [f"o{i}x{j}" for j in range(i % 40)])) for i in range(80)]
    groups = spark.createDataFrame(rows, "family bigint, ab int, kind int, node bigint, text string")
    made = {r.node: r["count"] for r in neardup._prefixes(groups, None).groupBy("node").count().collect()}
    assert made.keys() == set(range(80))
    assert all(3 * made[i] <= 46 + i % 40 for i in made)


def test_edge_rows(frame):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "x" * 30000), (8, "é É"), (9, "é é")]
    _check(frame, rows)


def test_null_and_repeated_ids(frame):
    text = "a b c d e f g h"
    rows = [(5, text), (5, text), (9, text), (None, text), (3, "q w e r t y"), (3, text)]
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(frame(rows)).collect())
    assert got == [(-1, -1, True), (3, 3, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False)]


def test_empty_table(frame):
    assert neardup.near_duplicates(frame([])).collect() == []


@pytest.mark.parametrize("similarity", [0.6, 0.75, 0.9])
def test_sketch_estimates_similarity(similarity):
    r = np.random.default_rng(3)
    found = []
    for _ in range(40):
        shared = r.integers(0, 1 << 60, 1000).astype(np.uint64)
        extra = int(1000 * (1 / similarity - 1) / 2)
        sets = [np.sort(np.concatenate([shared, r.integers(0, 1 << 60, extra).astype(np.uint64)])) for _ in range(2)]
        s = neardup.odd_sketch(neardup.minhash(np.concatenate(sets), np.array([0, sets[0].size, sets[0].size + sets[1].size])))
        found.append(float(neardup.similarity(np.bitwise_count(s[0] ^ s[1]).sum())))
    assert abs(np.mean(found) - similarity) < 0.03
    assert min(found) > similarity - 0.25
