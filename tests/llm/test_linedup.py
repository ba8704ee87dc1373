import hashlib
import random

import brute
import pytest

from millrace.llm import linedup


def _result(df, least):
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in linedup.dedup_lines(df, least).collect()}


@pytest.mark.parametrize(("seed", "least"), [(1, 5), (2, 12), (3, 40)])
def test_runs_match_brute_force(frame, seed, least):
    r = random.Random(seed)
    lines = ["w " * r.randrange(0, 9) + str(i) for i in range(6)] + [""]
    rows = [(i, "\n".join(r.choice(lines) for _ in range(r.randrange(0, 30)))) for i in range(40)]
    assert _result(frame(rows), least) == brute.dedup_lines(rows, least)


def test_long_passage_goes_from_later_documents_only(frame):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"a b\n{passage}\nc"), (2, f"{passage}\nd e"), (3, "All rights reserved.\nf"), (4, "All rights reserved.\ng"), (5, passage)]
    got = _result(frame(rows), linedup.MIN_WORDS)
    assert got[1] == (3, 0, rows[0][1])
    assert got[2] == (2, 1, "d e")
    assert got[3][1] == got[4][1] == 0
    assert got[5] == (1, 1, "")


def _plain_lpf(lines, places):
    """Longest prefix of each suffix that an earlier one shares, within lists of lines by document."""
    out = {}
    for d, i in places:
        best = 0
        for e, j in places:
            if (e, j) < (d, i):
                n = 0
                while i + n < len(lines[d]) and j + n < len(lines[e]) and lines[d][i + n] == lines[e][j + n]:
                    n += 1
                best = max(best, n)
        out[(d, i)] = best
    return out


@pytest.mark.parametrize("seed", range(5))
def test_array_prefixes_and_intervals_match_brute_force(spark, monkeypatch, seed):
    """The suffix array's order, its common prefixes, and the intervals over several partitions."""
    r = random.Random(seed)
    docs = [[r.choice("abc") for _ in range(r.randrange(1, 25))] for _ in range(12)]
    monkeypatch.setattr(linedup, "PIECE", 2)
    monkeypatch.setattr(linedup, "GROW", 2)
    df = spark.createDataFrame([(d, 0, "\n".join(x)) for d, x in enumerate(docs)], "did bigint, th bigint, text string")
    places, first = linedup._segments(df, 0)
    last = linedup._ranks(first)
    ranges = type(df).repartitionByRange
    monkeypatch.setattr(type(df), "repartitionByRange", lambda self, *by: ranges(self, 5, *by))
    shared = linedup._shared(linedup._neighbours(last, first), first, 0)
    rows = shared.orderBy("o").collect()
    assert len({x.o >> 33 for x in rows}) > 2
    place = {x.pos: (x.did, x.i) for x in places.collect()}
    assert [place[k] for k in sorted(place)] == sorted(place.values())
    ends = {place[x.pos]: place[x.end][1] for x in first.collect()}
    order = [place[x.pos] for x in rows]
    rank = {key: k for k, key in enumerate(sorted({line for x in docs for line in x}, key=lambda c: hashlib.md5(c.encode()).digest()))}
    content = {(d, i): [rank[c] for c in docs[d][i : e + 1]] for (d, i), e in ends.items()}
    assert order == sorted(content, key=lambda p: (content[p], p))
    for a, b, x in zip(order, order[1:], rows[1:], strict=False):
        n = 0
        while n < min(len(content[a]), len(content[b])) and content[a][n] == content[b][n]:
            n += 1
        assert x.l == n
    found = {place[x.pos]: x.m for x in linedup._later(shared).collect()}
    assert {p: found.get(p, 0) for p in order} == _plain_lpf(docs, order)


def test_copies_lose_all_lines_and_short_ones_stay(frame):
    long, short = "\n".join(f"w{i} " * 9 for i in range(8)), "a few words\nof text"
    rows = [(4, long), (9, long), (2, long), (3, short), (8, short), (11, long + "\nmore"), (12, "x\n" + long)]
    got = _result(frame(rows), linedup.MIN_WORDS)
    assert got == brute.dedup_lines(rows)
    assert got[2][1] == 0 and got[4] == got[9] == (8, 8, "") and got[8][1] == 0 and got[11] == (9, 8, "more")


def test_edge_rows(frame):
    rows = [(1, None), (2, ""), (3, "\n\n"), (None, "x " * 60), (7, "x " * 60), (7, "x " * 60)]
    got = sorted((r.doc_id or -1, r.n_lines, r.n_removed) for r in linedup.dedup_lines(frame(rows)).collect())
    assert got == [(-1, 1, 0), (1, 1, 0), (2, 1, 0), (3, 3, 0), (7, 1, 1), (7, 1, 1)]
    assert linedup.dedup_lines(frame([])).collect() == []
