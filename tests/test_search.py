"""Search by similar words against full alignments, plain words and plain local alignments."""

from __future__ import annotations

import random
from collections import Counter
from itertools import product

import numpy as np

from variantlab.functions.expr import RESIDUES
from variantlab.operators import search


def mutated(rng, seq, share, gaps):
    out = [rng.choice(RESIDUES) if rng.random() < share else c for c in seq]
    for _ in range(gaps):
        i = rng.randrange(len(out))
        out[i:i] = rng.choices(RESIDUES, k=rng.randint(1, 4))
        del out[(j := rng.randrange(len(out))) : j + rng.randint(1, 4)]
    return "".join(out)


def full(a, b, gap=8):
    """Smith and Waterman's best score, cell by cell."""
    a, b, best = search.coded(a), search.coded(b), 0
    before = [0] * (len(b) + 1)
    for c in a:
        row = [0]
        for j, d in enumerate(b):
            row.append(max(0, before[j] + int(search._BLOSUM[c, d]), before[j + 1] - gap, row[j] - gap))
        best, before = max(best, *row), row
    return best


def test_similar_words_are_the_plain_ones():
    rng = random.Random(1)
    for _ in range(20):
        word = [rng.randrange(20) for _ in range(3)]
        code = word[0] * 400 + word[1] * 20 + word[2]
        want = {a * 400 + b * 20 + c for a, b, c in product(range(20), repeat=3) if search._BLOSUM[word[0], a] + search._BLOSUM[word[1], b] + search._BLOSUM[word[2], c] >= 11}
        assert set(search.similar(code, 11, 3).tolist()) == want


def test_a_wide_band_is_the_full_alignment():
    rng = random.Random(2)
    for _ in range(40):
        a = "".join(rng.choices(RESIDUES + "X", k=rng.randint(1, 40)))
        b = mutated(rng, a, 0.4, 2) if rng.random() < 0.7 else "".join(rng.choices(RESIDUES, k=rng.randint(1, 40)))
        x, y = search.coded(a), search.coded(b)
        assert search.banded(x, y, rng.randint(-3, 3), 90) == full(a, b)
        for d in (-2, 0, 3):
            own = [int(search._BLOSUM[x[i], y[i + d]]) for i in range(len(x)) if 0 <= i + d < len(y)]
            assert search.ungapped(x, y, d) == max([0, *[sum(own[i:j]) for i in range(len(own)) for j in range(i + 1, len(own) + 1)]])


def test_recall_of_families(spark):
    rng = random.Random(7)
    rows = []
    for f in range(8):
        parent = "".join(rng.choices(RESIDUES, k=120))
        rows += [(f"f{f}m{m}", mutated(rng, parent, 0.35, 1)) for m in range(4)]
    rows += [(f"r{i}", "".join(rng.choices(RESIDUES, k=100))) for i in range(10)] + [("empty", ""), ("null", None), ("short", "MK"), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "id string, s string")
    got = {(r["query"], r["target"]): r.score for r in search.scored_hits(df, df, "id", "s", score=60).collect()}
    named = [(i, s) for i, s in rows if i and s]
    truth = {(a, b): s for a, x in named for b, y in named if a != b and (s := full(x, y)) >= 60}
    assert len(truth) > 60
    assert len(truth.keys() & got.keys()) >= 0.9 * len(truth)
    assert all(s <= truth.get(pair, 0) for pair, s in got.items())  # a band finds no more than all cells
    few = search.scored_hits(df, df, "id", "s", score=60, most=2).groupBy("query").count().collect()
    assert max(r["count"] for r in few) == 2


def test_hot_words_in_cells_count_the_same(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("AW", k=40)) + "".join(rng.choices(RESIDUES, k=20))) for i in range(25)]
    df = spark.createDataFrame(rows, "id long, s string")
    plain = {(r["query"], r["target"], r.diagonal): r.n for r in search.diagonals(df, df, "id", "s", 3, 14).collect()}
    want = Counter()
    for i, a in rows:
        for j, b in rows:
            if i != j:
                x, y = search.coded(a), search.coded(b)
                for p in range(len(x) - 2):
                    for q in range(len(y) - 2):
                        want[i, j, q - p] += int(search._BLOSUM[x[p : p + 3], y[q : q + 3]].sum()) >= 14
    assert plain == {k: n for k, n in want.items() if n}
    monkeypatch.setattr(search, "PLACES", 7)
    assert {(r["query"], r["target"], r.diagonal): r.n for r in search.diagonals(df, df, "id", "s", 3, 14).collect()} == plain
    assert search.scored_hits(df.limit(0), df, "id", "s").collect() == []
    assert np.all(search.coded("é*-") == 20)
