"""Shapley values against sums over all coalitions; sweeps and halvings of a search."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlab.operators import explain, model

WIDTH = 4


def expected(nodes, tree, x, known):
    """A tree's mean prediction where only features in `known` are followed: others split by the training rows' shares."""
    own = {n[1]: n for n in nodes if n[0] == tree}

    def at(i):
        _, _, left, right, f, t, p, _, cover = own[i]
        if left < 0:
            return p
        if f in known:
            return at(left) if x[f] <= t else at(right)
        return (at(left) * own[left][8] + at(right) * own[right][8]) / cover

    return at(0)


def by_coalitions(nodes, weights, x):
    out = np.zeros(WIDTH)
    for i in range(WIDTH):
        rest = [j for j in range(WIDTH) if j != i]
        for k in range(WIDTH):
            for s in combinations(rest, k):
                w = factorial(k) * factorial(WIDTH - 1 - k) / factorial(WIDTH)
                out[i] += w * sum(v * (expected(nodes, t, x, {*s, i}) - expected(nodes, t, x, set(s))) for t, v in enumerate(weights))
    return out


def test_shapley_values_of_forests_and_boosting(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (150, WIDTH)).astype(float)
    y = x[:, 0] * (x[:, 1] > 4) + np.abs(x[:, 2] - 4) - 0.3 * x[:, 3]
    rows = model.vectors(spark.createDataFrame([(i, float(b), a.tolist()) for i, (a, b) in enumerate(zip(x, y))], "id long, y double, features array<double>")).cache()
    for fitted in (model.forest(rows, "y", 3, 4), model.boosted(rows, "y", 4, 3)):
        nodes, weights = explain.node_table(fitted), explain.tree_weights(fitted)
        got = {}
        for r in explain.shapley(rows, nodes, ["id"], weights=weights).collect():
            got.setdefault(r.id, np.zeros(WIDTH))[r.feature] = r.value
        for i in range(0, 150, 10):
            assert got[i] == pytest.approx(by_coalitions(nodes, weights, x[i]), abs=1e-9)
        base = explain.base_value(nodes, weights)
        for r in fitted.transform(rows).collect():
            assert base + got.get(r.id, np.zeros(WIDTH)).sum() == pytest.approx(r.prediction, abs=1e-9)


def test_shapley_of_no_rows_a_missing_value_and_a_single_leaf(spark):
    rows = spark.createDataFrame([(1, [float("nan")]), (2, [0.0])], "id long, features array<double>")
    split = [(0, 0, 1, 2, 0, 0.0, 2.5, 1, 4.0), (0, 1, -1, -1, -1, 0.0, 1.0, 2, 2.0), (0, 2, -1, -1, -1, 0.0, 4.0, 2, 2.0)]
    assert {r.id: r.value for r in explain.shapley(rows, split, ["id"]).collect()} == {1: 1.5, 2: -1.5}
    assert explain.shapley(rows.where("id > 2"), split, ["id"]).count() == 0
    assert explain.shapley(rows, [(0, 0, -1, -1, -1, 0.0, 2.5, 1, 4.0)], ["id"]).count() == 0


def test_decisions_enclose_their_value(spark):
    rows = model.vectors(spark.createDataFrame([(i, float(i % 8), [float(i % 8), float(i % 3)]) for i in range(120)], "id long, y double, features array<double>"))
    fitted = model.forest(rows, "y", 5, 4)
    scored = fitted.transform(rows).withColumnRenamed("prediction", "p")
    paths = explain.decision_paths(scored, explain.node_table(fitted), ["id"], target="p")
    found = explain.explained(paths, ["id"], "p").collect()
    for r in found:
        value = float(r.id % 8 if r.feature == 0 else r.id % 3)
        assert (r.below is None or r.below <= value) and (r.above is None or value < r.above) and (r.below, r.above) != (None, None)
    assert {r.feature for r in found} == {0, 1} and len({r.id for r in found}) == 120


def test_sweeps_meet_all_points_of_a_grid_once():
    search = model.Search({"a": (0.0, 4.0), "b": (0.0, 4.0), "c": (0.0, 4.0)}, frozenset({"a"}))
    best = search.sweep(lambda p: -abs(p["a"] - 3) - abs(p["b"] - 1) - abs(p["c"] - 2), {"a": 0.0, "b": 0.0, "c": 2.0}, ["a", "b"], 5)
    assert best == ({"a": 3.0, "b": 1.0, "c": 2.0}, 0.0) and len(search.seen) == 25
    search.sweep(lambda p: 0.0, {"a": 0.0, "b": 0.0, "c": 2.0}, "a", 5)
    assert len(search.seen) == 25


def test_halves_go_down_to_single_parameters():
    tried = []

    def objective(p):
        tried.append(p)
        return -sum((v - 0.5) ** 2 for v in p.values())

    search = model.Search({k: (0.0, 1.0) for k in "abcd"})
    best, value = search.halved(objective, dict.fromkeys("abcd", 0.0), 5)
    assert len(tried) == len(search.seen) == 1 + 7 * 5
    assert set(best) == set("abcd") and value > -0.5


def test_shuffled_groups_until_nothing_improves():
    search = model.Search({k: (0.0, 1.0) for k in "abc"})
    best, value = search.until_settled(lambda p: -sum((v - 0.5) ** 2 for v in p.values()), dict.fromkeys("abc", 0.0), 6)
    assert value == max(v for _, v in search.seen) and value > -0.2
    assert search.until_settled(lambda p: 0.0, best, 2)[1] == 0.0
