"""L1 hinge selection against a plain solver; representative trees against plain pair counts."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest

from variantlab.operators import explain, model

SCHEMA = "y double, features array<double>"


def plain_hinge(x, s, penalty, steps=60_000):
    x = np.hstack([x, np.ones((len(x), 1))])
    w, rate = np.zeros(x.shape[1]), 1 / (2.2 * np.linalg.eigvalsh(x.T @ x / len(x))[-1])
    for _ in range(steps):
        w = w - rate * (-2 * s * np.maximum(1 - s * (x @ w), 0)) @ x / len(x)
        w[:-1] = np.sign(w[:-1]) * np.maximum(np.abs(w[:-1]) - rate * penalty, 0)
    return w


def test_hinge_is_the_plain_solution(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 4)) * [1, 2, 1, 0.5]
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=150) * 0.7 > 0.2).astype(float)
    rows = [(float(v), [float(z) for z in r]) for v, r in zip(y, x)] + [(None, [0.0] * 4), (1.0, None), (1.0, [1.0]), (0.0, [None, 1.0, 1.0, 1.0]), (0.0, [float("nan")] * 4)]
    df = spark.createDataFrame(rows, SCHEMA)
    w = model.hinge_coefficients(df, "y", [0.0, 1.0], 4, penalty=0.05, tolerance=1e-6)
    want = plain_hinge(x, np.where(y == 1, 1.0, -1.0), 0.05)
    assert w.shape == (1, 5) and np.abs(w[0] - want).max() < 1e-3
    kept = model.selected("hinge", df, target="y", classes=[0.0, 1.0], width=4, exponent=3, penalty=0.05)
    assert kept == [i for i in range(4) if abs(want[i]) > 1e-3] and {0, 1} <= set(kept) < {0, 1, 2, 3}
    assert model.hinge_selection(df.limit(0), "y", [0.0, 1.0], 4, 3) == []


def test_representative_trees(spark):
    rng = np.random.default_rng(2)
    rows = [(s, t, int(rng.integers(3)) if t else s % 2) for s in range(40) for t in range(4) if rng.random() < 0.9] + [(999, 9, 1)]
    df = spark.createDataFrame(rows, "sample long, tree int, leaf int")
    got = {(r.tree_a, r.tree_b): (r.n, r.distance) for r in explain.tree_distances(df, ["sample"]).collect()}
    leaf = {(s, t): x for s, t, x in rows}
    want = {}
    for a, b in combinations(range(4), 2):
        own = [s for s in range(40) if (s, a) in leaf and (s, b) in leaf]
        apart = sum((leaf[i, a] == leaf[j, a]) != (leaf[i, b] == leaf[j, b]) for i, j in combinations(own, 2))
        want[a, b] = (len(own), pytest.approx(apart / (len(own) * (len(own) - 1) / 2)))
    assert got == want
    ranks = explain.representative_trees(explain.tree_distances(df, ["sample"])).orderBy("rank").collect()
    mean = {t: np.mean([d for pair, (_, d) in got.items() if t in pair]) for t in range(4)}
    assert [r.tree for r in ranks] == sorted(mean, key=lambda t: (mean[t], t))


def test_leaves_are_those_of_paths(spark):
    rows = [(i, float(i % 7), [float(i % 7), float(i % 3), float(i)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y double, features array<double>")
    fitted = model.forest(model.vectors(df), "y", 3, 3)
    nodes = explain.node_table(fitted)
    value = {(n[0], n[1]): n[6] for n in nodes}
    found = explain.leaves(df, nodes, ["id"]).collect()
    paths = {(r.id, r.tree): r.prediction for r in explain.decision_paths(df, nodes, ["id"]).collect()}
    assert len(found) == 180 and all(value[r.tree, r.leaf] == paths[r.id, r.tree] for r in found)
