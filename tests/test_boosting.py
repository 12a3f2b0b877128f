"""Histogram boosting against plain splits, MLlib, folds trained one by one, and on odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlab.operators import boosting, model, stats
from variantlab.operators.boosting import MISSING, Run, Settings

SMALL = Settings(rounds=6, depth=3, bins=8, patience=2, store=2, sliced=False)
SCHEMA = "id long, y double, w double, grp long, fold int, features array<double>"


def made(n=400, seed=1, missing=0.1, categories=6):
    """Targets that follow a step of feature 0, a category in feature 1 in no order, and whether feature 2 is missing."""
    rng = np.random.default_rng(seed)
    effect = rng.permutation(categories)
    rows = []
    for i in range(n):
        x = [float(rng.normal()), float(rng.integers(categories)), float(rng.normal()), float(rng.normal())]
        y = 2.0 * (x[0] > 0.3) + effect[int(x[1])] + rng.normal() * 0.1
        if rng.random() < missing:
            x[2] = None
            y += 3.0
        rows.append((i, float(y), 1.0 + i % 3, i % 5, i % 3, x))
    return rows


def plain_best(x, y, w, base, bins, categorical, l2=1.0):
    """The best split by trying all of them."""
    b = bins.of(x)
    g, best = (base - y) * w, None
    for f in range(x.shape[1]):
        own = [v for v in sorted(set(b[:, f])) if v != MISSING]
        if f in categorical:
            own.sort(key=lambda v: (g[b[:, f] == v].sum() / (w[b[:, f] == v].sum() + l2), v))
        for k in range(len(own)):
            for left_missing in (False, True) if (b[:, f] == MISSING).any() else (False,):
                left = np.isin(b[:, f], own[: k + 1]) | (left_missing & (b[:, f] == MISSING))
                if left.all() or not left.any() or min(w[left].sum(), w[~left].sum()) < 1:
                    continue
                gain = sum(g[s].sum() ** 2 / (w[s].sum() + l2) for s in (left, ~left)) - g.sum() ** 2 / (w.sum() + l2)
                if best is None or round(gain, 9) > round(best[0], 9):
                    best = gain, f, set(np.flatnonzero(left).tolist())
    return best


@pytest.mark.parametrize("seed", range(2))
def test_first_split_is_the_plain_one(spark, seed):
    rows = made(150, seed)
    df = spark.createDataFrame(rows, SCHEMA)
    categorical = frozenset({1})
    bins = boosting.bins_of(df, 4, 8, categorical)
    x = np.array([[np.nan if v is None else v for v in r[5]] for r in rows])
    y, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    own = boosting.binned(df, bins, ["id"], "y", "grp", "fold", "w")
    found = boosting.boosted(own, bins, [Run(None)], Settings(rounds=1, depth=1))[0]
    gain, feature, left = plain_best(x, y, w, found.base, bins, categorical)
    tree = found.trees[0]
    assert tree.feature[0] == feature and abs(tree.gain[0] - gain) < 1e-6 * gain
    assert set(np.flatnonzero(tree.goes[0][bins.of(x)[:, feature]]).tolist()) == left
    assert tree.cover[1] == len(left) and tree.cover[2] == len(rows) - len(left)


def test_categories_in_no_order_take_one_split(spark):
    rows = [(i, float(i % 6 in (0, 3, 4)), 1.0, i % 2, 0, [float(i % 6)]) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    for categorical, depth, exact in ((frozenset({0}), 1, True), (frozenset(), 1, False)):
        bins = boosting.bins_of(df, 1, 8, categorical)
        run = boosting.boosted(boosting.binned(df, bins, ["id"], "y", "grp", None), bins, [Run(None)], Settings(rounds=1, depth=depth, rate=1.0, l2=0.0))[0]
        out = boosting.model_of(run, bins).predicted(df).where(F.abs(F.col("prediction") - F.col("y")) > 1e-6).count()
        assert (out == 0) is exact


def test_folds_side_by_side_are_folds_one_by_one(spark):
    df = spark.createDataFrame(made(300), SCHEMA)
    bins = boosting.bins_of(df, 4, SMALL.bins, frozenset({1}))
    rows = boosting.binned(df, bins, ["id"], "y", "grp", "fold", "w")
    settings = Settings(rounds=3, depth=2, bins=8, patience=2, store=2, rows=0.8, features=0.5, sliced=False)
    together = boosting.boosted(rows, bins, [Run(f, k) for k in range(2) for f in range(2)], settings)
    for r in (together[0], together[3]):
        alone = boosting.boosted(rows, bins, [Run(r.fold, r.repeat)], settings)[0]
        assert len(alone.trees) == len(r.trees) and np.allclose(alone.objectives, r.objectives, atol=1e-9)
        for a, b in zip(alone.trees, r.trees):
            assert a.feature == b.feature and np.allclose(a.value, b.value)
    assert any(a.trees[0].feature != b.trees[0].feature or a.trees[0].value != b.trees[0].value for a, b in zip(together[:2], together[2:]))


def test_objective_is_not_above_mllibs(spark):
    df = spark.createDataFrame(made(600, 5, missing=0.0), SCHEMA)
    found = boosting.cross_validated(df, ["id"], "y", "grp", "fold", 1, 4, Settings(rounds=12, depth=3, rate=0.3, bins=16, patience=12, store=5, sliced=False), categorical=frozenset({1}), final=False)
    fitted = model.boosted(model.vectors(df.where("fold <> 0")), "y", 12, 3, 0.3)
    scored = fitted.transform(model.vectors(df.where("fold = 0")))
    theirs = stats.rank_objective(stats.group_spearman(scored, ["grp"], "y", "prediction")).first().objective
    assert found.objectives()[0] <= theirs + 1e-9
    own = boosting.out_of_fold(df, found, "fold")
    mine = stats.rank_objective(stats.group_spearman(own, ["grp"], "y", "prediction")).first().objective
    assert abs(mine - found.objectives()[0]) < 1e-9


def test_stops_early_and_keeps_the_best(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), None, i % 4, i % 2, [float(rng.normal())]) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = boosting.cross_validated(df, ["id"], "y", "grp", "fold", 2, 1, Settings(rounds=30, depth=2, patience=2, bins=8, sliced=False), weight="w")
    for r in found.runs:
        assert len(r.objectives) < 30 and len(r.trees) == r.best and min(r.objectives) > r.objectives[r.best - 1] - 2e-4
    assert found.final is not None and len(found.final.trees) >= 1
    stopped = boosting.cross_validated(df, ["id"], "y", "grp", "fold", 2, 1, Settings(rounds=30, depth=2, patience=1, bins=8), best_first=5.0, final=False)
    assert not stopped.runs[0].live and len(stopped.runs[1].objectives) <= len(stopped.runs[0].objectives)


def test_two_rounds_drop_what_hurts(spark):
    df = spark.createDataFrame(made(300, missing=0.0, categories=2), SCHEMA)
    fitted, kept = boosting.two_rounds(df, ["id"], "y", "grp", "fold", 0, 4, SMALL, SMALL)
    assert {0, 1} <= set(kept)
    narrow = df.withColumn("k", F.array(*[F.get("features", i) for i in kept]))
    assert fitted.predicted(narrow, "k").where("prediction is null").count() == 0
    assert sum(g for _, g in fitted.gains()) == pytest.approx(1.0)


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0, [1.0]), (2, 1.0, 1.0, 1, None, None), (3, float("nan"), 1.0, 1, 1, [1.0]), (4, 2.0, 1.0, None, 1, [float("nan"), 5.0, 9.0]), (4, 2.0, 1.0, None, 1, []), (None, 0.0, 0.0, 1, 0, [None, 1.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"grp": "bins"})
    found = boosting.cross_validated(df, ["id"], "y", "bins", "fold", 2, 2, SMALL)
    assert found.final.predicted(df).count() == len(rows)
    empty = boosting.cross_validated(df.limit(0), ["id"], "y", "bins", "fold", 2, 2, SMALL, categorical=frozenset({1}))
    assert [r.p for r in empty.final.predicted(df, name="p").collect()] == [0.0] * len(rows)
