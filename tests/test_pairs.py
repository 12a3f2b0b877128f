"""Rank correlations of features with NULLs against ranks taken pair by pair; mean distances of any power against all differences."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from variantlab.operators import distances, pairs, select, splits

SCHEMA = "id string, feature string, value double"


def plain(rows):
    wide = pd.DataFrame(rows, columns=["id", "f", "v"]).set_index(["id", "f"])["v"].unstack()
    out = {}
    for a, b in combinations(sorted(wide.columns), 2):
        both = wide[[a, b]].dropna()
        if len(both):
            x, y = both[a].rank(), both[b].rank()
            fit = x.nunique() > 1 and y.nunique() > 1
            out[a, b] = (len(both), np.corrcoef(x, y)[0, 1] if fit else None)
    return out


def made(seed, samples, features, missing, levels):
    """Samples of features, of which some are complete, some have few values, and one value has most rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for j in range(features):
        v = rng.normal(size=samples) if j % 3 else rng.integers(0, levels, samples) * 1.0
        v[rng.random(samples) < (0.7 if j % 4 == 0 else 0)] = -0.0
        for i in range(samples):
            gone = j % 5 and rng.random() < missing
            rows.append((f"s{i}", f"f{j:03d}", None if gone else float(v[i])))
    return rows


@pytest.mark.parametrize("samples,features,missing,levels,numbers", [(150, 7, 0.3, 3, 1 << 22), (60, 70, 0.2, 4, 500), (40, 5, 0.9, 2, 40), (30, 4, 0.0, 3, 1)])
def test_pairs_with_nulls(spark, monkeypatch, samples, features, missing, levels, numbers):
    """Also with slices so small that ties of a value lie in several, and products sample by sample."""
    monkeypatch.setattr(pairs, "NUMBERS", numbers)
    rows = made(samples, samples, features, missing, levels)
    got = pairs.pair_ranks(spark.createDataFrame(rows, SCHEMA).where("value is not null").withColumnRenamed("value", "v"), "id", "feature").collect()
    want = plain([r for r in rows if r[2] is not None])
    assert {(r.feat_a, r.feat_b): r.n_both for r in got} == {k: n for k, (n, _) in want.items()}
    for r in got:
        assert r.corr == (None if want[r.feat_a, r.feat_b][1] is None else pytest.approx(want[r.feat_a, r.feat_b][1], abs=1e-9))


def test_odd_cells(spark):
    """NaN is the largest value and equals itself; NULL samples and features don't count; empty tables give no pair."""
    nan = float("nan")
    rows = [(f"s{i}", f, v) for f, vs in {"a": [1.0, nan, nan, 2.0, 0.0], "b": [1.0, 4.0, 4.0, 2.0, None], "c": [3.0] * 5}.items() for i, v in enumerate(vs)]
    rows += [(None, "a", 5.0), ("s0", None, 1.0), ("s9", "d", None)]
    got = {(r.feat_a, r.feat_b): r for r in select.pair_statistics(spark.createDataFrame(rows, SCHEMA), "id").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert got["a", "b"].corr == pytest.approx(1.0) and got["a", "c"].corr is None
    assert got["a", "b"].cov_a == pytest.approx(5 / 6) and got["a", "b"].cov_both == pytest.approx(4 / 5)
    assert select.pair_statistics(spark.createDataFrame([], SCHEMA), "id").collect() == []


def spread(kind, n, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "even":
        return rng.random(n)
    if kind == "tailed":
        return np.exp(rng.normal(size=n) * 4)
    return np.concatenate([rng.normal(size=n // 2) * 1e-9, rng.normal(size=n - n // 2) * 50 - 7, [1e6]])


@pytest.mark.parametrize("kind,power", [("even", 0.5), ("tailed", 3.0), ("tailed", 0.3), ("clustered", 1.5), ("clustered", 4.0)])
def test_mean_powers(spark, monkeypatch, kind, power):
    """Also where levels are many, as leaves hold few targets."""
    monkeypatch.setattr(distances, "LEAF", 8)
    others = np.round(spread(kind, 900), 12)
    others = np.concatenate([others, np.repeat(others[:3], 400)])
    values = np.concatenate([others[::2], spread(kind, 50, 1)])
    df = spark.createDataFrame([(float(x),) for x in others], "t double")
    counts = df.groupBy("t").count().withColumnRenamed("count", "_n")
    asked = spark.createDataFrame([(float(x),) for x in np.unique(values)], "t double")
    got = {r.t: r.weight for r in distances.mean_powers(asked, counts, "t", power).collect()}
    assert len(got) == len(np.unique(values))
    for x, w in got.items():
        assert w == pytest.approx(np.mean(np.abs(x - others) ** power), rel=1e-8)


def test_odd_targets(spark):
    """NULL has no row; targets that aren't finite have no weight; one target has weight 0; decimals stay decimals."""
    df = spark.createDataFrame([(v,) for v in (1.0, 1.0, 5.0, None, float("nan"), float("inf"))], "t double")
    got = {str(r.t): r.weight for r in splits.distance_weights(df, "t", 0.5).collect()}
    assert got == {"1.0": pytest.approx(2 / 3), "5.0": pytest.approx(4 / 3), "nan": None, "inf": None}
    assert [tuple(r) for r in splits.distance_weights(df.where("t = 1"), "t", 3.0).collect()] == [(1.0, 0.0)]
    assert splits.distance_weights(df.where("t = 2"), "t", 3.0).collect() == []
    exact = splits.distance_weights(df.where("t < 6").selectExpr("cast(t as decimal(15,2)) as t"), "t", 0.5)
    assert exact.schema["t"].dataType.simpleString() == "decimal(15,2)" and {str(r.t) for r in exact.collect()} == {"1.00", "5.00"}


def test_powers_beyond_doubles(spark):
    """A mean that no double holds is infinite."""
    df = spark.createDataFrame([(0.0,), (1e200,)], "t double")
    assert {r.weight for r in splits.distance_weights(df, "t", 3.0).collect()} == {float("inf")}
