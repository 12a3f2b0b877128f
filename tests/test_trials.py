"""Runs of studies beside the best run before them, against a plain loop."""

from __future__ import annotations

import random
from itertools import groupby

import pytest

from variantlab.operators import report

SCHEMA = "study string, run int, fold int, score double, full_score string"


def plain(rows, larger):
    out, sign = {}, 1 if larger else -1
    rows = sorted(r[:4] for r in rows if None not in r[:4] and r[3] == r[3])
    for study, own in groupby(rows, key=lambda r: r[0]):
        best = None
        for run, folds in groupby(own, key=lambda r: r[1]):
            scores = [r[3] for r in folds]
            first, full = scores[0], sum(scores) / len(scores)
            below = best and (first < 0.95 * best[1] * sign if larger else 0.95 * first > best[1] * sign)
            out[study, run] = (first, full, best and best[1] * sign, best and best[0] * sign, best is None or sign * full > best[0], best and first + best[0] * sign - best[1] * sign, bool(below))
            best = max(best or (sign * full, sign * first), (sign * full, sign * first))
    return out


@pytest.mark.parametrize("name", ["mean_spearman", "mse"])
def test_trials(spark, name):
    """A study with most runs, ties of means, repeated folds, NULL and NaN scores, and a column named like a result."""
    rng = random.Random(name)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), rng.randrange(120), rng.randrange(4), rng.choice([0.25, 0.5, 0.75, 1.0, None, float("nan")]), "x") for _ in range(900)]
    rows += [(None, 1, 0, 0.5, "x"), ("a", None, 0, 0.5, "x"), ("b", 1, None, 0.5, "x"), ("one", 1, 0, 0.5, "x")]
    objective = report.OBJECTIVES[name]
    got = report.trials(spark.createDataFrame(rows, SCHEMA), "study", "run", "fold", "score", objective).collect()
    want = plain(rows, objective.larger)
    assert {(r.study, r.run) for r in got} == set(want) and len(got) == len(want)
    for r in got:
        first, full, best_first, best_full, improved, estimated, interrupted = want[r.study, r.run]
        assert (r.first_score, r.best_first, r.improved, r.interrupted) == (first, best_first, improved, interrupted)
        assert r.full_score == pytest.approx(full) and r.best_full == (None if best_full is None else pytest.approx(best_full))
        assert r.estimated == (None if estimated is None else pytest.approx(estimated))
    assert report.trials(spark.createDataFrame([], SCHEMA), "study", "run", "fold", "score", objective).collect() == []
