"""Results and tasks that must not depend on how many rows there are."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from variantlab.operators import boosting, stats
from variantlab.sources import tables


def test_bins_end_at_exact_quantiles(spark):
    n, bins = 60_000, 16
    x = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30)).cast("double")
    df = spark.range(n).repartition(5).select("id", F.array(x(1), F.when(F.col("id") % 3 > 0, x(2) % 1000), F.lit(0.5)).alias("features"))
    values = [sorted(v for r in df.collect() if (v := r.features[k]) is not None) for k in range(3)]
    got = boosting.bins_of(df, 4, bins).edges
    for own, edges in zip(values, got):
        assert edges.tolist() == sorted({own[-(-k * len(own) // bins) - 1] for k in range(1, bins)})
    assert not len(got[3])


def _dealt_by_number(df):
    """Numbers of tasks that shuffles asked for."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\([^\n]*, (\d+)\), REPARTITION_BY_NUM", plan)]


def test_groups_are_dealt_to_tasks_by_rows(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 50).alias("g"), F.pmod(F.xxhash64("id"), F.lit(30)).alias("a"), (F.col("id") % 37).alias("b"))
    whole = {r.g: r.r for r in stats.group_spearman(df, ["g"], "a", "b").collect()}
    monkeypatch.setattr(stats, "GROUP", 40)
    many = stats.group_spearman(df, ["g"], "a", "b")
    assert _dealt_by_number(many) == [25]
    assert {r.g: r.r for r in many.collect()} == whole


def _spearman(rows):
    if len(rows) < 2:
        return None
    place = lambda own: np.array([sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2 for v in own])
    a, b = (place([r[k] for r in rows]) for k in (0, 1))
    return float(np.corrcoef(a, b)[0, 1]) if a.std() and b.std() else None


def test_record_reads_its_rows_twice(spark):
    rng = np.random.default_rng(3)
    rows = [(("a", "b", None)[i % 3], float(rng.integers(9)), float(rng.integers(9))) for i in range(150)] + [("a", None, 1.0), ("b", 1.0, None), ("one", 1.0, 2.0), ("same", 2.0, 1.0), ("same", 2.0, 3.0)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "g string, y double, p double").mapInArrow(count, "g string, y double, p double")
    got = stats.score_record(df, "y", "p", "g").first()
    given = [r for r in rows if r[1] is not None and r[2] is not None]
    own = [_spearman([r[1:] for r in given if r[0] == g]) for g in {r[0] for r in given}]
    y, p = (np.array([r[k] for r in given]) for k in (1, 2))
    u, v = y >= np.median(y), p >= np.median(p)
    assert got.n == len(given)
    assert np.isclose(got.spearman, _spearman([r[1:] for r in given]))
    assert np.isclose(got.mean_spearman, np.mean([abs(r) for r in own if r is not None]))
    assert np.isclose(got.mcc, np.corrcoef(u, v)[0, 1])
    assert seen.value <= 2 * len(rows)


def test_hits_are_dealt_by_bytes_and_taken_in_file_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "HITS", 100, raising=False)
    monkeypatch.setattr(tables, "RUN", 3, raising=False)
    every = [("hot" if i % 4 else f"q{i % 12}", f"t{i}", "M" * (i % 5 + 1)) for i in range(200)]
    for k in (1, 0, 2):
        (tmp_path / f"part {k}.csv").write_text("".join("\t".join(r) + "\n" for r in every[k * 70 : (k + 1) * 70]))
    got = tables.search_hits(spark, str(tmp_path), 10)
    assert set(_dealt_by_number(got)) == {-(-sum(f.stat().st_size for f in tmp_path.iterdir()) // 100)}
    assert got.columns == ["query", "target", "tseq", "rank"]
    want = []
    for q in sorted({r[0] for r in every}):
        want += [(*r, n + 1) for n, r in enumerate([r for r in every if r[0] == q][:10])]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_boosting_slices_only_large_groups(spark, monkeypatch):
    x = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(97)).cast("double")
    df = spark.range(120).select("id", (F.col("id") % 4).alias("grp"), (F.col("id") % 3).cast("int").alias("fold"), F.array(x(1), x(2)).alias("features")).withColumn("y", F.col("features")[0] + F.col("id") % 5)
    every = lambda **k: boosting.cross_validated(df, ["id"], "y", "grp", "fold", 3, 2, boosting.Settings(rounds=1, depth=2, bins=8, **k), final=False).objectives()
    sliced = every(sliced=True)

    def refuse(*_):
        raise AssertionError("in slices")

    monkeypatch.setattr(stats, "running", refuse)
    assert np.allclose(every(), sliced)
