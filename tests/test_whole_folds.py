"""Similarity folds of long chains and of many small clusters."""

from __future__ import annotations

import random
from collections import Counter

from variantlab.functions.expr import RESIDUES
from variantlab.operators import search


def chain(rng, n):
    parts = ["".join(rng.choices(RESIDUES, k=12)) for _ in range(n + 1)]
    return [a + b for a, b in zip(parts, parts[1:])]


def test_a_long_chain_is_one_cluster(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rng = random.Random(3)
    rows = [(f"a{i:03d}", s) for i, s in enumerate(chain(rng, 80))] + [(f"b{i:03d}", "".join(rng.choices(RESIDUES, k=12))) for i in range(20)]
    got = search.similarity_folds(spark.createDataFrame(rows, "id string, s string"), "id", "s", 3).collect()
    assert len(got) == 100 and {r.cluster for r in got if r.id[0] == "a"} == {"a000"}
    assert len({r.fold for r in got if r.id[0] == "a"}) == 1


def test_small_clusters_fill_the_folds(spark, monkeypatch):
    monkeypatch.setattr(search, "LARGEST", 2)
    monkeypatch.setattr(search, "SLICE", 50)
    rng = random.Random(4)
    rows = [(f"a{i:03d}", s) for i, s in enumerate(chain(rng, 40))] + [(f"b{i:03d}", "".join(rng.choices(RESIDUES, k=12))) for i in range(200)]
    got = search.similarity_folds(spark.createDataFrame(rows, "id string, s string"), "id", "s", 3).collect()
    sizes = Counter(r.fold for r in got)
    assert len(got) == 240 and set(sizes) == {0, 1, 2} and max(sizes.values()) - min(sizes.values()) <= 4
    assert len({r.fold for r in got if r.id[0] == "a"}) == 1
