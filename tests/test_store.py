"""Stored results: reuse, failed writes, updates at the same time, manifests that were cut off."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from variantlab.sources.store import Store
from variantlab.tables import scratch


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "id long")


def squares(seen):
    def compute(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return rows.select("id", (F.col("id") * F.col("id")).alias("sq"))

    return compute


def test_only_new_ids_are_computed(spark):
    seen = []
    store = Store(spark, scratch(spark, "store"), "id")
    assert store.read() is None and store.looked_up(ids(spark, 1)) is None
    assert store.updated(ids(spark, 1, 2, 3), squares(seen)) == 3
    assert store.updated(ids(spark, 2, 3, 4, None), squares(seen)) == 1
    assert store.updated(ids(spark, 1, 4), squares(seen)) == 0
    assert seen == [[1, 2, 3], [4], []] and len(store.versions()) == 2
    assert sorted(map(tuple, store.read().collect())) == [(1, 1), (2, 4), (3, 9), (4, 16)]
    assert [r.sq for r in store.looked_up(ids(spark, 3, 77)).collect()] == [9]


def test_a_failed_write_changes_nothing(spark):
    seen = []
    store = Store(spark, scratch(spark, "store"), "id")
    store.updated(ids(spark, 1), squares(seen))

    def broken(rows):
        return rows.select("id", F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).cast("long").alias("sq"))

    with pytest.raises(Exception, match="lost"):
        store.updated(ids(spark, 1, 2, 3), broken)
    assert [tuple(r) for r in store.read().collect()] == [(1, 1)]
    assert store.updated(ids(spark, 1, 2, 3), squares(seen)) == 2 and seen == [[1], [2, 3]]
    assert store.cleaned() <= 1 and store.cleaned() == 0 and store.read().count() == 3


def test_two_updates_at_a_time(spark):
    root, seen = scratch(spark, "store"), []
    one, two = Store(spark, root, "id"), Store(spark, root, "id")

    def late(rows):
        two.updated(ids(spark, 2, 5), squares(seen))  # comes between
        return squares(seen)(rows)

    assert one.updated(ids(spark, 1, 2), late) >= 1
    rows = sorted(r.id for r in one.read().collect())
    assert rows == [1, 2, 5]


def test_a_manifest_that_was_cut_off(spark):
    store = Store(spark, scratch(spark, "store"), "id")
    store.updated(ids(spark, 1), squares([]))
    files, at = store._at("manifests/v000000002")
    out = files.create(at, False)
    out.write(bytearray(b"nothing\n"))
    out.close()
    assert store.read().count() == 1 and not store._published(["x"], 2)
    assert store.updated(ids(spark, 1, 2), squares([])) == 1 and store.versions() == [1, 2, 3] and store.read().count() == 2
