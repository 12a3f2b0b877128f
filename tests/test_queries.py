"""Every registered query against its SQL in DuckDB, on the smallest tables; those without SQL must give rows."""

from __future__ import annotations

import math

import duckdb
import pytest

from variantlab.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    try:
        x = float(value)
    except (TypeError, ValueError):
        return str(value)
    return "None" if math.isnan(x) else f"{round(x, 6) + 0.0:.6f}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_against_sql(spark, duck, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir)
    cursor = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, got.collect()) == rows_of(names, cursor.fetchall())


@pytest.mark.parametrize("name", ["profile_scores", "levelled_subsample", "confusion_select", "attribution_impact"])
def test_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).limit(1).count() == 1
