"""Rank correlations of pairs of features with NULLs, where ranks are those among the rows that have both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.tables import written

#: About so many counts are held by a task at a time, in some ten arrays of 8 bytes each.
NUMBERS = 1 << 20


def _given(masks: pd.Series, width: int) -> np.ndarray:
    """A row's bits as numbers, and a last column of ones that stands for the features without NULL."""
    bits = np.unpackbits(np.stack(masks.to_numpy()).astype("<i8").view(np.uint8), axis=1, bitorder="little", count=width)
    return np.hstack([bits.astype(np.int64), np.ones((len(bits), 1), np.int64)])


def _in_order(rows: pd.DataFrame, width: int) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows by feature and value (NaN last), where a new value starts, and the counts of each value's rows."""
    rows = rows.iloc[np.lexsort((rows["v"].to_numpy(), rows["_f"].to_numpy()))]
    f, v = rows["_f"].to_numpy(), rows["v"].to_numpy()
    new = np.ones(len(rows), bool)
    new[1:] = (f[1:] != f[:-1]) | ((v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1])))
    return rows, new, np.add.reduceat(_given(rows["_mask"], width), np.flatnonzero(new), axis=0)


_ENDS = "_slice int, _f int, total array<long>, v0 double, n0 array<long>, v1 double, n1 array<long>"
_STARTS = "_slice int, _f int, before array<long>, less0 array<long>, equal0 array<long>, less1 array<long>, equal1 array<long>, total array<long>"


def _ends(width: int):
    """A slice's counts by feature, and those of its first and its last value, which other slices may have too."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["_slice"].iat[0])
        rows, new, counts = _in_order(rows, width)
        first = rows[new]
        f, v = first["_f"].to_numpy(), first["v"].to_numpy()
        out = [(number, int(k), counts[f == k].sum(0), v[f == k][0], counts[f == k][0], v[f == k][-1], counts[f == k][-1]) for k in np.unique(f)]
        return pd.DataFrame(out, columns=["_slice", "_f", "total", "v0", "n0", "v1", "n1"])

    return of


def _starts(ends: pd.DataFrame) -> pd.DataFrame:
    """For a feature's slices: counts before each, and smaller and equal rows of its first and last value over all slices."""
    ends = ends.sort_values("_slice")
    totals = np.stack(ends["total"].to_numpy())
    before = np.cumsum(totals, axis=0) - totals
    less, equal = {}, {}
    name = lambda v: None if np.isnan(v) else float(v)
    for row, total, start in zip(ends.itertuples(), totals, before):
        a, b = name(row.v0), name(row.v1)
        less.setdefault(a, start)
        equal[a] = equal.get(a, 0) + row.n0
        if a != b:
            less[b], equal[b] = start + total - row.n1, row.n1
    every = totals.sum(0)
    out = [(r["_slice"], r["_f"], s, less[name(r["v0"])], equal[name(r["v0"])], less[name(r["v1"])], equal[name(r["v1"])], every) for r, s in zip(ends.to_dict("records"), before)]
    return pd.DataFrame(out, columns=["_slice", "_f", "before", "less0", "equal0", "less1", "equal1", "total"])


def _ranks(width: int):
    """Each cell's ranks among the rows that have each other feature, less their mean."""

    def of(rows: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        rows, new, equal = _in_order(rows, width)
        f = rows["_f"].to_numpy()[new]
        less = np.zeros(equal.shape, np.int64)
        mean = np.zeros(equal.shape)
        for row in starts.to_dict("records"):
            at = np.flatnonzero(f == row["_f"])
            less[at] = row["before"] + np.cumsum(equal[at], axis=0) - equal[at]
            less[at[0]], less[at[-1]] = row["less0"], row["less1"]
            equal[at[0]], equal[at[-1]] = row["equal0"], row["equal1"]
            mean[at] = (row["total"] + 1) / 2
        ranks = (less + (equal + 1) / 2 - mean)[np.cumsum(new) - 1]
        return pd.DataFrame({"_s": rows["_s"].to_numpy(), "_f": rows["_f"].to_numpy(), "r": [x.tobytes() for x in ranks]})

    return of


def _products(n: int, place: list[int], step: int):
    """Sums over samples, for each pair of features with a sample in common, of both ranks' product and squares."""

    def add(sums: np.ndarray, rows: pd.DataFrame) -> None:
        own = np.cumsum(rows["_s"].ne(rows["_s"].shift()).to_numpy()) - 1
        f, r = rows["_f"].to_numpy(), np.frombuffer(b"".join(rows["r"]), float).reshape(len(rows), -1)
        for at in range(0, int(own[-1]) + 1, step):
            a, b = np.searchsorted(own, [at, at + step])
            x, has = np.zeros((own[b - 1] - at + 1, n, n)), np.zeros((own[b - 1] - at + 1, n), bool)
            x[own[a:b] - at, f[a:b]] = r[a:b][:, place]
            has[own[a:b] - at, f[a:b]] = True
            both = has[:, :, None] & has[:, None, :]
            x *= both
            sums += [both.sum(0), np.einsum("sab,sba->ab", x, x), np.einsum("sab,sab->ab", x, x)]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, held = np.zeros((3, n, n)), None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = (rows["_s"] == rows["_s"].iat[-1]).to_numpy() if len(rows) else np.zeros(0, bool)
            held = rows[last]
            if not last.all():
                add(sums, rows[~last])
        if held is not None and len(held):
            add(sums, held)
        a, b = np.nonzero(np.triu(sums[0], 1))
        yield pd.DataFrame({"_a": a, "_b": b, "n": sums[0][a, b].astype(np.int64), "xy": sums[1][a, b], "xx": sums[2][a, b], "yy": sums[2][b, a]})

    return of


def pair_ranks(given: DataFrame, sample: str, feature: str) -> DataFrame:
    """(feat_a, feat_b, n_both, corr) of features with a sample in common, from (sample, feature, v) without NULLs and with a feature once a sample.

    A rank in a pair is one more than the smaller values among rows that have the other feature, plus
    half of the other equal ones.  A cell carries its sample's given features as bits; cells in the order of
    feature and value are dealt to slices, ties too, and in a slice the ranks against all features
    that have NULLs are running sums of bits, shifted by the sums of the slices before.  So no pair gets a
    window and no row is made for a pair: a cell is shuffled with its bits, then with its ranks to its sample,
    where products are summed up task by task.  NaN is the largest value and equals itself; corr is
    NULL where a side is constant.
    """
    spark = given.sparkSession
    counts = given.groupBy(feature).agg(F.count("*").alias("n")).orderBy(feature).collect()
    kind = given.schema[feature].dataType.simpleString()
    n_samples = given.select(sample).distinct().count()
    holes = [i for i, r in enumerate(counts) if r["n"] < n_samples]
    bit = {i: k for k, i in enumerate(holes)}
    width, words = len(holes), max(1, -(-len(holes) // 64))
    place = [bit.get(i, width) for i in range(len(counts))]
    names = spark.createDataFrame([(r[0], i, bit.get(i)) for i, r in enumerate(counts)], f"_name {kind}, _f int, _bit int")
    cells = given.select(F.col(sample).alias("_s"), F.col(feature).alias("_name"), (F.col("v") + 0.0).alias("v")).join(F.broadcast(names), "_name")
    bits = [F.coalesce(F.bit_or(F.expr(f"case when _bit div 64 = {w} then shiftleft(1L, _bit % 64) end")), F.lit(0).cast("long")) for w in range(words)]
    wide = cells.groupBy("_s").agg(F.collect_list(F.struct("_f", "v")).alias("fs"), F.array(*bits).alias("_mask"))
    cells = wide.select("_s", "_mask", F.inline("fs"))
    slices = max(1, -(-sum(r["n"] for r in counts) * (width + 1) // NUMBERS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(cells.repartitionByRange(slices, "_f", "v", "_s").withColumn("_slice", F.spark_partition_id()), "cells")
    ends = dealt.drop("_s").groupBy("_slice").applyInPandas(_ends(width), _ENDS)
    starts = ends.groupBy("_f").applyInPandas(_starts, _STARTS)
    schema = f"_s {dealt.schema['_s'].dataType.simpleString()}, _f int, r binary"
    ranks = dealt.groupBy("_slice").cogroup(starts.groupBy("_slice")).applyInPandas(_ranks(width), schema)
    sums = ranks.repartition("_s").sortWithinPartitions("_s").mapInPandas(_products(len(counts), place, max(1, NUMBERS // max(1, len(counts)) ** 2)), "_a int, _b int, n long, xy double, xx double, yy double")
    sums = sums.groupBy("_a", "_b").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "xx", "yy")])
    corr = F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt("xx") / F.sqrt("yy"))
    for side in "ab":
        sums = sums.join(F.broadcast(names.select(F.col("_f").alias(f"_{side}"), F.col("_name").alias(f"feat_{side}"))), f"_{side}")
    return sums.select("feat_a", "feat_b", F.col("n").alias("n_both"), corr.alias("corr"))
