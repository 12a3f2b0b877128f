"""Mean powers of differences between all targets, by expansions over the halves of halves of their range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlab.tables import written

#: Terms of an expansion; cells that don't touch leave an error of about 5.8 ** -TERMS.
TERMS = 16
#: The range is halved until no cell has more distinct targets.
LEAF = 128
#: Halvings at most, where cells are as narrow as a target's rounding.
DEEPEST = 60
#: A level of at most 2 ** COARSE cells is broadcast.
COARSE = 10

NODES = np.cos((np.arange(TERMS) + 0.5) * np.pi / TERMS)
#: Chebyshev polynomials at the nodes, by (node, term), and what gives an expansion's terms from values at the nodes.
AT_NODES = np.cos(np.outer(np.arccos(NODES), np.arange(TERMS)))
TO_TERMS = AT_NODES.T * np.where(np.arange(TERMS) > 0, 2, 1)[:, None] / TERMS
MOMENTS = [f"m{j}" for j in range(TERMS)]
_NUMBERS = ", ".join(f"{m} double" for m in MOMENTS)


def _term(y: Column, j: int) -> Column:
    return F.cos(F.lit(j) * F.acos(F.greatest(F.least(y, F.lit(1.0)), F.lit(-1.0))))


def _inside(cells: np.ndarray, down: int) -> np.ndarray:
    """Polynomials, by (cell, node, term), of the cell `down` levels above at each cell's nodes."""
    left = cells - ((cells >> down) << down)
    y = 2 * (left[:, None] + (NODES + 1) / 2) / 2.0**down - 1
    return np.cos(np.arccos(np.clip(y, -1, 1))[:, :, None] * np.arange(TERMS))


def _rows(level, cell: np.ndarray, numbers: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame(numbers, columns=MOMENTS)
    out.insert(0, "cell", cell)
    out.insert(0, "level", np.int32(level))
    return out


def _upward(deepest: int):
    """What each deepest cell adds to the moments of the cells above it; it stands for itself by charges at its nodes."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cells, charges = rows["cell"].to_numpy(), rows[MOMENTS].to_numpy() @ TO_TERMS
            for level in range(2, deepest + 1):
                yield _rows(level, cells >> (deepest - level), np.einsum("bk,bkj->bj", charges, _inside(cells, deepest - level)))

    return of


def _across(power: float):
    """Expansions in a cell of the sums over another one that doesn't touch it, `away` cells to the right."""
    into = {o: TO_TERMS @ np.abs((NODES[:, None] - NODES) / 2 - o) ** power @ TO_TERMS.T for o in (-3, -2, 2, 3)}

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            away, given, out = rows["away"].to_numpy(), rows[MOMENTS].to_numpy(), np.zeros((len(rows), TERMS))
            for o, matrix in into.items():
                out[away == o] = given[away == o] @ matrix.T
            out *= 2.0 ** (-power * rows["level"].to_numpy())[:, None]
            yield _rows(rows["level"].to_numpy(), rows["cell"].to_numpy(), out)

    return of


def _downward(deepest: int):
    """Expansions of cells as expansions in a deepest cell inside them."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for level, own in rows.groupby("level"):
                cells = own["below"].to_numpy()
                values = np.einsum("bkj,bj->bk", _inside(cells, deepest - int(level)), own[MOMENTS].to_numpy())
                yield _rows(level, cells, values @ TO_TERMS.T)

    return of


def _near(target: str, power: float, span: float):
    """Adds to each asked target the powers of its differences to what is in its cell; cells come in order, whole."""

    def of_cells(rows: pd.DataFrame) -> pd.DataFrame:
        cells, v, n = rows["cell"].to_numpy(), rows["v"].to_numpy(), rows["n"].to_numpy()
        asked = np.flatnonzero(rows["asked"].to_numpy())
        first, after = np.searchsorted(cells, cells[asked]), np.searchsorted(cells, cells[asked], side="right")
        sums = np.array([n[a:b] @ np.abs((v[a:b] - v[i]) / span) ** power for i, a, b in zip(asked, first, after)], float)
        return pd.DataFrame({target: rows["t"].to_numpy()[asked], "weight": rows["far"].to_numpy()[asked] + sums})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            whole = (rows["cell"] != rows["cell"].iat[-1]).to_numpy() if len(rows) else np.zeros(0, bool)
            held = rows[~whole]
            yield of_cells(rows[whole])
        if held is not None:
            yield of_cells(held)

    return of


def _deepest(points: DataFrame) -> int:
    """The fewest halvings after which no cell has over LEAF points."""
    low, high = 2, DEEPEST
    while low < high:
        level = (low + high) // 2
        most = points.groupBy(F.shiftrightunsigned("finest", DEEPEST - level)).count().agg(F.max("count")).first()[0]
        low, high = (low, level) if most <= LEAF else (level + 1, high)
    return low


def mean_powers(values: DataFrame, counts: DataFrame, target: str, power: float) -> DataFrame:
    """Distinct `values` with `weight`, the mean of |difference| ** power over `counts` (target, _n), for any power from 0 on.

    The range of targets is halved until cells have few of them.  A target meets what is in its cell and
    the two next to it one by one.  All else is, at some level, in a cell that doesn't touch the target's
    own, while the cells that hold both do: there are three such cells a level at most, and sums over them
    are Chebyshev expansions, made from cells' moments.  So a target's cost grows with the number of
    levels, never with that of the others.  Relative errors are about 1e-11 for powers up to 3 and grow to
    about 1e-6 at 20.  Targets that aren't finite don't count and get a NULL weight, as do all where no
    other counts.  After DEEPEST halvings cells may still hold many targets, which are then within
    2 ** -60 of the range and meet one by one.
    """
    spark, t = values.sparkSession, F.col(target).cast("double")
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf"))
    odd = values.where(~finite | t.isNull()).select(target, F.lit(None).cast("double").alias("weight"))
    both = values.where(finite).select(target, F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asked")).unionByName(counts.where(finite).select(target, "_n", F.lit(False).alias("_asked")))
    points = both.groupBy(target).agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked")).select(F.col(target).alias("t"), t.alias("v"), F.col("_n").cast("double").alias("n"), F.col("_asked").alias("asked"))
    points = written(points, "targets")
    low, high, n = points.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    if not n or low == high:
        flat = None if not n else float(power == 0)
        return points.where("asked").select(F.col("t").alias(target), F.lit(flat).cast("double").alias("weight")).unionByName(odd)
    span = high - low
    x = (F.col("v") - low) / span
    points = points.withColumn("finest", F.least(F.floor(x * 2.0**DEEPEST).cast("long"), F.lit((1 << DEEPEST) - 1)))
    deepest = _deepest(points)
    points = points.withColumn("cell", F.shiftright("finest", DEEPEST - deepest)).withColumn("y", 2 * (x * 2.0**deepest - F.col("cell")) - 1)
    numbers = f"level int, cell long, {_NUMBERS}"
    total = [F.sum(m).alias(m) for m in MOMENTS]
    own = points.where("n > 0").groupBy("cell").agg(*[F.sum(F.col("n") * _term(F.col("y"), j)).alias(m) for j, m in enumerate(MOMENTS)])
    moments = own.mapInPandas(_upward(deepest), numbers).groupBy("level", "cell").agg(*total)
    above = points.where("asked").select("cell").distinct().select(F.col("cell").alias("below"), F.explode(F.sequence(F.lit(2), F.lit(deepest))).alias("level"))
    above = above.withColumn("cell", F.expr(f"shiftright(below, {deepest} - level)"))
    away = F.when(F.col("cell") % 2 == 0, F.array(*map(F.lit, (-2, 2, 3)))).otherwise(F.array(*map(F.lit, (-3, -2, 2))))
    met = above.select("level", "cell").distinct().select("level", "cell", F.explode(away).alias("away"))
    met = met.join(moments.withColumnRenamed("cell", "other"), (moments["level"] == met["level"]) & (F.col("other") == F.col("cell") + F.col("away"))).select(met["level"], "cell", "away", *MOMENTS)
    local = written(met.mapInPandas(_across(power), numbers).groupBy("level", "cell").agg(*total), "expansions")
    inside = above.where(f"level <= {COARSE}").join(F.broadcast(local.where(f"level <= {COARSE}")), ["level", "cell"])
    inside = inside.unionByName(above.where(f"level > {COARSE}").join(local.where(f"level > {COARSE}"), ["level", "cell"]))
    inside = inside.select("below", "level", *MOMENTS).mapInPandas(_downward(deepest), numbers).groupBy("cell").agg(*total)
    far = sum((F.col(m) * _term(F.col("y"), j) for j, m in enumerate(MOMENTS)), F.lit(0.0))
    known = points.join(inside, "cell", "left").select("cell", "t", "v", "n", "asked", F.coalesce(far, F.lit(0.0)).alias("far"))
    sides = F.when(F.col("n") > 0, F.array(*map(F.lit, (-1, 0, 1)))).otherwise(F.array(F.lit(0)))
    rows = known.select("*", F.explode(sides).alias("side")).withColumns({"cell": F.col("cell") + F.col("side"), "asked": F.col("asked") & (F.col("side") == 0)}).drop("side")
    kind = values.schema[target].dataType.simpleString()
    rows = rows.repartition("cell").sortWithinPartitions("cell")
    sums = rows.mapInPandas(_near("_target", power, span), f"_target {kind}, weight double")
    return sums.select(F.col("_target").alias(target), (F.col("weight") / n * F.pow(F.lit(span), F.lit(float(power)))).alias("weight")).unionByName(odd)
