"""Gradient boosting by histograms: all folds train in one job, and stop by the objective of groups.

Features are cut into bins at their quantiles once; categories are bins of their own.  A level of a
tree is one scan and one aggregate by (run, node, feature, bin): tasks sum up gradients of their rows
before anything is shuffled, so a level moves cells, never rows.  A run is a fold left out (and a
repeat with other samples of rows and features), or all rows; runs are keys of that aggregate.  Splits
are chosen by windows over the bins of a feature, categories in the order of their mean gradient, rows
without a value on the side where they gain more.  The driver gets a row for each open node.

Rounds end when 1 - mean rank correlation of groups on the rows left out hasn't improved for
`patience` rounds, and the best prefix of trees is kept.  The scores that trees have summed up so far
are stored with the rows every `store` rounds; in between, a scan walks the trees since then.

Rows without target take no part in training; NULL and NaN features are missing values; weights are 1
where they are NULL.  Runs without training rows predict 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantlab.operators import explain, stats
from variantlab.operators.report import interrupted
from variantlab.tables import removed, running, written

#: The bin of a missing value, above all others.
MISSING = 255


@dataclass(frozen=True)
class Settings:
    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    l2: float = 1.0
    l1: float = 0.0
    least_gain: float = 0.0
    least_child: float = 1.0
    most_step: float = 0.0
    rows: float = 1.0
    features: float = 1.0
    bins: int = 32
    patience: int = 10
    least_change: float = 1e-4
    store: int = 8
    seed: int = 1
    sliced: bool | None = None  # ranks of groups in slices; False: a group must fit a task; None: slices only if the largest group asks for them


@dataclass
class Bins:
    """Upper edges of each numeric feature's bins but the last, and the known values of each categorical one."""

    edges: list[np.ndarray]
    categorical: frozenset[int] = frozenset()

    def of(self, x: np.ndarray) -> np.ndarray:
        """Bins (rows, features) of values; a category that isn't known is missing."""
        out = np.full(x.shape, MISSING, np.uint8)
        for f, edges in enumerate(self.edges):
            v = x[:, f]
            ok = ~np.isnan(v)
            if f in self.categorical:
                at = np.minimum(np.searchsorted(edges, v), max(len(edges) - 1, 0))
                ok &= edges[at] == v if len(edges) else False
                out[ok, f] = at[ok]
            else:
                out[ok, f] = np.searchsorted(edges, v[ok], "left")
        return out


@dataclass
class Tree:
    """Nodes by number: feature (-1 at a leaf), which bins go left, children, value, gain and rows."""

    feature: list[int] = field(default_factory=lambda: [-1])
    goes: list[np.ndarray] = field(default_factory=lambda: [np.zeros(256, bool)])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    cover: list[int] = field(default_factory=lambda: [0])

    def split(self, node: int, feature: int, goes: np.ndarray, gain: float, values: tuple[float, float], covers: tuple[int, int]) -> tuple[int, int]:
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.goes[node], self.gain[node] = feature, goes, gain
        self.left[node], self.right[node] = children
        for value, cover in zip(values, covers):
            for column, x in ((self.feature, -1), (self.goes, np.zeros(256, bool)), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0), (self.cover, cover)):
                column.append(x)
        return children

    def nodes_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        feature, left, right, goes = np.array(self.feature), np.array(self.left), np.array(self.right), np.stack(self.goes)
        at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(live := live[feature[at[live]] >= 0]):
            node = at[live]
            at[live] = np.where(goes[node, bins[live, feature[node]]], left[node], right[node])
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes_of(bins)]


@dataclass
class Run:
    """One training: `fold` is left out (None: nothing is), `repeat` chooses the samples of rows and features."""

    fold: int | None
    repeat: int = 0
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)
    objectives: list[float] = field(default_factory=list)
    best: int = 0
    live: bool = True


@dataclass
class Model:
    bins: Bins
    base: float
    trees: list[Tree]

    def predicted(self, rows: DataFrame, features: str = "features", name: str = "prediction") -> DataFrame:
        """`rows` with the prediction, whatever their columns are named."""
        shared = rows.sparkSession.sparkContext.broadcast(self)
        kept = [c for c in rows.columns if c != name]
        held = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.transform(features, lambda x: x.cast("double")).alias("x"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                bins = own.bins.of(_matrix(batch.column("x"), len(own.bins.edges)))
                total = np.full(batch.num_rows, own.base)
                for tree in own.trees:
                    total += tree.scores(bins)
                yield pa.RecordBatch.from_arrays([*batch.column("row").flatten(), pa.array(total)], [*kept, name])

        return held.mapInArrow(run, rows.select(*[f"`{c}`" for c in kept]).limit(0).schema.add(name, "double"))

    def gains(self) -> list[tuple[int, float]]:
        """The share of the gain of all splits that a feature's have, from the largest."""
        total: dict[int, float] = {}
        for tree in self.trees:
            for f, gain in zip(tree.feature, tree.gain):
                if f >= 0:
                    total[f] = total.get(f, 0.0) + gain
        every = sum(total.values()) or 1.0
        return sorted(((f, g / every) for f, g in total.items()), key=lambda x: (-x[1], x[0]))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column of doubles; missing, null and surplus elements are NaN or left out."""
    out = np.full((len(column), width), np.nan)
    if not len(column):
        return out
    lengths = np.diff(np.asarray(column.offsets))
    lengths[~np.asarray(column.is_valid())] = 0
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(column)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ok = at < width
    out[row[ok], at[ok]] = flat[ok]
    return out


def bins_of(samples: DataFrame, width: int, bins: int = 32, categorical: frozenset[int] = frozenset(), features: str = "features") -> Bins:
    """Edges at exact quantiles, the smallest value with k / bins of a feature's rows up to it; of a categorical feature the most frequent values, at most 254.

    Distinct values are counted and get running totals over slices, so no task has a feature's values.
    """
    cells = samples.select(F.posexplode(F.transform(features, lambda x: x.cast("double"))).alias("f", "x")).where(F.col("x").isNotNull() & ~F.isnan("x") & (F.col("f") < width))
    edges = [np.empty(0)] * width
    numeric = cells.where(~F.col("f").isin(*categorical)) if categorical else cells
    placed, start = [], 0
    for r in numeric.groupBy("f").agg(F.count("*").alias("n")).orderBy("f").collect():
        placed.append((r.f, start, r.n))
        start += r.n
    if placed:
        counts = numeric.groupBy("f", "x").agg(F.count("*").alias("_n"))
        every = F.broadcast(samples.sparkSession.createDataFrame(placed, "f int, _base long, _all long"))
        totals = running(counts, ["f", "x"], {"_to": F.col("_n")}).join(every, "f")
        at = [F.min(F.when((F.col("_to") - F.col("_base")) * bins >= k * F.col("_all"), F.col("x"))) for k in range(1, bins)]
        for r in totals.groupBy("f").agg(F.array(*at).alias("e")).collect():
            edges[r.f] = np.unique(r.e)
    if categorical:
        counts = cells.where(F.col("f").isin(*categorical)).groupBy("f", "x").count()
        place = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("count"), "x"))
        for r in counts.withColumn("p", place).where(F.col("p") < MISSING).groupBy("f").agg(F.sort_array(F.collect_list("x")).alias("e")).collect():
            edges[r.f] = np.array(r.e)
    return Bins(edges, frozenset(categorical))


def binned(samples: DataFrame, bins: Bins, key: list[str], target: str, group: str, fold: str | None, weight: str | None = None, features: str = "features") -> DataFrame:
    """h (a hash of the key), y, w, grp, fold and the bins of every row with a target, one byte for each feature."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    rows = samples.where(F.col(target).isNotNull() & ~F.isnan(F.col(target).cast("double")))
    rows = rows.select(F.xxhash64(*key).alias("h"), F.col(target).cast("double").alias("y"), w.alias("w"), F.col(group).cast("string").alias("grp"), (F.col(fold).cast("int") if fold else F.lit(None).cast("int")).alias("fold"), F.transform(features, lambda x: x.cast("double")).alias("x"))
    shared, width = samples.sparkSession.sparkContext.broadcast(bins), len(bins.edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = shared.value.of(_matrix(batch.column("x"), width)).tobytes()
            packed = pa.array([own[i : i + width] for i in range(0, len(own), width)] if width else [b""] * batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "y", "w", "grp", "fold")), packed], ["h", "y", "w", "grp", "fold", "bins"])

    return rows.mapInArrow(run, "h long, y double, w double, grp string, fold int, bins binary")


def _uniform(h: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from hashes and a salt alone."""
    z = h.astype(np.uint64) ^ np.uint64(sum((s + 1) * 0x9E3779B97F4A7C15 ** (i + 1) for i, s in enumerate(salt)) % (1 << 64))
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z >> np.uint64(11)).astype(float) / (1 << 53)


class _State:
    """What a scan needs: of each live run its number, fold, repeat, base, the trees not yet in the stored scores, and the open nodes of the tree that grows."""

    def __init__(self, runs: list[tuple[int, Run]], since: int, settings: Settings, width: int, tree: dict[int, Tree] | None = None, open_: dict[int, list[int]] | None = None, turn: int = 0) -> None:
        self.runs = [(k, r.fold, r.repeat, r.base, r.trees[since:]) for k, r in runs]
        self.settings, self.width, self.tree, self.open, self.turn = settings, width, tree or {}, open_ or {}, turn

    def scores(self, bins: np.ndarray, base: float, stored: np.ndarray | None, trees: list[Tree]) -> np.ndarray:
        total = np.full(len(bins), base) if stored is None else stored.copy()
        for tree in trees:
            total += tree.scores(bins)
        return total


def first_level(runs: list[Run], settings: Settings, width: int) -> _State:
    """The state at the root of every run's first tree."""
    return _State(list(enumerate(runs)), 0, settings, width, {k: Tree() for k in range(len(runs))}, {k: [0] for k in range(len(runs))})


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    fold = batch.column("fold").fill_null(-1).to_numpy(zero_copy_only=False)
    stored = np.stack(batch.column("scores").to_numpy(zero_copy_only=False)) if "scores" in batch.schema.names and batch.num_rows else None
    return bins, fold, batch.column("y").to_numpy(), batch.column("w").to_numpy(), batch.column("h").to_numpy(), stored


def cells(rows: DataFrame, state: _State) -> DataFrame:
    """run, node, feature, bin with the sums g, h and the number n of their training rows: the histograms of all open nodes."""
    shared = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        width, s, total = own.width, own.settings, {}
        for batch in batches:
            bins, fold, y, w, h, stored = _rows(batch, width)
            for k, out, repeat, base, trees in own.runs:
                open_ = np.full(max(own.open[k]) + 1, -1)
                open_[own.open[k]] = np.arange(len(own.open[k]))
                use = fold != out if out is not None else np.ones(len(y), bool)
                if s.rows < 1:
                    use &= _uniform(h, s.seed, repeat, own.turn) < s.rows
                use = np.flatnonzero(use)
                node = own.tree[k].nodes_of(bins[use])
                node = np.where(node < len(open_), open_[np.minimum(node, len(open_) - 1)], -1)
                use, node = use[node >= 0], node[node >= 0]
                own_w = w[use]
                g = (own.scores(bins[use], base, stored[use, k] if stored is not None else None, trees) - y[use]) * own_w
                at = ((node[:, None] * width + np.arange(width)) << 8 | bins[use]).ravel()
                size = len(own.open[k]) * width << 8
                part = [np.bincount(at, np.repeat(v, width), size).astype(float) for v in (g, own_w)] + [np.bincount(at, minlength=size)]
                total[k] = [a + b for a, b in zip(total[k], part)] if k in total else part
        for k, (g, hess, n) in total.items():
            at = np.flatnonzero(n)
            columns = [np.full(len(at), k, np.int32), np.array(own.open[k], np.int32)[(at >> 8) // width], ((at >> 8) % width).astype(np.int32), (at & 255).astype(np.int32), g[at], hess[at], n[at].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["run", "node", "feature", "bin", "g", "h", "n"])

    parts = rows.mapInArrow(run, "run int, node int, feature int, bin int, g double, h double, n long")
    return parts.groupBy("run", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def splits(histograms: DataFrame, settings: Settings, categorical: frozenset[int] = frozenset()) -> DataFrame:
    """Every split of every feature of every node, with its gain: the last bin that goes left, whether missing values do, and both sides' sums."""
    by = Window.partitionBy("run", "node", "feature")
    known = F.col("bin") != MISSING
    kind = F.col("feature").isin(*categorical) if categorical else F.lit(False)
    order = F.when(kind, F.col("g") / (F.col("h") + settings.l2)).otherwise(F.lit(0.0))
    up = by.orderBy((~known).cast("int"), order, "bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = {f"_a{c}": F.sum(c).over(by) for c in "ghn"} | {f"_m{c}": F.coalesce(F.sum(F.when(~known, F.col(c))).over(by), F.lit(0)) for c in "ghn"} | {f"_l{c}": F.sum(c).over(up) for c in "ghn"}
    if categorical:
        sums["left_bins"] = F.collect_list("bin").over(up)
    rows = histograms.withColumns(sums).where(known)
    sides = F.explode(F.when(F.col("_mn") > 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("missing_left", sides)
    for c in "ghn":
        rows = rows.withColumn(f"{c}_left", F.col(f"_l{c}") + F.col("missing_left") * F.col(f"_m{c}")).withColumn(f"{c}_right", F.col(f"_a{c}") - F.col(f"{c}_left"))
    gain = _strength("g_left", "h_left", settings) + _strength("g_right", "h_right", settings) - _strength("_ag", "_ah", settings)
    fits = (F.col("n_left") > 0) & (F.col("n_right") > 0) & (F.least("h_left", "h_right") >= settings.least_child)
    left = F.when(kind, F.col("left_bins")) if categorical else F.lit(None).cast("array<int>")
    return rows.where(fits).select("run", "node", "feature", "bin", "missing_left", gain.alias("gain"), "g_left", "h_left", "n_left", "g_right", "h_right", "n_right", left.alias("left_bins"))


def _strength(g: str, h: str, settings: Settings) -> Column:
    shrunk = F.greatest(F.abs(g) - settings.l1, F.lit(0.0)) if settings.l1 else F.col(g)
    return shrunk * shrunk / (F.col(h) + settings.l2)


def best_splits(candidates: DataFrame, *by: str) -> DataFrame:
    """The split of the largest gain; of equal ones that of the first feature, then of the first bin, missing values right."""
    first = F.struct(F.round("gain", 9), -F.col("feature"), -F.col("bin"), -F.col("missing_left"))
    best = F.max_by(F.struct(*[c for c in candidates.columns if c not in by]), first)
    return candidates.groupBy(*by).agg(best.alias("b")).select(*by, "b.*")


def _value(g: float, h: float, s: Settings) -> float:
    step = -np.sign(g) * max(abs(g) - s.l1, 0.0) / (h + s.l2) if h + s.l2 > 0 else 0.0
    return float(s.rate * (np.clip(step, -s.most_step, s.most_step) if s.most_step else step))


def _grown(rows: DataFrame, live: list[tuple[int, Run]], since: int, s: Settings, bins: Bins, turn: int) -> dict[int, Tree]:
    """One more tree for each live run, level by level."""
    width = len(bins.edges)
    trees, open_ = {k: Tree() for k, _ in live}, {k: [0] for k, _ in live}
    chosen = {}
    for k, r in live:
        u = _uniform(np.arange(width), s.seed, r.repeat, turn, 7)
        chosen[k] = set(np.argsort(u, kind="stable")[: max(1, round(width * s.features))].tolist())
    for _ in range(s.depth):
        own = [(k, r) for k, r in live if open_[k]]
        if not own:
            break
        found = splits(cells(rows, _State(own, since, s, width, trees, open_, turn)), s, bins.categorical)
        if s.features < 1:
            pairs = [(k, f) for k, _ in own for f in sorted(chosen[k])]
            found = found.join(F.broadcast(rows.sparkSession.createDataFrame(pairs, "run int, feature int")), ["run", "feature"], "left_semi")
        open_ = {k: [] for k, _ in live}
        for r in best_splits(found, "run", "node").orderBy("run", "node").collect():
            if r.gain <= max(s.least_gain, 1e-12):
                continue
            goes = np.zeros(256, bool)
            goes[r.left_bins if r.left_bins is not None else np.arange(r.bin + 1)] = True
            goes[MISSING] = bool(r.missing_left)
            values = _value(r.g_left, r.h_left, s), _value(r.g_right, r.h_right, s)
            open_[r.run] += trees[r.run].split(r.node, r.feature, goes, r.gain, values, (r.n_left, r.n_right))
    return trees


def _evaluated(rows: DataFrame, live: list[tuple[int, Run]], since: int, s: Settings, width: int) -> dict[int, float]:
    """Of each run with a fold left out, 1 - mean rank correlation of groups there."""
    shared = rows.sparkSession.sparkContext.broadcast(_State(live, since, s, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            bins, fold, y, _, _, stored = _rows(batch, width)
            for k, out, _, base, trees in own.runs:
                use = np.flatnonzero(fold == out) if out is not None else np.empty(0, np.int64)
                if len(use):
                    p = own.scores(bins[use], base, stored[use, k] if stored is not None else None, trees)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(use), k, np.int32)), batch.column("grp").take(pa.array(use)), pa.array(y[use]), pa.array(p)], ["run", "grp", "y", "p"])

    scored = rows.mapInArrow(run, "run int, grp string, y double, p double")
    groups = stats.group_spearman(scored, ["run", "grp"], "y", "p", sliced=s.sliced)
    return {r.run: r.o for r in groups.groupBy("run").agg((1 - F.coalesce(F.avg("r"), F.lit(0.0))).alias("o")).collect()}


def _stored(rows: DataFrame, runs: list[Run], since: int, s: Settings, width: int) -> DataFrame:
    """The rows with the scores of all trees so far."""
    shared = rows.sparkSession.sparkContext.broadcast(_State(list(enumerate(runs)), since, s, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            bins, _, _, _, _, stored = _rows(batch, width)
            scores = np.stack([own.scores(bins, base, stored[:, k] if stored is not None else None, trees) for k, _, _, base, trees in own.runs], axis=1)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32)), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "y", "w", "grp", "fold", "bins")), flat], ["h", "y", "w", "grp", "fold", "bins", "scores"])

    return written(rows.mapInArrow(run, "h long, y double, w double, grp string, fold int, bins binary, scores array<double>"), "boosted")


def boosted(rows: DataFrame, bins: Bins, runs: list[Run], settings: Settings, best_first: float | None = None) -> list[Run]:
    """All runs grown side by side over `binned` rows; each ends by its own objective, keeping its best prefix.

    best_first: a first run that ends with a mean correlation far below it ends the others too, untrained further.
    """
    s, width = settings, len(bins.edges)
    held = written(rows, "binned")
    means = [F.sum(F.when(F.lit(True) if r.fold is None else F.coalesce(F.col("fold") != r.fold, F.lit(True)), F.col("w") * F.col("y"))) for r in runs]
    weights = [F.sum(F.when(F.lit(True) if r.fold is None else F.coalesce(F.col("fold") != r.fold, F.lit(True)), F.col("w"))) for r in runs]
    sums = held.agg(*means, *weights).first()
    for k, r in enumerate(runs):
        r.base = sums[k] / sums[len(runs) + k] if sums[len(runs) + k] else 0.0
        r.live = bool(sums[len(runs) + k])
    since = 0
    for turn in range(s.rounds):
        live = [(k, r) for k, r in enumerate(runs) if r.live]
        if not live:
            break
        for k, tree in _grown(held, live, since, s, bins, turn).items():
            runs[k].trees.append(tree)
        judged = [(k, r) for k, r in live if r.fold is not None]
        for k, o in (_evaluated(held, judged, since, s, width) if judged else {}).items():
            r = runs[k]
            if not r.objectives or o < r.objectives[r.best - 1] - s.least_change:
                r.best = len(r.trees)
            r.objectives.append(o)
            r.live = len(r.trees) - r.best < s.patience
        if not runs[0].live and runs[0].objectives and interrupted(1 - min(runs[0].objectives), best_first):
            break
        if turn + 1 - since >= s.store and turn + 1 < s.rounds:
            new = _stored(held, runs, since, s, width)
            removed(held)
            held, since = new, turn + 1
    removed(held)
    for r in runs:
        r.live = False
        r.best = r.best if r.fold is not None and r.objectives else len(r.trees)
        del r.trees[r.best :]
    return runs


def model_of(run: Run, bins: Bins) -> Model:
    return Model(bins, run.base, run.trees)


@dataclass
class Validated:
    """Cross-validation: a run for each fold and repeat, and a model of all rows with the mean number of trees that those kept."""

    runs: list[Run]
    bins: Bins
    final: Model | None

    def objectives(self) -> list[float]:
        return [min(r.objectives) if r.objectives else 1.0 for r in self.runs]

    def worst(self, folds: int) -> list[float]:
        """Of each fold, the worst of its repeats."""
        every = self.objectives()
        return [max(every[f::folds]) for f in range(folds)]


def cross_validated(samples: DataFrame, key: list[str], target: str, group: str, fold: str, folds: int, width: int, settings: Settings = Settings(), repeats: int = 1, weight: str | None = None, categorical: frozenset[int] = frozenset(), features: str = "features", best_first: float | None = None, final: bool = True) -> Validated:
    """All folds and repeats in one training, then the final model."""
    bins = bins_of(samples, width, settings.bins, categorical, features)
    rows = binned(samples, bins, key, target, group, fold, weight, features)
    runs = boosted(rows, bins, [Run(f, k) for k in range(repeats) for f in range(folds)], settings, best_first)
    if not final:
        return Validated(runs, bins, None)
    rounds = max(1, round(float(np.mean([r.best for r in runs]))))
    whole = boosted(rows, bins, [Run(None)], replace(settings, rounds=rounds))[0]
    return Validated(runs, bins, model_of(whole, bins))


def out_of_fold(samples: DataFrame, found: Validated, fold: str, features: str = "features", name: str = "prediction") -> DataFrame:
    """`samples` of the folds that were left out, each predicted by the first run that didn't see it."""
    parts, seen = None, set()
    for r in found.runs:
        if r.fold not in seen:
            seen.add(r.fold)
            part = model_of(r, found.bins).predicted(samples.where(F.col(fold) == r.fold), features, name)
            parts = part if parts is None else parts.union(part)
    return parts


def node_table(model: Model) -> list[tuple[int, int, int, int, int, float, float, int, float]]:
    """A model without categories or missing values as `explain.node_table` gives MLlib's: thresholds go left."""
    out = []
    for t, tree in enumerate(model.trees):
        depth = [1] * len(tree.feature)
        for i, f in enumerate(tree.feature):
            at = model.bins.edges[f][int(np.flatnonzero(tree.goes[i][:MISSING])[-1])] if f >= 0 else 0.0
            if f in model.bins.categorical:
                raise ValueError("a categorical split has no threshold")
            for child in (tree.left[i], tree.right[i]):
                if child >= 0:
                    depth[child] = depth[i] + 1
            cover = tree.cover[tree.left[0]] + tree.cover[tree.right[0]] if i == 0 and f >= 0 else tree.cover[i]
            out.append((t, i, tree.left[i], tree.right[i], f, float(at), tree.value[i], depth[i], float(cover)))
    return out


def two_rounds(samples: DataFrame, key: list[str], target: str, group: str, fold: str, held: int, width: int, first: Settings, second: Settings, threshold: float = 0.0, features: str = "features") -> tuple[Model, list[int]]:
    """Boost until the objective on the fold left out is best, drop the features whose impact there reaches the threshold, boost again by settings of its own.

    Returns the model of the features kept, in their order, and their numbers.  Features must have no missing values.
    """
    rows = samples.withColumn("_all", F.transform(features, lambda x: x.cast("double")))
    bins = bins_of(rows, width, first.bins, features="_all")
    model = model_of(boosted(binned(rows, bins, key, target, group, fold, features="_all"), bins, [Run(held)], first)[0], bins)
    test = model.predicted(rows.where(F.col(fold) == held), "_all")
    shares = explain.shapley(test.select(*key, target, F.col("_all").alias("features")), node_table(model), key, target=target, weights=[1.0] * len(model.trees))
    impacts = explain.impacts(shares, test, key, target, "prediction")
    hurt = {r.feature for r in impacts.where((F.col("impact") >= threshold) & (F.col("impact") > 0)).collect()}
    kept = [i for i in range(width) if i not in hurt] or list(range(width))
    narrow = rows.withColumn("_kept", F.array(*[F.get("_all", i) for i in kept]))
    bins = bins_of(narrow, len(kept), second.bins, features="_kept")
    return model_of(boosted(binned(narrow, bins, key, target, group, fold, features="_kept"), bins, [Run(held)], second)[0], bins), kept
