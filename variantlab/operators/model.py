"""Tree ensembles on sample tables: training, two-round boosting, selection and search."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.operators import clean, encode, explain
from variantlab.tables import removed, written


def vectors(samples: DataFrame, features: str = "features", name: str = "vector") -> DataFrame:
    """An array column as an ML vector."""
    return samples.withColumn(name, array_to_vector(F.transform(features, lambda x: x.cast("double"))))


def assembled(samples: DataFrame, columns: list[str], name: str = "vector") -> DataFrame:
    """Named columns as an ML vector; NULLs become NaN and must be imputed before training."""
    return VectorAssembler(inputCols=columns, outputCol=name, handleInvalid="keep").transform(samples)


def forest(samples: DataFrame, target: str, trees: int = 20, depth: int = 6, weight: str | None = None, seed: int = 1, vector: str = "vector") -> Any:
    """M10."""
    model = RandomForestRegressor(featuresCol=vector, labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)
    return (model.setWeightCol(weight) if weight else model).fit(samples)


def boosted(samples: DataFrame, target: str, rounds: int = 20, depth: int = 4, rate: float = 0.1, weight: str | None = None, seed: int = 1, vector: str = "vector") -> Any:
    model = GBTRegressor(featuresCol=vector, labelCol=target, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed)
    return (model.setWeightCol(weight) if weight else model).fit(samples)


def confusion_selection(samples: DataFrame, key: list[str], fold: str, folds: int, target: str, width: int, drop: int, trees: int = 10, depth: int = 4, features: str = "features", **exponents: float) -> DataFrame:
    """Per fold a forest and its features' confusion on held-out rows; the worst over folds, ranked; `kept` is false for the `drop` highest."""
    parts = None
    for k in range(folds):
        model = forest(vectors(samples.where(F.col(fold) != k), features), target, trees, depth)
        rows = samples.where(F.col(fold) == k).select(*key, target, F.transform(features, lambda x: x.cast("double")).alias("features"))
        paths = explain.decision_paths(rows, explain.node_table(model), key, target=target)
        part = explain.confusion(paths, key, target, all_features=width, **exponents)
        parts = part if parts is None else parts.union(part)
    worst = explain.worst_confusion(parts)
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("confusion"), "feature"))
    return worst.withColumn("kept", place > drop)


def lasso_selection(samples: DataFrame, target: str, exponent: float, penalty: float = 0.01, vector: str = "vector") -> list[int]:
    """Features whose L1-regularised coefficient exceeds 10 ** -exponent."""
    model = LinearRegression(featuresCol=vector, labelCol=target, regParam=penalty, elasticNetParam=1.0).fit(samples)
    return [i for i, c in enumerate(model.coefficients) if abs(c) > 10.0**-exponent]


def logistic_selection(samples: DataFrame, target: str, exponent: float, penalty: float = 0.01, vector: str = "vector") -> list[int]:
    """As M07, by logistic loss."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(featuresCol=vector, labelCol=target, regParam=penalty, elasticNetParam=1.0).fit(samples)
    return sorted({int(j) for row in model.coefficientMatrix.toArray() for j in np.flatnonzero(np.abs(row) > 10.0**-exponent)})


def hinge_coefficients(samples: DataFrame, target: str, classes: list[float], width: int, penalty: float = 0.01, features: str = "features", steps: int = 200, tolerance: float = 1e-5) -> np.ndarray:
    """Of each class against the others (of two classes the second), coefficients and intercept that minimise the mean squared hinge plus `penalty` times their absolute sum.

    Accelerated proximal steps, all classes in one scan each; tasks send a sum by feature and class, and
    the driver gets those of all tasks summed up.  The intercept isn't penalised.  The step follows from
    the largest eigenvalue of the features' second moments, found by scans as well.  Rows without
    target, with a missing feature or with too few of them are left out.
    """
    used = classes[1:] if len(classes) == 2 else classes
    x = F.transform(F.slice(features, 1, width), lambda v: v.cast("double"))
    rows = samples.select(F.col(target).cast("double").alias("y"), x.alias("x")).where(F.col("y").isNotNull() & (F.size("x") == width) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    held = written(rows, "hinge")
    n = held.count()
    if not n:
        return np.zeros((len(used), width + 1))

    def summed(of: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                if batch.num_rows:
                    own = np.stack(batch.column("x").to_numpy(zero_copy_only=False)) if width else np.zeros((batch.num_rows, 0))
                    part = of(np.hstack([own, np.ones((len(own), 1))]), batch.column("y").to_numpy())
                    total = part if total is None else total + part
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["i", "v"])

        found = held.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        return np.array([r.v for r in found])

    v = np.ones(width + 1)
    for _ in range(12):
        v = summed(lambda x, y, v=v / np.linalg.norm(v): x.T @ (x @ v)) / n
    rate = 1 / (2 * 1.1 * np.linalg.norm(v))
    signs = np.array(used)

    def slope(w: np.ndarray) -> np.ndarray:
        def of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            s = np.where(y[:, None] == signs, 1.0, -1.0)
            return (-2 * s * np.maximum(1 - s * (x @ w.T), 0)).T @ x

        return summed(of).reshape(w.shape) / n

    w = ahead = np.zeros((len(used), width + 1))
    t = 1.0
    for _ in range(steps):
        new = ahead - rate * slope(ahead)
        new[:, :-1] = np.sign(new[:, :-1]) * np.maximum(np.abs(new[:, :-1]) - rate * penalty, 0)
        moved = np.abs(new - w).max()
        if ((ahead - new) * (new - w)).sum() > 0:
            t, ahead = 1.0, new  # the pace carries on uphill: start it anew
        else:
            t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead = new + (last - 1) / t * (new - w)
        w = new
        if moved < tolerance * max(1.0, np.abs(w).max()):
            break
    removed(held)
    return w


def hinge_selection(samples: DataFrame, target: str, classes: list[float], width: int, exponent: float, **arguments: Any) -> list[int]:
    """Features that some class's hinge coefficient exceeds 10 ** -exponent of."""
    w = hinge_coefficients(samples, target, classes, width, **arguments)[:, :-1]
    return np.flatnonzero((np.abs(w) > 10.0**-exponent).any(axis=0)).tolist()


def importances(model: Any, names: list[str], least: float = 0.0005) -> list[tuple[str, float]]:
    """Named importances from the largest, those below `least` left out."""
    found = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray()) if v >= least]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def combined_predictions(sets: DataFrame, predictions: DataFrame, key: str, parts: str, part: str, prediction: str, combine: Callable = None) -> DataFrame:
    """The effect of each set of variants from its parts' predictions; an error if a part has none."""
    from variantlab.functions.expr import combined_effect

    rows = sets.select(key, F.explode(parts).alias(part)).join(predictions.select(part, prediction), part, "left")
    missing = F.count_if(F.col(prediction).isNull())
    out = rows.groupBy(key).agg(F.collect_list(prediction).alias("_p"), missing.alias("_missing"))
    effect = (combine or combined_effect)(F.col("_p"))
    return out.select(key, F.when(F.col("_missing") > 0, F.raise_error(F.lit("a part of a set has no prediction")).cast("double")).otherwise(effect).alias("effect"))


def looked_up(rows: DataFrame, predictions: DataFrame, key: list[str], prediction: str) -> DataFrame:
    """`rows` with the prediction of their key, NULL where there is none."""
    return rows.join(predictions.select(*key, prediction), key, "left")


def prediction_input(rows: DataFrame, key: list[str], known: dict[str, DataFrame], order: str, impute: dict[str, float], features: list[str]) -> DataFrame:
    """Rows to predict as a feature matrix: categories by the training's dictionaries, new ones after them; NULLs by the training's values."""
    for column, dictionary in known.items():
        every = encode.extended(dictionary, rows, column, order)
        rows = encode.encoded(rows, column, every, "_code").drop(column).withColumnRenamed("_code", column)
    return encode.matrix(clean.imputed(rows, impute), key, features)


def final_model(samples: DataFrame, target: str, kind: str = "forest", **arguments: Any) -> Any:
    """The model of all samples, a forest or boosted."""
    kinds = {"forest": forest, "boosted": boosted}
    if kind not in kinds:
        raise ValueError(f"no model named {kind!r}; there are forest and boosted")
    return kinds[kind](samples, target, **arguments)


@dataclass
class Search:
    """Bayesian search of a box, a Gaussian process with a Matern 5/2 kernel and expected improvement. The driver holds only observations."""

    bounds: dict[str, tuple[float, float]]
    whole: frozenset[str] = frozenset()
    seed: int = 1
    seen: list[tuple[dict[str, float], float]] = field(default_factory=list)

    def _unit(self, points: Iterable[dict[str, float]]) -> np.ndarray:
        return np.array([[(p[k] - a) / (b - a or 1) for k, (a, b) in self.bounds.items()] for p in points])

    @staticmethod
    def _kernel(a: np.ndarray, b: np.ndarray, scale: float = 0.3) -> np.ndarray:
        d = np.sqrt(5) * np.sqrt(np.maximum(((a[:, None] - b[None]) ** 2).sum(2), 0)) / scale
        return (1 + d + d * d / 3) * np.exp(-d)

    def _random(self, n: int, rng: np.random.Generator) -> list[dict[str, float]]:
        draws = [{k: float(rng.uniform(a, b)) for k, (a, b) in self.bounds.items()} for _ in range(n)]
        return [{k: float(round(v)) if k in self.whole else v for k, v in p.items()} for p in draws]

    def propose(self, start: int = 4, candidates: int = 500) -> dict[str, float]:
        """The next point: random at first, then that of the largest expected improvement that hasn't been seen."""
        rng = np.random.default_rng([self.seed, len(self.seen)])
        if len(self.seen) < start:
            return self._random(1, rng)[0]
        x, y = self._unit(p for p, _ in self.seen), np.array([v for _, v in self.seen])
        mean, sd = y.mean(), y.std() or 1.0
        root = np.linalg.cholesky(self._kernel(x, x) + 1e-6 * np.eye(len(x)))
        alpha = np.linalg.solve(root.T, np.linalg.solve(root, (y - mean) / sd))
        points = [p for p in self._random(candidates, rng) if all(p != q for q, _ in self.seen)]
        if not points:
            return self._random(1, rng)[0]
        near = self._kernel(self._unit(points), x)
        mu = near @ alpha
        spread = np.sqrt(np.maximum(1 - (np.linalg.solve(root, near.T) ** 2).sum(0), 1e-12))
        z = (mu - ((y - mean) / sd).max()) / spread
        from math import erf, sqrt

        cdf = np.array([0.5 * (1 + erf(v / sqrt(2))) for v in z])
        gain = spread * (z * cdf + np.exp(-z * z / 2) / np.sqrt(2 * np.pi))
        return points[int(gain.argmax())]

    def run(self, objective: Callable[[dict[str, float]], float], steps: int) -> tuple[dict[str, float], float]:
        """The best of `steps` points; larger is better."""
        for _ in range(steps):
            point = self.propose()
            self.seen.append((point, float(objective(point))))
        return max(self.seen, key=lambda s: s[1])

    def _step(self, name: str, steps: int) -> list[float]:
        values = np.linspace(*self.bounds[name], steps)
        return list(dict.fromkeys(float(round(v)) if name in self.whole else float(v) for v in values))

    def sweep(self, objective: Callable[[dict[str, float]], float], base: dict[str, float], names: str | list[str], steps: int) -> tuple[dict[str, float], float]:
        """A grid over one coordinate, or two or three together, the others held; points that were seen are left out."""
        names = [names] if isinstance(names, str) else names
        for values in product(*[self._step(name, steps) for name in names]):
            point = base | dict(zip(names, values))
            if all(point != q for q, _ in self.seen):
                self.seen.append((point, float(objective(point))))
        return max(self.seen, key=lambda s: s[1])

    def halved(self, objective: Callable[[dict[str, float]], float], base: dict[str, float], steps: int) -> tuple[dict[str, float], float]:
        """Searches each half of the parameters, halved again down to single ones, then all of them together, each from the best so far; observations go up."""
        self.seen.append((base, float(objective(base))))
        self._part(list(self.bounds), objective, steps)
        return max(self.seen, key=lambda s: s[1])

    def _part(self, names: list[str], objective: Callable[[dict[str, float]], float], steps: int) -> None:
        for half in (names[: len(names) // 2], names[len(names) // 2 :]) if len(names) > 1 else ():
            self._part(half, objective, steps)
        fixed = max(self.seen, key=lambda s: s[1])[0]
        sub = Search({k: self.bounds[k] for k in names}, self.whole, self.seed, [({k: p[k] for k in names}, v) for p, v in self.seen])
        known = len(sub.seen)
        sub.run(lambda p: objective(fixed | p), steps)
        self.seen += [(fixed | p, v) for p, v in sub.seen[known:]]

    def until_settled(self, objective: Callable[[dict[str, float]], float], base: dict[str, float], steps: int, size: int = 2) -> tuple[dict[str, float], float]:
        """Shuffles the parameters and searches groups of `size` in turn, until a whole pass improves nothing."""
        best = (base, float(objective(base)))
        self.seen.append(best)
        rng = np.random.default_rng(self.seed)
        while True:
            names = [str(n) for n in rng.permutation(list(self.bounds))]
            for at in range(0, len(names), size):
                self._part(names[at : at + size], objective, steps)
            found = max(self.seen, key=lambda s: s[1])
            if found[1] <= best[1]:
                return best
            best = found


def selected(kind: str, samples: DataFrame, **arguments: Any) -> list[int]:
    """The features that a named selection keeps: confusion (M04), lasso (M06), hinge (M07), or logistic, its smooth form."""
    if kind == "confusion":
        return sorted(r.feature for r in confusion_selection(samples, **arguments).where("kept").collect())
    methods = {"lasso": lasso_selection, "hinge": hinge_selection, "logistic": logistic_selection}
    if kind not in methods:
        raise ValueError(f"no selection named {kind!r}; there are confusion, lasso, hinge and logistic")
    return methods[kind](samples, **arguments)


def ensemble_info(model: Any) -> dict[str, int]:
    """Trees, nodes and splits."""
    nodes = model.totalNumNodes
    return {"trees": len(model.trees), "nodes": nodes, "splits": (nodes - len(model.trees)) // 2}


#: Bounds of the hyperparameters that a search may vary.
PARAMETERS = {"trees": (5.0, 400.0), "depth": (2.0, 12.0), "rate": (0.01, 0.5), "rounds": (5.0, 200.0)}


def saved(model: Any, path: str) -> None:
    """The model in its library's own format."""
    model.write().overwrite().save(path)


def loaded(kind: type, path: str) -> Any:
    """A saved model of a class, such as RandomForestRegressionModel."""
    return kind.load(path)
