"""Trees as node tables, errors and attributions along decision paths, and their roll-ups."""

from __future__ import annotations

from collections.abc import Callable
from math import factorial
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variantlab.functions.expr import warped_error


def nearest(rows: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """`rows` with the greatest threshold not above the value and the least above it."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    below = F.array_max(F.filter(grid, lambda t: t <= F.col(value)))
    above = F.array_min(F.filter(grid, lambda t: t > F.col(value)))
    return rows.withColumns({"below": below, "above": above})


def category_rollup(values: DataFrame, catalog: DataFrame, group: str, feature: str, value: str, category: str = "category") -> DataFrame:
    """The sum of values by group and category, and the feature with the largest of them there.

    The catalogue has a row per feature; Spark broadcasts it while its size allows.
    """
    joined = values.join(catalog.select(feature, category), feature)
    best = F.max_by(feature, F.struct(F.abs(value), -F.col(feature) if dict(values.dtypes)[feature] != "string" else F.col(feature)))
    return joined.groupBy(group, category).agg(F.sum(value).alias("total"), best.alias("strongest"))


def path_weights(rows: DataFrame, path: str, depth: str, name: str) -> DataFrame:
    """The running product of log2(depth + 1) along each path."""
    along = Window.partitionBy(path).orderBy(depth).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.exp(F.sum(F.log(F.log2(F.col(depth) + 1))).over(along)))


def node_table(model: Any) -> list[tuple[int, int, int, int, int, float, float, int, float]]:
    """(tree, node, left, right, feature, threshold, prediction, depth, cover) of a fitted tree ensemble.

    left is -1 for a leaf; depth is 1 at the root; cover is the weight of the training rows that came to
    the node.  A model fits the driver.
    """
    out = []
    for t, tree in enumerate(model.trees):
        root = tree._call_java("rootNode")
        todo, count = [(root, 0, 1)], 1
        while todo:
            node, number, depth = todo.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                out.append((t, number, -1, -1, -1, 0.0, float(node.prediction()), depth, float(node.impurityStats().count())))
                continue
            left, right = count, count + 1
            count += 2
            out.append((t, number, left, right, int(node.split().featureIndex()), float(node.split().threshold()), float(node.prediction()), depth, float(node.impurityStats().count())))
            todo += [(node.leftChild(), left, depth + 1), (node.rightChild(), right, depth + 1)]
    return out


def tree_weights(model: Any) -> list[float]:
    """What each tree's prediction counts in the ensemble's sum: 1 / trees in a forest, the learnt weights in boosting."""
    weights = [float(w) for w in model.treeWeights]
    return weights if "GBT" in type(model).__name__ else [w / sum(weights) for w in weights]


def base_value(nodes: list[tuple], weights: list[float]) -> float:
    """The ensemble's prediction at its roots, which contributions are added to."""
    roots = {n[0]: n[6] for n in nodes if n[1] == 0}
    return sum(w * roots[t] for t, w in enumerate(weights))


def _trees(nodes: list[tuple]) -> list[dict[str, np.ndarray]]:
    out = []
    for t in sorted({n[0] for n in nodes}):
        own = sorted(n for n in nodes if n[0] == t)
        columns = list(zip(*own))
        names = ("left", "right", "feature", "threshold", "prediction", "depth", "cover")
        out.append({k: np.array(c) for k, c in zip(names, columns[2:])})
    return out


def decision_paths(samples: DataFrame, nodes: list[tuple], key: list[str], features: str = "features", target: str | None = None) -> DataFrame:
    """One row per sample, tree and decision: node, feature, its value, the node's threshold, depth (1 at the root), the tree's prediction.

    All rows of a batch walk a tree together; the nodes are broadcast, their size is the model's.
    """
    shared = samples.sparkSession.sparkContext.broadcast(_trees(nodes))
    kept = [*key, *([target] if target else [])]
    schema = samples.select(*kept).schema.add("tree", "integer").add("node", "integer").add("feature", "integer").add("depth", "integer").add("threshold", "double").add("value", "double").add("prediction", "double")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            x = np.stack(pdf[features].to_numpy()) if len(pdf) else np.empty((0, 0))
            for t, tree in enumerate(shared.value):
                at, rows, steps = np.zeros(len(x), int), np.arange(len(x)), []
                while len(rows):
                    inner = tree["left"][at[rows]] >= 0
                    rows = rows[inner]
                    node = at[rows]
                    steps.append((rows, node))
                    go = x[rows, tree["feature"][node]] <= tree["threshold"][node]
                    at[rows] = np.where(go, tree["left"][node], tree["right"][node])
                rows, node = np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])
                out = pdf[kept].iloc[rows].reset_index(drop=True)
                yield out.assign(tree=np.int32(t), node=node.astype("int32"), feature=tree["feature"][node].astype("int32"), depth=tree["depth"][node].astype("int32"), threshold=tree["threshold"][node], value=x[rows, tree["feature"][node]], prediction=tree["prediction"][at[rows]])

    return samples.select(*kept, features).mapInPandas(run, schema)


def raw_errors(paths: DataFrame, key: list[str], target: str) -> DataFrame:
    """Feature, error (target and tree's prediction apart) and weight (by the place on the path) of every decision; stored, it serves any exponents."""
    along = Window.partitionBy(*key, "tree").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.exp(F.sum(F.log(F.log2(F.col("depth") + 1))).over(along))
    return paths.select("feature", (F.col("prediction") - F.col(target)).alias("error"), weight.alias("weight"))


def confusion(paths: DataFrame, key: list[str], target: str, power: float = 1.0, norm: float = 1.0, goodwill: float = 0.0, all_features: int | None = None) -> DataFrame:
    """By feature the summed warped errors of the trees that decide by it, each weighted by its place on the path, by count ** norm, to five places."""
    return confusion_of(raw_errors(paths, key, target), power, norm, goodwill, all_features)


def confusion_of(raw: DataFrame, power: float = 1.0, norm: float = 1.0, goodwill: float = 0.0, all_features: int | None = None) -> DataFrame:
    """The confusion of features from stored raw errors, for any exponents.  Features that no path uses get 1 - goodwill."""
    error = F.abs(warped_error(F.col("error"), F.lit(0.0), power))
    by_tree = raw.select("feature", (error * F.col("weight")).alias("e")).groupBy("feature").agg(F.sum("e").alias("total"), F.count("*").alias("n"))
    out = by_tree.select("feature", F.round(F.col("total") / F.pow(F.col("n").cast("double"), F.lit(norm)), 5).alias("confusion"), "n")
    if all_features is not None:
        every = raw.sparkSession.range(all_features).select(F.col("id").cast("int").alias("feature"))
        out = every.join(out, "feature", "left").select("feature", F.coalesce("confusion", F.lit(1 - goodwill)).alias("confusion"), F.coalesce("n", F.lit(0)).alias("n"))
    return out


def worst_confusion(parts: DataFrame) -> DataFrame:
    """The largest confusion of a feature over folds."""
    return parts.groupBy("feature").agg(F.max("confusion").alias("confusion"))


def _contributions(samples: DataFrame, key: list[str], features: str, target: str | None, sums: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """`sums` of each batch's feature matrix in long form: a row per sample and feature whose value isn't 0."""
    kept = [*key, *([target] if target else [])]
    schema = samples.select(*kept).schema.add("feature", "integer").add("value", "double")

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            total = sums(np.stack(pdf[features].to_numpy()))
            rows, f = np.nonzero(total)
            yield pdf[kept].iloc[rows].reset_index(drop=True).assign(feature=f.astype("int32"), value=total[rows, f])

    return samples.select(*kept, features).mapInPandas(run, schema)


def attributions(samples: DataFrame, nodes: list[tuple], key: list[str], features: str = "features", target: str | None = None, weights: list[float] | None = None) -> DataFrame:
    """M15, by path: each feature's contribution to a sample's prediction, in long form.

    A step from a node to its child adds the change of the nodes' mean prediction, times what the tree
    counts in the ensemble (`tree_weights`, without any the same for all), to the feature that the node
    splits by (path attribution); contributions and `base_value` sum to the ensemble's prediction.
    """
    trees = _trees(nodes)
    shared = samples.sparkSession.sparkContext.broadcast((trees, weights or [1 / len(trees)] * len(trees)))

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.zeros(x.shape)
        for tree, weight in zip(*shared.value):
            at, rows = np.zeros(len(x), int), np.arange(len(x))
            while len(rows := rows[tree["left"][at[rows]] >= 0]):
                node = at[rows]
                f = tree["feature"][node]
                child = np.where(x[rows, f] <= tree["threshold"][node], tree["left"][node], tree["right"][node])
                total[rows, f] += weight * (tree["prediction"][child] - tree["prediction"][node])
                at[rows] = child
        return total

    return _contributions(samples, key, features, target, sums)


def _boxes(tree: dict[str, np.ndarray]) -> list[tuple[float, list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Each leaf's prediction, the features on its path, the bounds (above, up to) of each, and the share of rows that pass all splits by it."""
    out, todo = [], [(0, {})]
    while todo:
        node, path = todo.pop()
        if tree["left"][node] < 0:
            f = list(path)
            out.append((float(tree["prediction"][node]), f, *np.array([path[i] for i in f]).reshape(-1, 3).T))
            continue
        f, t = int(tree["feature"][node]), float(tree["threshold"][node])
        low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
        left, right = int(tree["left"][node]), int(tree["right"][node])
        of = share / (tree["cover"][node] or 1.0)
        todo.append((left, path | {f: (low, min(high, t), of * tree["cover"][left])}))
        todo.append((right, path | {f: (max(low, t), high, of * tree["cover"][right])}))
    return out


def shapley(samples: DataFrame, nodes: list[tuple], key: list[str], features: str = "features", target: str | None = None, weights: list[float] | None = None) -> DataFrame:
    """Each feature's Shapley value for a sample's prediction, in long form, where unknown features follow the training rows' shares.

    A leaf counts in a coalition as a product over the features of its path: whether the sample passes
    (in the coalition) or the share of rows that do (outside).  Sums over coalitions of one size are the
    coefficients of a product of linear terms, so a leaf costs the cube of its path's features, not
    their power set.  Values and `base_value` sum to the ensemble's prediction.
    """
    boxes = [_boxes(tree) for tree in _trees(nodes)]
    shared = samples.sparkSession.sparkContext.broadcast((boxes, weights or [1 / len(boxes)] * len(boxes)))

    def sums(x: np.ndarray) -> np.ndarray:
        total = np.zeros(x.shape)
        for leaves, weight in zip(*shared.value):
            for prediction, path, low, high, share in leaves:
                n = len(path)
                passes = (~(x[:, path] <= low) & ((x[:, path] <= high) | np.isinf(high))).astype(float)
                by_size = [factorial(k) * factorial(n - 1 - k) / factorial(n) for k in range(n)]
                for i in range(n):
                    sizes = np.zeros((len(x), n))
                    sizes[:, 0] = 1.0
                    for j in set(range(n)) - {i}:
                        grown = sizes * share[j]
                        grown[:, 1:] += sizes[:, :-1] * passes[:, j : j + 1]
                        sizes = grown
                    total[:, path[i]] += weight * prediction * (passes[:, i] - share[i]) * (sizes @ by_size)
        return total

    return _contributions(samples, key, features, target, sums)


def impacts(contributions: DataFrame, predicted: DataFrame, key: list[str], target: str, prediction: str) -> DataFrame:
    """By feature the mean over samples of |y - p| - |y - (p - contribution)|; positive where the feature hurts."""
    n = predicted.agg(F.count("*").alias("_n"))
    joined = contributions.select(*key, "feature", "value").join(predicted.select(*key, target, prediction), key)
    gain = F.abs(F.col(target) - F.col(prediction)) - F.abs(F.col(target) - (F.col(prediction) - F.col("value")))
    return joined.groupBy("feature").agg(F.sum(gain).alias("_s")).crossJoin(F.broadcast(n)).select("feature", (F.col("_s") / F.col("_n")).alias("impact"))


def tree_spread(paths: DataFrame, key: list[str], sample: bool = True) -> DataFrame:
    """The deviation of the trees' predictions for each sample."""
    each = paths.groupBy(*key, "tree").agg(F.first("prediction").alias("p"))
    return each.groupBy(*key).agg((F.stddev_samp if sample else F.stddev_pop)("p").alias("tree_sd"))


def first_decisions(paths: DataFrame, key: list[str], most: int = 50) -> DataFrame:
    """Of each sample its first `most` decisions, by tree and depth."""
    order = Window.partitionBy(*key).orderBy("tree", "depth")
    return paths.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def explained(paths: DataFrame, key: list[str], ensemble: str) -> DataFrame:
    """By sample and feature the weight of the trees that decide by it, and the nearest thresholds (`below`, `above`) around its value there.

    A tree weighs the mean distance of the sample's trees from the ensemble's prediction less its own,
    once for each feature however often it splits by it; trees without a decision count for nothing.
    """
    distance = F.abs(F.first(ensemble) - F.first("prediction"))
    trees = paths.groupBy(*key, "tree").agg(distance.alias("_e"))
    weights = trees.withColumn("weight", F.avg("_e").over(Window.partitionBy(*key)) - F.col("_e")).drop("_e")
    under = F.col("threshold") <= F.col("value")
    cuts = paths.groupBy(*key, "tree", "feature").agg(F.max(F.when(under, F.col("threshold"))).alias("below"), F.min(F.when(~under, F.col("threshold"))).alias("above"))
    return cuts.join(weights, [*key, "tree"]).groupBy(*key, "feature").agg(F.sum("weight").alias("weight"), F.max("below").alias("below"), F.min("above").alias("above"))


def feature_trees(nodes: DataFrame) -> DataFrame:
    """The trees that use each feature."""
    return nodes.where("left >= 0").groupBy("feature").agg(F.sort_array(F.collect_set("tree")).alias("trees"))


def tree_extremes(paths: DataFrame, key: list[str], target: str) -> DataFrame:
    """Of each sample the trees that come nearest to and stay furthest from its target."""
    error = F.abs(F.col(target) - F.col("prediction"))
    return paths.groupBy(*key).agg(F.min_by("tree", F.struct(error, "tree")).alias("best_tree"), F.max_by("tree", F.struct(error, -F.col("tree"))).alias("worst_tree"))


def sample_losses(paths: DataFrame, key: list[str], target: str, power: float = 1.0) -> DataFrame:
    """A sample's errors summed over trees."""
    each = paths.groupBy(*key, "tree").agg(F.abs(warped_error(F.first("prediction"), F.first(target), power)).alias("e"))
    return each.groupBy(*key).agg(F.sum("e").alias("loss"))


def leaves(samples: DataFrame, nodes: list[tuple], key: list[str], features: str = "features") -> DataFrame:
    """The key, tree and leaf (its node) of every sample in every tree."""
    shared = samples.sparkSession.sparkContext.broadcast(_trees(nodes))
    schema = samples.select(*key).schema.add("tree", "integer").add("leaf", "integer")

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf[features].to_numpy()) if len(pdf) else np.empty((0, 0))
            for t, tree in enumerate(shared.value):
                at, rows = np.zeros(len(x), int), np.arange(len(x))
                while len(rows := rows[tree["left"][at[rows]] >= 0]):
                    node = at[rows]
                    at[rows] = np.where(x[rows, tree["feature"][node]] <= tree["threshold"][node], tree["left"][node], tree["right"][node])
                yield pdf[key].reset_index(drop=True).assign(tree=np.int32(t), leaf=at.astype("int32"))

    return samples.select(*key, features).mapInPandas(run, schema)


def tree_distances(leaves: DataFrame, key: list[str]) -> DataFrame:
    """tree_a < tree_b, n (samples that both have) and distance: the share of pairs of those samples that one tree puts into one leaf and the other apart.

    Pairs of samples are counted from the table of leaf by leaf: a sample makes a row for each pair of
    trees, and these are counted before anything is shuffled by trees and leaves.  Trees with fewer than
    two samples in common have no distance.
    """
    a = leaves.select(*key, F.col("tree").alias("tree_a"), F.col("leaf").alias("_a"))
    b = leaves.select(*key, F.col("tree").alias("tree_b"), F.col("leaf").alias("_b"))
    both = a.join(b, key).where("tree_a < tree_b").groupBy("tree_a", "tree_b", "_a", "_b").agg(F.count("*").alias("_n"))
    square = lambda *by: both.groupBy("tree_a", "tree_b", *by).agg(F.sum("_n").alias("_m")).groupBy("tree_a", "tree_b").agg(F.sum(F.col("_m") * F.col("_m")).alias("s" + "".join(by)), F.sum("_m").alias("n"))
    out = square("_a", "_b").join(square("_a").drop("n"), ["tree_a", "tree_b"]).join(square("_b").drop("n"), ["tree_a", "tree_b"])
    apart = F.col("s_a") + F.col("s_b") - 2 * F.col("s_a_b")
    return out.select("tree_a", "tree_b", "n", F.try_divide(apart, F.col("n") * (F.col("n") - 1)).alias("distance"))


def representative_trees(distances: DataFrame) -> DataFrame:
    """Tree, mean_distance to the others, and rank from the most representative one, the medoid; ties by the tree's number."""
    both = distances.select(F.col("tree_a").alias("tree"), "distance").union(distances.select(F.col("tree_b").alias("tree"), "distance"))
    means = both.groupBy("tree").agg(F.avg("distance").alias("mean_distance"))
    return means.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_distance").isNull(), F.round("mean_distance", 9), "tree")))


def nearest_tree(paths: DataFrame, key: list[str], ensemble: str) -> DataFrame:
    """Of each sample the tree whose prediction is nearest to the ensemble's; ties by the tree's number."""
    each = paths.groupBy(*key, "tree").agg(F.abs(F.first("prediction") - F.first(ensemble)).alias("_d"))
    return each.groupBy(*key).agg(F.min_by("tree", F.struct("_d", "tree")).alias("tree"), F.min("_d").alias("distance"))
