"""Reports: errors, weak groups, score reductions, objectives, and the catalogue of features."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlab.functions.expr import feature_category
from variantlab.operators import stats
from variantlab.tables import leading


def with_error(rows: DataFrame, target: str, prediction: str) -> DataFrame:
    """Absolute errors."""
    return rows.withColumn("error", F.abs(F.col(target) - F.col(prediction)))


def weak_groups(groups: DataFrame, least: float = 0.3) -> DataFrame:
    """groups whose correlation is below a bound."""
    return groups.where(F.abs("r") < least)


def reduced(scores: DataFrame, by: list[str], score: str, fold: str) -> DataFrame:
    """Of repeated scores the first fold's, the mean and the worst."""
    return scores.groupBy(*by).agg(F.min_by(score, fold).alias("first_score"), F.avg(score).alias("mean_score"), F.min(score).alias("worst_score"))


def cumulative_spearman(rows: DataFrame, dataset: str, group: str, a: str, b: str) -> DataFrame:
    """For each dataset its own Spearman and the mean over its groups."""
    whole = stats.group_spearman(rows, [dataset], a, b, sliced=True).select(dataset, F.col("r").alias("spearman"))
    groups = stats.group_spearman(rows, [dataset, group], a, b).groupBy(dataset).agg(F.avg(F.abs("r")).alias("mean_spearman"))
    return whole.join(groups, dataset)


def ordinal_ranks(rows: DataFrame, value: str, by: list[str], key: str) -> DataFrame:
    """Rank without ties (by key where equal), and the smallest tied rank; no task needs a whole group."""
    placed = stats.numbered(rows, by, [value, key], "ordinal")
    ties = placed.groupBy(*by, value).agg(F.min("ordinal").alias("competition"))
    return stats.by_group(placed, ties, [*by, value], "inner")


def group_lists(rows: DataFrame, group: str, key: str, values: list[str], most: int = 100_000) -> DataFrame:
    """Each group's rows as arrays in order of the key, in parts (from 0) of at most `most` rows."""
    placed = stats.numbered(rows.select(group, key, *values), [group], [key, *values], "_n")
    part = F.floor((F.col("_n") - 1) / most).cast("long").alias("part")
    return placed.groupBy(group, part).agg(F.sort_array(F.collect_list(F.struct(key, *values))).alias("rows"))


@dataclass(frozen=True)
class Objective:
    """A metric and whether larger is better."""

    name: str
    larger: bool = True

    def better(self, new: float | None, old: float | None) -> bool:
        if new is None or old is None:
            return old is None and new is not None
        return new > old if self.larger else new < old

    def gain(self, new: float, old: float) -> float:
        return new - old if self.larger else old - new


OBJECTIVES = {o.name: o for o in (Objective("mean_spearman"), Objective("spearman"), Objective("pearson"), Objective("r2"), Objective("mse", False), Objective("mcc"), Objective("auc"), Objective("mean_auc"), Objective("f1"), Objective("accuracy"))}


def estimated_full(first: float, known_first: float, known_full: float) -> float:
    """A score over all folds from the first fold's, by the difference that another run had."""
    return first + known_full - known_first


def interrupted(first: float, best_first: float | None, share: float = 0.95) -> bool:
    """Whether cross-validation may stop after a first fold that is too far below the best."""
    return best_first is not None and first < share * best_first


def trials(rows: DataFrame, study: str, run: str, fold: str, score: str, objective: Objective, share: float = 0.95) -> DataFrame:
    """Each run of a study, in the order of runs, beside the best run before it.

    first_score is that of the run's smallest fold (the smaller score of equal folds), full_score the mean
    over folds.  best_first and best_full are those of the earlier run with the best mean (of equals the
    one with the better first fold), NULL for a study's first run.  improved tells whether the mean beats it,
    gain by how much, estimated what the mean would be from the first fold alone, and interrupted whether
    validation could have ended after the first fold.  Rows without study, run, fold or a score don't count.
    The best so far is a running maximum over slices, so a study may have most of the rows.
    """
    sign = F.lit(1.0 if objective.larger else -1.0)
    given = rows.select(F.col(study).alias("_study"), F.col(run).alias("_run"), F.col(fold).alias("_fold"), F.col(score).cast("double").alias("_score")).dropna()
    runs = given.groupBy("_study", "_run").agg(F.min(F.struct("_fold", "_score"))["_score"].alias("first_score"), F.avg("_score").alias("full_score"))
    led = leading(runs, ["_study", "_run"], "_best", F.struct("_study", (sign * F.col("full_score")).alias("full"), (sign * F.col("first_score")).alias("first")))
    own = F.col("_best._study") == F.col("_study")
    led = led.withColumns({"best_first": F.when(own, sign * F.col("_best.first")), "best_full": F.when(own, sign * F.col("_best.full"))})
    gain = sign * (F.col("full_score") - F.col("best_full"))
    low = F.col("first_score") < share * F.col("best_first") if objective.larger else share * F.col("first_score") > F.col("best_first")
    estimated = F.col("first_score") + F.col("best_full") - F.col("best_first")
    flags = (F.coalesce(gain > 0, F.lit(True)).alias("improved"), gain.alias("gain"), estimated.alias("estimated"), F.coalesce(low, F.lit(False)).alias("interrupted"))
    return led.select(F.col("_study").alias(study), F.col("_run").alias(run), "first_score", "full_score", "best_first", "best_full", *flags)


def catalogue(spark: SparkSession, features: list[tuple]) -> DataFrame:
    """Name, type, group, default (text or none) and whether it depends on the mutant residue, and the category, of features given as tuples of the first three to five."""
    full = [(*f, *(None, False)[len(f) - 3 :]) for f in features]
    rows = spark.createDataFrame([(*f[:3], None if f[3] is None else str(f[3]), bool(f[4])) for f in full], "feature string, f_type string, grp string, default string, mutation_specific boolean")
    return rows.withColumn("category", feature_category(F.col("feature")))


#: Spark's type of each feature type.
TYPES = {"real": "double", "integer": "long", "binary": "int", "categorical": "string"}


def filled(rows: DataFrame, features: list[tuple]) -> DataFrame:
    """The features' columns in their types, missing values as the features' defaults."""
    own = {f[0]: (TYPES[f[1]], f[3] if len(f) > 3 else None) for f in features}
    cells = {name: F.coalesce(F.col(f"`{name}`").try_cast(kind), F.lit(default).try_cast(kind)) for name, (kind, default) in own.items() if name in rows.columns}
    return rows.withColumns(cells)


def active(features: list[str], groups: dict[str, str], without: set[str] = frozenset(), dropped: set[str] = frozenset()) -> list[str]:
    """sorted names of features that are neither dropped nor of a dropped group."""
    return sorted(f for f in features if groups.get(f) not in without and f not in dropped)


def bound(value: float | str, features: int) -> float:
    """A bound, 'max' standing for the last feature's number."""
    return float(features - 1) if value == "max" else float(value)


def cross_validated(folds: int, fit_and_score: Callable[[int], float], best_first: float | None = None) -> list[float]:
    """Scores of folds in order, ended after the first if it is too far below the best."""
    scores = []
    for k in range(folds):
        scores.append(fit_and_score(k))
        if k == 0 and interrupted(scores[0], best_first):
            break
    return scores
