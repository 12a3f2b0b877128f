"""Feature statistics by pair, redundancy filters and rankings of features.

Features come in long form: (sample, feature, value); their number is that of columns, so tables of
features or feature pairs are small whatever the number of samples.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from variantlab.operators.pairs import pair_ranks
from variantlab.operators.stats import ranked, safe_corr


def pair_statistics(long: DataFrame, sample: str, target: str | None = None, feature: str = "feature", value: str = "value", complete: bool = False) -> DataFrame:
    """Spearman of every pair of features over rows where both are given, and coverages.

    feat_a < feat_b by name.  cov_a and cov_b are shares of all samples, cov_both that of samples
    with both among those with either.  With `target`, tv_a and tv_b are each feature's Spearman with
    it.  complete: no value is NULL, so ranks are taken once for a feature instead of once for a pair.
    A sample has a feature once; rows without sample or feature don't count.
    """
    rows = long.where(F.col(sample).isNotNull() & F.col(feature).isNotNull()).select(sample, feature, F.col(value).cast("double").alias("v"), *([target] if target else []))
    given = rows.where("v is not null")
    total = rows.select(sample).distinct().agg(F.count("*").alias("n_all"))
    each = given.groupBy(feature).agg(F.count("*").alias("n"))
    if target:
        each = each.join(target_correlation(given.select(feature, "v", target), target, feature, "v"), feature, "left")
    if complete:
        out = _rank_matrix(given, sample, feature)
        return _with_cover(out, each, total, feature, bool(target))
    return _with_cover(pair_ranks(given, sample, feature), each, total, feature, bool(target))


def _rank_matrix(given: DataFrame, sample: str, feature: str) -> DataFrame:
    """Pairs of features with n_both and corr, where every sample has every feature.

    Ranks are taken in slices, a sample's ranks become one vector, and the vectors' Gram matrix is
    summed up task by task: samples are never multiplied by pairs, and the driver gets features squared.
    """
    names = [r[0] for r in given.select(feature).distinct().orderBy(feature).collect()]
    n = given.select(sample).distinct().count()
    ranks = ranked(given, "v", "r", [feature])
    rows = ranks.groupBy(sample).agg(F.transform(F.sort_array(F.collect_list(F.struct(feature, "r"))), lambda s: s["r"]).alias("x"))
    found = Correlation.corr(rows.select(array_to_vector("x").alias("x")), "x", "pearson").first()[0].toArray() if n > 1 else None
    pairs = [(a, b, n, None if found is None or math.isnan(found[i, j]) else float(found[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return given.sparkSession.createDataFrame(pairs, "feat_a string, feat_b string, n_both long, corr double")


def _with_cover(out: DataFrame, each: DataFrame, total: DataFrame, feature: str, target: bool) -> DataFrame:
    extra = ["tv"] if target else []
    for side in "ab":
        out = out.join(each.select(F.col(feature).alias(f"feat_{side}"), F.col("n").alias(f"n_{side}"), *[F.col(x).alias(f"{x}_{side}") for x in extra]), f"feat_{side}")
    out = out.crossJoin(F.broadcast(total))
    share = F.try_divide(F.col("n_both"), F.col("n_a") + F.col("n_b") - F.col("n_both"))
    return out.select("feat_a", "feat_b", "corr", (F.col("n_a") / F.col("n_all")).alias("cov_a"), (F.col("n_b") / F.col("n_all")).alias("cov_b"), share.alias("cov_both"), *[f"tv_{s}" for s in "ab" if target])


def correlated_filter(pairs: DataFrame, order: list[str], threshold: float, least_cover: float = 0.01, mode: str = "as_written") -> list[str]:
    """Features that a scan in the given order drops as redundant, sorted.

    A kept feature drops every other kept one that correlates above the threshold where both cover
    enough.  mode "by_score" drops the one with the smaller coverage times |target correlation|.
    The pairs above the threshold are a table of features, not of samples, and fit the driver.
    """
    edges: dict[str, set[str]] = {}
    score: dict[str, float] = {}
    for row in pairs.where((F.abs("corr") > threshold) & (F.col("cov_both") > least_cover)).toLocalIterator():
        edges.setdefault(row.feat_a, set()).add(row.feat_b)
        edges.setdefault(row.feat_b, set()).add(row.feat_a)
        if mode == "by_score":
            score[row.feat_a], score[row.feat_b] = row.cov_a * abs(row.tv_a or 0), row.cov_b * abs(row.tv_b or 0)
    gone: set[str] = set()
    for name in order:
        for other in sorted(edges.get(name, ()), key=order.index):
            if name in gone:
                break
            if other not in gone:
                gone.add(name if mode == "by_score" and score[name] < score[other] else other)
    return sorted(gone)


def constant_features(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Features with one value at most."""
    return long.groupBy(feature).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low is null or low = high").select(feature)


def target_correlation(long: DataFrame, target: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """Spearman of each feature with the target; NULL if it can't be had."""
    rows = long.where(F.col(value).isNotNull() & F.col(target).isNotNull())
    ranks = ranked(ranked(rows.select(feature, value, target), value, "_a", [feature]), target, "_b", [feature])
    return ranks.groupBy(feature).agg(safe_corr("_a", "_b").alias("tv"))


def bias_scores(long: DataFrame, group: str, target: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """|correlation with the group's mean target| minus |correlation with the target|, by feature."""
    means = long.select(group, target).groupBy(group).agg(F.avg(target).alias("_mean"))
    rows = long.join(means, group)
    a = target_correlation(rows, "_mean", feature, value).withColumnRenamed("tv", "_a")
    b = target_correlation(rows, target, feature, value).withColumnRenamed("tv", "_b")
    return a.join(b, feature).select(feature, (F.abs("_a") - F.abs("_b")).alias("bias"))


def rank_table(scores: DataFrame, name: str, score: str) -> DataFrame:
    """Place from the best, smallest tied rank, score, and score scaled to 0..1; one row per feature."""
    best = Window.orderBy(F.desc(score))
    every = Window.partitionBy()
    low, high = F.min(score).over(every), F.max(score).over(every)
    return scores.select(
        name,
        (F.row_number().over(Window.orderBy(F.desc(score), name)) - 1).cast("long").alias("place"),
        (F.rank().over(best) - 1).cast("long").alias("low_rank"),
        F.col(score).alias("score"),
        F.try_divide(F.col(score) - low, high - low).alias("scaled"),
    )


def lowest(scores: DataFrame, name: str, score: str, k: int) -> DataFrame:
    """The k features with the smallest score; none are dropped for k = 0."""
    return scores.orderBy(score, name).limit(k) if k else scores


def harmful(impacts: DataFrame, threshold: float, name: str = "feature", impact: str = "impact") -> DataFrame:
    """Features whose impact reaches the threshold."""
    return impacts.where(F.col(impact) >= threshold).select(name)


def without_most_biased(scores: DataFrame, k: int, name: str = "feature", bias: str = "bias") -> DataFrame:
    """Features but the k with the largest bias, undefined ones last."""
    gone = scores.orderBy(F.desc_nulls_last(bias), name).limit(k).select(name)
    return scores.join(F.broadcast(gone), name, "left_anti")
