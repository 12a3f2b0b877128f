"""Filters, outliers, imputation and target transforms on sample tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variantlab.functions import expr


def standard_filter(samples: DataFrame, *, group: str, target: str, tags: str | None = None, aac: str | None = None, drop_groups: list[str] | None = None, drop_tags: list[str] | None = None, for_prediction: bool = False, synonymous: bool = False) -> DataFrame:
    """drops synonymous variants, blacklisted groups, samples with a tag of the set, and undefined targets."""
    keep: Column = F.lit(True)
    if aac and not synonymous:
        keep &= expr.wild_type(F.col(aac)) != expr.mutant(F.col(aac))
    if drop_groups:
        keep &= ~F.col(group).isin(drop_groups)
    if tags and drop_tags:
        keep &= ~F.coalesce(F.arrays_overlap(F.split(tags, ","), F.array(*map(F.lit, drop_tags))), F.lit(False))
    if not for_prediction:
        keep &= F.col(target).isNotNull() & (F.lower(F.col(target).cast("string")) != "nan")
    return samples.where(keep)


def enough_structures(samples: DataFrame, count: str, least: int) -> DataFrame:
    """F02."""
    return samples.where(F.coalesce(F.col(count), F.lit(0)) >= least)


def with_target(samples: DataFrame, target: str) -> DataFrame:
    """a support table's samples need a target."""
    return samples.where(F.col(target).isNotNull())


def non_finite(x: Column) -> Column:
    """F10."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def histogram_outliers(samples: DataFrame, target: str) -> DataFrame:
    """drops samples in bins of the target's histogram that hold next to nobody.

    int(4 log10 N) bins of one width; a bin with at most int(log10 N) members goes.  The maximum
    belongs to the last bin; if all targets are equal, all stay, as do samples without a target.
    Bounds and counts are one row each or one per bin, so the join is a broadcast of a known size.
    """
    bounds = samples.agg(F.count(target).alias("n"), F.min(target).alias("low"), F.max(target).alias("high")).first()
    if not bounds.n or bounds.low == bounds.high:
        return samples
    bins, few = int(math.log10(bounds.n) * 4), int(math.log10(bounds.n))
    if bins < 1:
        return samples
    width = (bounds.high - bounds.low) / bins
    place = F.least(F.floor((F.col(target) - bounds.low) / width), F.lit(bins - 1))
    counts = samples.where(F.col(target).isNotNull()).groupBy(place.alias("_bin")).count().where(F.col("count") <= few)
    thin = [r["_bin"] for r in counts.collect()]  # at most `bins` of them
    return samples.where(F.col(target).isNull() | ~place.isin(thin)) if thin else samples


def impute_values(samples: DataFrame, columns: list[str]) -> dict[str, float]:
    """What to put for NULLs of each column: as far below the minimum as the range is wide, 0 where all are NULL."""
    row = samples.agg(*[F.min(c).alias(f"{c}__low") for c in columns], *[F.max(c).alias(f"{c}__high") for c in columns]).first()
    out = {}
    for c in columns:
        low, high = row[f"{c}__low"], row[f"{c}__high"]
        out[c] = 0.0 if low is None else float(low - abs(high - low))
    return out


def imputed(samples: DataFrame, values: dict[str, float]) -> DataFrame:
    """NULLs replaced by the value of their column."""
    return samples.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in values.items()})


def coverage(long: DataFrame, group: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """For each group and feature the share of values given, the share of zeros among all, and the total."""
    x = F.col(value)
    return long.groupBy(group, feature).agg(
        F.avg(x.isNotNull().cast("int")).alias("cov"), F.avg(F.coalesce((x == 0).cast("int"), F.lit(0))).alias("zeros"), F.count("*").alias("total")
    )


def coverage_matrix(long: DataFrame, group: str, features: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """The coverages as one row per group; the features are named, so no scan looks for them."""
    x = F.col(value)
    out = long.groupBy(group).pivot(feature, features).agg(F.avg(x.isNotNull().cast("int")).alias("cov"), F.avg(F.coalesce((x == 0).cast("int"), F.lit(0))).alias("zeros"), F.count(F.lit(1)).alias("total"))
    return out


def poor_groups(cover: DataFrame, group: str, feature_name: str, least: float = 0.5, most_zeros: float = 0.5, feature: str = "feature") -> DataFrame:
    """groups in which a feature is given too rarely or is zero too often; drop them by an anti join."""
    return cover.where((F.col(feature) == feature_name) & ((F.col("cov") < least) | (F.col("zeros") > most_zeros))).select(group)


def pure_groups(samples: DataFrame, group: str, target: str) -> DataFrame:
    """Rows and distinct targets of each group, and whether it is pure."""
    out = samples.where(F.col(target).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(target).alias("n_targets"))
    return out.withColumn("pure", F.col("n_targets") == 1)


def size_histogram(samples: DataFrame, group: str, most: int = 41) -> DataFrame:
    """How many groups have each number of samples, larger numbers together."""
    sizes = samples.groupBy(group).count().select(F.least("count", F.lit(most)).alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_groups"))


def label_mixture(samples: DataFrame, group: str, positive: Column, ratio: float = 4.0) -> DataFrame:
    """Number of groups that are pure, of a clear majority (ratio or more), or mixed."""
    counts = samples.groupBy(group).agg(F.count_if(positive).alias("a"), F.count_if(~positive).alias("b"))
    low, high = F.least("a", "b"), F.greatest("a", "b")
    kind = F.when(low == 0, "pure").when(high >= low * ratio, "major").otherwise("mixed")
    return counts.groupBy(kind.alias("kind")).agg(F.count("*").alias("n_groups"))


def fused_positions(samples: DataFrame, group: str, site: str, target: str, features: list[str], order: str, low: float = 0.25) -> DataFrame:
    """One row per site: label 0 if any target is below `low`, else 1, and the features of the first mutant."""
    first = [F.min_by(f, order).alias(f) for f in features]
    return samples.groupBy(group, site).agg(F.min(F.when(F.col(target) < low, 0).otherwise(1)).alias("label"), F.count("*").alias("n"), *first)


def reversed_variants(samples: DataFrame, aac: str, target: str, threshold: float) -> DataFrame:
    """Samples and their reversals, residues swapped and the target taken from the threshold."""
    a = F.col(aac)
    back = expr.variant(expr.mutant(a), expr.position(a), expr.wild_type(a))
    return samples.unionByName(samples.withColumns({aac: back, target: F.lit(threshold) - F.col(target)}))


def fused(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Both sample sets, the right one's rows where both have a key."""
    return left.join(right.select(*key), key, "left_anti").unionByName(right, allowMissingColumns=True)


def two_sides(samples: DataFrame, target: str, threshold: float) -> DataFrame:
    """`below`, whether the target is under the threshold; NULL stays NULL."""
    return samples.withColumn("below", F.col(target) < threshold)


def upserted(samples: DataFrame, features: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Samples with the named feature columns filled from a feature table; a value that is there stays where the table has none."""
    new = features.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = samples.join(new, key, "left")
    filled = {c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in samples.columns else F.col(f"_new_{c}") for c in columns}
    return joined.withColumns(filled).drop(*[f"_new_{c}" for c in columns])
