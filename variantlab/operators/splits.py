"""Hold-outs, folds, leakage checks, subsamples and sample weights.

Random orders are orders of a hash of the key and a seed (`md5`, which other engines share), so the
same rows are taken on any cluster and however the input is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from variantlab.operators import stats
from variantlab.operators.distances import mean_powers
from variantlab.operators.stats import by_group
from variantlab.tables import running


def shuffled(*key: str, seed: int = 0) -> Column:
    """A hexadecimal value by which rows are in random order."""
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def sample_rows(rows: DataFrame, key: list[str], k: int, seed: int = 0) -> DataFrame:
    """K rows without replacement; a top-k by hash, so no full sort."""
    return rows.orderBy(shuffled(*key, seed=seed), *key).limit(k)


def holdout(rows: DataFrame, key: list[str], rate: float = 0.2, seed: int = 0) -> DataFrame:
    """`rows` with `test`, true for about a share `rate` of rows, row by row by hash."""
    cut = F.lit(f"{min(int(rate * 16**8), 16**8 - 1):08x}")
    return rows.withColumn("test", F.substring(shuffled(*key, seed=seed), 1, 8) < cut)


def grouped_holdout(rows: DataFrame, group: str, rate: float = 0.2, seed: int = 0) -> DataFrame:
    """X01 by group: whole groups in random order are test until these hold test_size * (1 - rate) rows, where test_size is a share `rate` of all.

    What came before a group is a running total over slices of the order.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_h", shuffled(group, seed=seed))
    placed = running(sizes, ["_h", group], {"_to": F.col("_n")})
    aim = F.greatest(F.lit(1), F.floor(F.col("_total") * rate))
    total = sizes.agg(F.sum("_n").alias("_total"))
    chosen = placed.crossJoin(F.broadcast(total)).select(group, (F.col("_to") - F.col("_n") < aim - aim * rate).alias("test"))
    return rows.join(chosen, group)


def kfold(rows: DataFrame, key: list[str], k: int = 4, seed: int = 0) -> DataFrame:
    """X02 by row: `fold` 0..k-1 by hash."""
    return rows.withColumn("fold", F.pmod(F.conv(F.substring(shuffled(*key, seed=seed), 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int"))


def grouped_kfold(rows: DataFrame, group: str, k: int = 4) -> DataFrame:
    """X02 by group: `fold` of every row; groups are packed in order of their name, and what is left has the last fold.

    A fold closes before a group that would leave it further from its share of the rows.  Where it
    does follows from running totals over slices, so the driver gets one number for each fold.
    """
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n"))
    placed = running(sizes, [group], {"_to": F.col("_n")}).withColumn("_before", F.col("_to") - F.col("_n"))
    share, starts = (placed.agg(F.max("_to")).first()[0] or 0) / k, []
    for _ in range(k - 1):
        size = F.col("_before") - (starts[-1] if starts else 0)
        closes = (size > 0) & ((size >= share) | (F.abs(size + F.col("_n") - share) > F.abs(size - share)))
        start = placed.where(closes).agg(F.min("_before")).first()[0]
        if start is None:
            break
        starts.append(start)
    fold = sum((F.when(F.col("_before") >= s, 1).otherwise(0) for s in starts), F.lit(0))
    return rows.join(placed.select(group, fold.cast("int").alias("fold")), group)


def leave_one_out(rows: DataFrame, group: str) -> DataFrame:
    """The group is the fold."""
    return rows.withColumn("fold", F.col(group))


def given_folds(rows: DataFrame, table: DataFrame, key: list[str]) -> DataFrame:
    """`fold` from a table of key and bin; rows that it lacks are left out."""
    return rows.join(table.select(*key, F.col("bin").alias("fold")), key)


#: Most folds that are nested: the result has the rows once for each.
FOLDS = 1000


def nested_folds(rows: DataFrame, fold: str = "fold") -> DataFrame:
    """For each outer fold the training rows, with the inner fold that holds each one out."""
    folds = [r[0] for r in rows.select(fold).where(F.col(fold).isNotNull()).distinct().limit(FOLDS + 1).collect()]
    if len(folds) > FOLDS:
        raise ValueError(f"nested folds copy the rows for each of at most {FOLDS} folds")
    kind = rows.schema[fold].dataType
    every = F.array(*[F.lit(f).cast(kind) for f in sorted(folds)]) if folds else F.array().cast(ArrayType(kind))
    out = rows.withColumn("outer", F.explode(F.filter(every, lambda x: x != F.col(fold))))
    return out.withColumn("inner", F.col(fold)).drop(fold)


def circularity(train: DataFrame, test: DataFrame, key: list[str], group: str) -> DataFrame:
    """Number of training rows whose sample (type 1), or whose group (type 2), is in the test set."""
    one = train.join(test.select(*key).distinct(), key, "left_semi").agg(F.count("*").alias("type1"))
    two = train.join(test.select(group).distinct(), group, "left_semi").agg(F.count("*").alias("type2"))
    return one.crossJoin(two)


def without_leaks(train: DataFrame, test: DataFrame, by: list[str]) -> DataFrame:
    """training rows whose key isn't in the test set."""
    return train.join(test.select(*by).distinct(), by, "left_anti")


def balanced(rows: DataFrame, group: str, label: str, key: str, seed: int = 0, keep_singletons: bool = True) -> DataFrame:
    """Of each group as many rows of each label as of its rarest; pure groups go, but for single rows."""
    counts = rows.groupBy(group, label).agg(F.count("*").alias("_n"))
    per = counts.groupBy(group).agg(F.min("_n").alias("_least"), F.count("*").alias("_labels"), F.sum("_n").alias("_all"))
    use = per.where((F.col("_labels") > 1) | (F.lit(keep_singletons) & (F.col("_all") == 1)))
    own = rows.join(use, group).withColumn("_h", shuffled(key, seed=seed))
    return stats.numbered(own, [group, label], ["_h", key], "_place").where("_place <= _least").select(*rows.columns)


def levelled(rows: DataFrame, group: str, key: str, target: str, threshold: float) -> DataFrame:
    """Of each group a subsample whose mean is at the threshold: the smaller side of it, and as many rows of the larger.

    Rows of the larger side stand in the order of their distance from the threshold; of all stretches of
    the wanted number there, the one is taken whose distances sum up nearest to the smaller side's (the
    nearer one of equals).  Both sides are numbered and summed up by running totals over slices, and
    the sum of a stretch is the difference of two rows' totals, an equi-join by number: the same rule
    for a group of any size.  Groups on one side of the threshold go, as do rows without target.
    """
    t = F.col(target).cast("double")
    own = rows.where(t.isNotNull() & ~F.isnan(t)).select(group, key, target, F.abs(t - threshold).alias("_d"), (t >= threshold).cast("int").alias("_side"))
    placed = running(own, [group, "_side", "_d", key], {"_i": F.lit(1), "_c": F.col("_d")})
    first = placed.groupBy(group, "_side").agg(F.min("_i").alias("_i0"), F.min(F.col("_c") - F.col("_d")).alias("_c0"), F.count("*").alias("_n"), F.max("_c").alias("_c1"))
    pair = lambda k: (F.max(F.when(F.col("_side") == k, F.col("_n"))).alias(f"_n{k}"), F.max(F.when(F.col("_side") == k, F.col("_c1") - F.col("_c0"))).alias(f"_s{k}"))
    both = first.groupBy(group).agg(*pair(0), *pair(1)).where("_n0 > 0 and _n1 > 0")
    few = F.when(F.col("_n0") < F.col("_n1"), 0).otherwise(1)
    wanted = both.select(group, few.alias("_few"), F.least("_n0", "_n1").alias("_m"), F.when(few == 0, F.col("_s0")).otherwise(F.col("_s1")).alias("_sum"), F.when(few == 0, F.col("_s1")).otherwise(F.col("_s0")).alias("_all"))
    known = by_group(first.select(group, "_side", "_i0", "_c0"), wanted, [group], "inner")
    rows = by_group(placed, known, [group, "_side"], "inner").withColumns({"_at": F.col("_i") - F.col("_i0"), "_before": F.col("_c") - F.col("_d") - F.col("_c0")})
    many = rows.where("_side <> _few")
    after = many.select(group, (F.col("_at") - F.col("_m")).alias("_at"), F.col("_before").alias("_after")).where("_at >= 0")
    last = (F.col("_side") != F.col("_few")) & (F.col("_at") == F.col("_all_n") - F.col("_m"))
    sizes = both.select(group, F.greatest("_n0", "_n1").alias("_all_n"))
    starts = by_group(by_group(many, after, [group, "_at"]), sizes, [group], "inner").withColumn("_after", F.when(last, F.col("_all")).otherwise(F.col("_after"))).where("_after is not null")
    best = starts.groupBy(group).agg(F.min_by("_at", F.struct(F.round(F.abs(F.col("_after") - F.col("_before") - F.col("_sum")), 6), "_at")).alias("_from"))
    taken = by_group(rows, best, [group], "inner").where("_side = _few or (_at >= _from and _at < _from + _m)")
    return taken.select(group, key, F.col(target).cast("double").alias(target))


def inverse_frequency(rows: DataFrame, group: str, role: str) -> DataFrame:
    """`weight` of each row: rows of its role by rows of its group in both roles."""
    roles = rows.groupBy(role).agg(F.count("*").alias("_role"))
    groups = rows.groupBy(group).agg(F.count("*").alias("_group"))
    return rows.join(F.broadcast(roles), role).join(groups, group).withColumn("weight", F.col("_role") / F.col("_group")).drop("_role", "_group")


def _mean_distance(values: DataFrame, others: DataFrame, target: str, power: float) -> DataFrame:
    """Distinct `values` with `weight`, the mean of |difference|^power over `others`.

    For power 2 that is (t - mean)^2 + variance; for power 1 it follows from running totals of rows
    and of their sum.  Other powers are summed up by expansions.
    """
    if power == 2:
        m = others.agg(F.avg(target).alias("_m"), F.var_pop(target).alias("_v"))
        return values.crossJoin(F.broadcast(m)).select(target, (F.pow(F.col(target) - F.col("_m"), F.lit(2.0)) + F.col("_v")).alias("weight"))
    counts = others.groupBy(target).agg(F.count("*").alias("_n"))
    if power == 1:
        t = F.col(target).cast("double")
        both = values.select(target, F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asked")).unionByName(counts.withColumn("_asked", F.lit(False)))
        both = both.groupBy(target).agg(F.sum("_n").alias("_n"), F.max("_asked").alias("_asked"))
        placed = running(both, [target], {"_to": F.col("_n"), "_sum": F.col("_n") * t}).where("_asked")
        all_ = counts.agg(F.sum("_n").alias("_rows"), F.sum(F.col("_n") * t).alias("_total"))
        apart = t * (2 * F.col("_to") - F.col("_rows")) - 2 * F.col("_sum") + F.col("_total")
        return placed.crossJoin(F.broadcast(all_)).select(target, (apart / F.col("_rows")).alias("weight"))
    return mean_powers(values, counts, target, power)


def distance_weights(rows: DataFrame, target: str, power: float = 2.0) -> DataFrame:
    """Distinct targets with the mean of |difference|^power over all rows."""
    given = rows.where(F.col(target).isNotNull()).select(target)
    return _mean_distance(given.distinct(), given, target, power)


def group_means(train: DataFrame, rows: DataFrame, by: list[str], target: str, name: str, default: float = 0.5) -> DataFrame:
    """The mean training target of each row's group, or a default where training has none."""
    means = train.groupBy(*by).agg(F.avg(target).alias("_mean"))
    return rows.join(means, by, "left").withColumn(name, F.coalesce("_mean", F.lit(default))).drop("_mean")


def sampled_distance_weights(rows: DataFrame, key: list[str], target: str, power: float = 2.0, seed: int = 0) -> DataFrame:
    """Mean |difference|^power of each distinct target to a sample of min(n, max(100, round(n / 200))) rows."""
    given = rows.where(F.col(target).isNotNull())
    n = given.count()
    some = sample_rows(given, key, min(n, max(100, round(0.005 * n))), seed)
    return _mean_distance(given.select(target).distinct(), some.select(target), target, power)


def without_groups(rows: DataFrame, group: str, *excluded: DataFrame) -> DataFrame:
    """Rows whose group is in none of the excluded sets."""
    gone = excluded[0].select(group)
    for more in excluded[1:]:
        gone = gone.union(more.select(group))
    return rows.join(gone.distinct(), group, "left_anti")


def common_groups(a: DataFrame, b: DataFrame, group: str) -> DataFrame:
    """Distinct groups of both."""
    return a.select(group).intersect(b.select(group))


def full_slice(rows: DataFrame) -> DataFrame:
    """All rows train."""
    return rows.withColumn("fold", F.lit(-1))
