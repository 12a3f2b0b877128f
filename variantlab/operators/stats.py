"""Ranks, correlations and scores, over all rows or by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantlab.tables import running, written


def avg_rank(value: str, *by: str) -> Column:
    """Tie-averaged rank in the group. Groups must fit a task; see `ranked` for those that may not."""
    group = Window.partitionBy(*by)
    return F.rank().over(group.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def _counted(df: DataFrame, value: str, by: list[str], rows: str | None = None) -> DataFrame:
    """Distinct values of each group with `_n`, their rows, and `_to`, the rows up to them in the order of group and value.

    rows: a column that says for how many rows one of `df` stands.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.sum(rows) if rows else F.count("*")).alias("_n"))
    return running(counts, [*by, value], {"_to": F.col("_n")})


def by_group(df: DataFrame, groups: DataFrame, by: list[str], how: str = "left") -> DataFrame:
    """`df` with the other columns of `groups`, of its group by `by`; NULL is a group like others."""
    named = groups.withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    return df.join(named, same, how).drop(*[f"_by_{c}" for c in by]) if by else df.crossJoin(F.broadcast(groups))


def _placed(counts: DataFrame, by: list[str]) -> DataFrame:
    """`_counted` rows with `_to` counted from the start of their group, and `_all`, the group's rows."""
    groups = counts.groupBy(*by).agg(F.min(F.col("_to") - F.col("_n")).alias("_base"), F.sum("_n").alias("_all"))
    return by_group(counts, groups, by, "inner").withColumn("_to", F.col("_to") - F.col("_base")).drop("_base")


def ranked(df: DataFrame, value: str, name: str, by: list[str] | None = None) -> DataFrame:
    """Tie-averaged rank of `value` as column `name`, over all rows or in each group, with no task for a whole group.

    Distinct values with their numbers of rows get running totals over slices.  NULL values get no rank.
    """
    by = by or []
    ranks = _placed(_counted(df, value, by), by).select(*by, value, (F.col("_to") - (F.col("_n") - 1) / 2).alias(name))
    return by_group(df, ranks, [*by, value]).select(*df.columns, name)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """`df` with each row's number in its group, from 1, in an order without ties, by running totals over slices."""
    every = running(df, [*by, *order], {name: F.lit(1)})
    first = every.groupBy(*by).agg(F.min(name).alias("_first"))
    return by_group(every, first, by, "inner").withColumn(name, F.col(name) - F.col("_first") + 1).select(*df.columns, name)


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles by name, each between its two neighbours; groups without a value are left out.

    No task has a group's values: they are counted, and running totals tell which rows are asked for.
    """
    return _quantiles(_placed(_counted(df, value, by), by), by, value, shares)


def _quantiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """`quantiles` of `_placed` values."""
    at = {name: (F.col("_all") - 1) * F.lit(float(q)) for name, q in shares.items()}
    here = lambda i: F.max(F.when((F.col("_to") - F.col("_n") <= i) & (i < F.col("_to")), F.col(value).cast("double")))
    ends = [c for name, x in at.items() for c in (here(F.floor(x)).alias(f"_a_{name}"), here(F.ceil(x)).alias(f"_b_{name}"), F.max(x - F.floor(x)).alias(f"_p_{name}"))]
    found = rows.groupBy(*by).agg(*ends)
    return found.select(*by, *[(F.col(f"_a_{n}") + (F.col(f"_b_{n}") - F.col(f"_a_{n}")) * F.col(f"_p_{n}")).alias(n) for n in shares])


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pearson's correlation, NULL where one side is constant or there are fewer than two rows."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def group_pearson(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """A03 by group: n and r."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), safe_corr(a, b).alias("r"))


#: Rows of a group up to which its ranks are a window of one task, which gets about as many rows of smaller groups.
GROUP = 1_000_000


def _pairs(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Distinct pairs of given values in each group with `_rows`, their rows, as a stored table."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return written(both.groupBy(*by, a, b).agg(F.count("*").alias("_rows")), "pairs")


def _correlated(pairs: DataFrame, by: list[str], a: str, b: str, placed: dict[str, DataFrame] | None = None) -> DataFrame:
    """Spearman by group of `_pairs` rows, by the ranks of their counted values: no task has a whole group.

    Ranks are taken from their mean, (n + 1) / 2, so large groups lose no digits.  placed: `_placed` values, if known.
    """
    ranks = pairs
    for value, name in ((a, "_a"), (b, "_b")):
        own = placed[value] if placed else _placed(_counted(pairs, value, by, "_rows"), by)
        own = own.select(*by, value, (F.col("_to") - (F.col("_n") - 1) / 2 - (F.col("_all") + 1) / 2).alias(name))
        ranks = by_group(ranks, own, [*by, value], "inner")
    n, x, y = F.col("_rows"), F.col("_a"), F.col("_b")
    r = F.try_divide(F.sum(n * x * y), F.sqrt(F.sum(n * x * x)) * F.sqrt(F.sum(n * y * y)))
    return ranks.groupBy(*by).agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), r.alias("r"))


def group_spearman(df: DataFrame, by: list[str], a: str, b: str, sliced: bool | None = None) -> DataFrame:
    """A02 by group, on rows where both are given: n and r.

    Ranks are windows over groups, dealt to as many tasks as rows ask for, or where the largest group has over
    GROUP rows running totals over slices; sliced says which.  Both ways give the same ranks.
    """
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*by, a, b)
    if sliced:
        return _correlated(_pairs(both, by, a, b), by, a, b)
    most, n = both.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    if sliced is None and (most or 0) > GROUP:
        return _correlated(_pairs(both, by, a, b), by, a, b)
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(n or 0) // GROUP))
    dealt = both.repartition(tasks, *by)  # else small groups would fill as few tasks as the session has partitions
    ranks = dealt.select(*by, avg_rank(a, *by).alias("_a"), avg_rank(b, *by).alias("_b"))
    return ranks.groupBy(*by).agg(F.count("*").alias("n"), safe_corr("_a", "_b").alias("r"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """A02 over all rows, in slices: n and r."""
    return _correlated(_pairs(df, [], a, b), [], a, b)


def mean_group_corr(groups: DataFrame) -> DataFrame:
    """Unweighted mean of |r| over the groups where it is defined, 0 if none is; n_groups and n_undefined."""
    return groups.agg(
        F.count("*").alias("n_groups"),
        F.count_if(F.col("r").isNull()).alias("n_undefined"),
        F.coalesce(F.avg(F.abs("r")), F.lit(0.0)).alias("mean_abs_r"),
    )


def rank_objective(groups: DataFrame) -> DataFrame:
    """1 minus the mean of the signed correlation over groups."""
    return groups.agg((1 - F.coalesce(F.avg("r"), F.lit(0.0))).alias("objective"))


def regression_scores(df: DataFrame, true: str, pred: str, weight: str | None = None, by: list[str] | None = None) -> DataFrame:
    """N, mse, r2 and pearson, with weights if given.

    Targets are spread around their mean, not around 0, so large ones lose no digits.
    """
    by = by or []
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, p = F.col(true).cast("double"), F.col(pred).cast("double")
    rows = df.where(y.isNotNull() & p.isNotNull())
    sw = F.sum(w)
    error = F.sum(w * (y - p) * (y - p))
    if weight:
        rows = by_group(rows, rows.groupBy(*by).agg(F.try_divide(F.sum(w * y), sw).alias("_mean")), by)
        spread = F.sum(w * (y - F.col("_mean")) * (y - F.col("_mean")))
    else:
        spread = F.var_pop(y) * F.count("*")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(error, sw).alias("mse"), (1 - F.try_divide(error, spread)).alias("r2"), safe_corr(y, p).alias("pearson"))


def confusion_counts(label: Column, predicted: Column) -> dict[str, Column]:
    return {f"{name}": F.count_if((label == a) & (predicted == b)) for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))}


def classification_scores(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 of 0/1 labels, with the counts."""
    counts = df.groupBy(*(by or [])).agg(*[c.alias(k) for k, c in confusion_counts(F.col(label), F.col(predicted)).items()])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.select("*", F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def matthews(df: DataFrame, a: str, b: str) -> DataFrame:
    """Matthews' correlation of two numbers, each cut at its median."""
    pairs = _pairs(df, [], a, b)
    return _matthews(pairs, a, b, {x: _placed(_counted(pairs, x, [], "_rows"), []) for x in (a, b)})


def _matthews(pairs: DataFrame, a: str, b: str, placed: dict[str, DataFrame]) -> DataFrame:
    """`matthews` of `_pairs` rows, with their `_placed` values."""
    cut = _quantiles(placed[a], [], a, {"_ma": 0.5}).crossJoin(_quantiles(placed[b], [], b, {"_mb": 0.5}))
    both = pairs.crossJoin(F.broadcast(cut)).select("_rows", (F.col(a) >= F.col("_ma")).alias("y"), (F.col(b) >= F.col("_mb")).alias("p"))
    count = lambda y, p: F.coalesce(F.sum(F.when((F.col("y") == y) & (F.col("p") == p), F.col("_rows"))), F.lit(0)).cast("double")
    counts = both.agg(*[count(y, p).alias(k) for k, y, p in (("tp", True, True), ("fp", False, True), ("fn", True, False), ("tn", False, False))])
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return counts.select(F.coalesce(F.try_divide(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))), F.lit(0.0)).alias("mcc"))


def roc_auc(df: DataFrame, label: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by the rank sum; NULL with one class only."""
    by = by or []
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    ranks = ranked(rows.select(*by, F.col(label).alias("_y"), F.col(score).alias("_s")), "_s", "_r", by)
    out = ranks.groupBy(*by).agg(F.count_if(F.col("_y") == 1).alias("n_pos"), F.count_if(F.col("_y") == 0).alias("n_neg"), F.sum(F.when(F.col("_y") == 1, F.col("_r"))).alias("_sum"))
    area = F.try_divide(F.col("_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2, (F.col("n_pos") * F.col("n_neg")).cast("double"))
    return out.select(*by, "n_pos", "n_neg", area.alias("auc"))


def feature_stats(long: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Minimum, maximum, mean and median of each feature, NULLs left out."""
    rows = long.groupBy(feature).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))
    return by_group(rows, quantiles(long, [feature], value, {"median": 0.5}), [feature])


def weighted_moments(df: DataFrame, value: str, quantity: str) -> DataFrame:
    """Mean and standard deviation of values scaled by their share of the quantity."""
    total = df.agg(F.sum(quantity).alias("_q"), F.count("*").alias("_n"))
    scaled = df.crossJoin(F.broadcast(total)).select((F.col(value) * F.col(quantity) * F.col("_n") / F.col("_q")).alias("x"))
    return scaled.agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A10: quartiles, each the value at a quarter of the rows or the middle of its two neighbours."""
    return quantiles(df, by, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def mean_scores(scores: DataFrame, columns: list[str], spread: str) -> DataFrame:
    """The mean of each score over records, NULLs left out, and the deviation of one of them (NULL for one record)."""
    return scores.agg(*[F.avg(c).alias(c) for c in columns], F.stddev_samp(spread).alias(f"{spread}_sd"))


def score_record(df: DataFrame, true: str, pred: str, group: str) -> DataFrame:
    """One row with every regression score: n, mse, r2, pearson, spearman, mcc and the mean over groups of |Spearman|.

    Ranks and medians come from one stored table of pairs, and values are placed once for both.
    """
    scores = regression_scores(df, true, pred)
    pairs = _pairs(df, [group], true, pred)
    placed = {x: _placed(_counted(pairs, x, [], "_rows"), []) for x in (true, pred)}
    rank = _correlated(pairs, [], true, pred, placed).select(F.col("r").alias("spearman"))
    groups = mean_group_corr(_correlated(pairs, [group], true, pred)).select(F.col("mean_abs_r").alias("mean_spearman"))
    return scores.crossJoin(rank).crossJoin(_matthews(pairs, true, pred, placed)).crossJoin(groups)
