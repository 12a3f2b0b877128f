"""Categories as numbers or columns, and samples as matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variantlab.tables import running


def dictionary(rows: DataFrame, column: str, order: str) -> DataFrame:
    """Value and code of each category, 0.. in the order in which they first appear; NULL is a category.

    Categories are numbered by running totals over slices, so there may be any number of them.
    """
    first = rows.groupBy(column).agg(F.min(order).alias("_first"))
    return running(first, ["_first", column], {"_n": F.lit(1)}).select(F.col(column).alias("value"), (F.col("_n") - 1).cast("long").alias("code"))


def extended(known: DataFrame, rows: DataFrame, column: str, order: str) -> DataFrame:
    """A dictionary with codes after the largest for values that it lacks."""
    new = rows.join(known, rows[column].eqNullSafe(known["value"]), "left_anti")
    most = known.agg((F.coalesce(F.max("code"), F.lit(-1)) + 1).alias("_next"))
    more = dictionary(new, column, order).crossJoin(F.broadcast(most)).select("value", (F.col("code") + F.col("_next")).alias("code"))
    return known.select("value", "code").union(more)


def encoded(rows: DataFrame, column: str, known: DataFrame, name: str) -> DataFrame:
    """`rows` with the code of a column."""
    d = known.select(F.col("value").alias("_value"), F.col("code").alias(name))
    return rows.join(d, rows[column].eqNullSafe(d["_value"]), "left").drop("_value")


def one_hot(rows: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """P10: a 0/1 column `oh_<column>_<category>` for each category instead of the column; NULL is 0 in all."""
    flags = {f"oh_{column}_{c}": F.coalesce((F.col(column) == c).cast("int"), F.lit(0)) for c in categories}
    return rows.withColumns(flags).drop(column)


def by_frequency(rows: DataFrame, column: str) -> DataFrame:
    """Value and code, the rarest category 1 and so on, the most frequent 0 of two."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    placed = running(counts.withColumn("_few", -F.col("n")), ["_few", column], {"_n": F.lit(1)})
    return placed.select(F.col(column).alias("value"), "n", (F.col("_n") - 1).cast("long").alias("code"))


def wide(long: DataFrame, key: list[str], features: list[str], feature: str = "feature", value: str = "value", default: float | None = 0.0) -> DataFrame:
    """One row per sample with a column per named feature, `default` where it is missing."""
    out = long.groupBy(*key).pivot(feature, features).agg(F.first(value, ignorenulls=True))
    return out.fillna(default, features) if default is not None else out


def matrix(samples: DataFrame, key: list[str], features: list[str]) -> DataFrame:
    """The named columns in that order as `features`, an array of doubles; an unknown `oh_` column is 0, another NULL."""
    cells = [F.col(f).cast("double") if f in samples.columns else F.lit(0.0 if f.startswith("oh_") else None).cast("double") for f in features]
    return samples.select(*key, F.array(*cells).alias("features"))
