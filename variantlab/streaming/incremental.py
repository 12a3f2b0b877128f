"""Coverage, class counts and group means over samples as they arrive: the batch operators' aggregates on a stream.

State is one row per group (and feature), never per sample. With a watermark late rows are dropped
and windows close; without one the running tables are updated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def samples(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """New files of a folder as they come, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def running_coverage(long: DataFrame, group: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """A15 so far."""
    x = F.col(value)
    return long.groupBy(group, feature).agg(F.avg(x.isNotNull().cast("int")).alias("cov"), F.avg(F.coalesce((x == 0).cast("int"), F.lit(0))).alias("zeros"), F.count(F.lit(1)).alias("total"))


def running_means(rows: DataFrame, by: list[str], target: str) -> DataFrame:
    """A17, A18 so far."""
    return rows.groupBy(*by).agg(F.count(target).alias("n"), F.avg(target).alias("mean"))


def windowed_means(rows: DataFrame, time: str, by: list[str], target: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Group means by tumbling window, closed once no row can be more than `late` behind."""
    out = rows.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(target).alias("n"), F.avg(target).alias("mean"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "mean")


def upsert(stream: DataFrame, path: str, checkpoint: str):
    """Writes each version of a running table as a whole, until what is there now is read; the last version is what counts."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/version={number}")

    return stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
