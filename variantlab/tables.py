"""Tables between stages, running totals, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: spark.checkpoint.dir, or where that is unset, on one machine only, one in the warehouse."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.startswith("local["):
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/_shared"
    if not shared:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and a lost executor costs nothing before it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes the table of a `written` result that nothing needs any more."""
    path = getattr(df, "_written", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """`rows` with totals of columns over all rows up to each one, in an order without ties, by name.

    Ranges of the order are slices, as many as shuffle partitions; totals are taken in each slice and
    shifted by those of the slices before it, so no task has all rows.  The slices are a written
    table: how rows were dealt can't change when an executor is lost.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = rows.select("*", *[c.alias(f"_own_{name}") for name, c in sums.items()])
    dealt = written(given.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    every = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_slice").agg(*[F.sum(f"_own_{name}").alias(f"_all_{name}") for name in sums])
    starts = starts.select("_slice", *[F.coalesce(F.sum(f"_all_{name}").over(every), F.lit(0)).alias(f"_start_{name}") for name in sums])
    up_to = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select("*", *[F.sum(f"_own_{name}").over(up_to).alias(f"_up_{name}") for name in sums])
    return inside.join(F.broadcast(starts), "_slice").select(*rows.columns, *[(F.col(f"_start_{name}") + F.col(f"_up_{name}")).alias(name) for name in sums])


def leading(rows: DataFrame, order: list[str], name: str, value: Column) -> DataFrame:
    """`rows` with the greatest `value` of all rows before each one, in an order without ties; NULL for the first.

    Slices are as in `running`.  Where `value` is a struct whose first field is a group and the order starts
    with it, only rows of the same group, if any, give what leads.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = rows.select("*", value.alias("_own"))
    dealt = written(given.repartitionByRange(slices, *order).withColumn("_slice", F.spark_partition_id()), "slices")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_slice").agg(F.max("_own").alias("_all")).select("_slice", F.max("_all").over(before).alias("_start"))
    above = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.select("*", F.max("_own").over(above).alias("_up"))
    return inside.join(F.broadcast(starts), "_slice").select(*rows.columns, F.greatest("_start", "_up").alias(name))


#: A vertex with more than a share of 1 / HOT of all edge ends has its minimum broadcast: there are fewer than HOT of them.
HOT = 1000


def _with_low(rows: DataFrame, low: DataFrame, most: int) -> DataFrame:
    """`rows` with `m` of their `u` from `low` (u, m, n), where fewer than `HOT` vertices have n > most.

    Those get it by a broadcast; in the join of the others their rows are dealt by `v` and match nothing.
    """
    hot = F.broadcast(low.where(F.col("n") > most).select("u", F.col("m").alias("_hot")))
    known = rows.join(hot, "u", "left").withColumn("_side", F.col("_hot").isNotNull()).withColumn("_k", F.when(F.col("_side"), F.col("v")).otherwise(F.col("u")))
    rest = low.where(F.col("n") <= most).select(F.col("u").alias("_k"), F.lit(False).alias("_side"), F.col("m").alias("_low"))
    return known.join(rest, ["_k", "_side"], "left").select("u", "v", F.coalesce("_hot", "_low").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: rows (id, component) of every id in `edges` (u, v: of one type that has an order), component its smallest id.

    Alternates the large-star and the small-star step (Kiveris et al. 2014) on tables in the shared
    folder.  Rows never outgrow the edges; minima are summed up before rows are shuffled, and the few
    vertices with very many neighbours get theirs by a broadcast of fewer than HOT rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = written(edges, "edges"), None
    count = edges.count()
    for _ in range(rounds):
        most = 2 * count // HOT
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _with_low(both.where("v > u"), low, most).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_low(large, least, most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        removed(edges)
        edges = after
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before, count = now, now[0]
    else:
        raise RuntimeError("components did not settle")
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
