"""Reports, searches and a stream over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlab.operators import report, search, stats
from variantlab.plans.common import query, table
from variantlab.plans.features import _ALIGNED, aligned
from variantlab.plans.statistics import _CORR, _RANKS, r6
from variantlab.streaming import incremental
from variantlab.tables import scratch


@query(f"with g as (select l_suppkey, count(*) as n, {_CORR} as r from ({_RANKS}) group by l_suppkey) select l_suppkey, n, round(r, 6) as r from g where abs(r) < 0.95")
def weak_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = stats.group_spearman(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return r6(report.weak_groups(groups, 0.95), "r")


@query("with m as (select o_custkey, avg(o_totalprice) as m from orders group by 1) select o_orderkey, round(abs(o_totalprice - m), 7) as error from orders join m using (o_custkey)")
def prediction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    means = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m"))
    return report.with_error(orders.join(means, "o_custkey"), "o_totalprice", "m").select("o_orderkey", F.round("error", 7).alias("error"))


@query("select user_id, round(arg_min(value, event_id), 6) as first_score, round(avg(value), 6) as mean_score, round(min(value), 6) as worst_score from events group by user_id")
def reduced_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(report.reduced(table(spark, sf_dir, "events"), ["user_id"], "value", "event_id"), "first_score", "mean_score", "worst_score")


@query("""with w as (select l_returnflag as d, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 as a, rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0 as b from lineitem),
  g as (select l_returnflag as d, l_suppkey as g, rank() over (partition by l_returnflag, l_suppkey order by l_quantity) + (count(*) over (partition by l_returnflag, l_suppkey, l_quantity) - 1) / 2.0 as a, rank() over (partition by l_returnflag, l_suppkey order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_suppkey, l_extendedprice) - 1) / 2.0 as b from lineitem),
  c as (select d, g, case when isnan(corr(a, b)) then null else corr(a, b) end as r from g group by d, g), m as (select d, avg(abs(r)) as m from c group by d)
  select w.d as l_returnflag, round(corr(w.a, w.b), 6) as spearman, round(any_value(m.m), 6) as mean_spearman from w join m using (d) group by w.d""")
def dataset_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.cumulative_spearman(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_suppkey", "l_quantity", "l_extendedprice")
    return r6(out, "spearman", "mean_spearman")


@query("""with r as (select l_suppkey, l_orderkey, arg_min(l_quantity, (l_linenumber, l_quantity))::double as f, avg(l_quantity)::double as a from lineitem group by 1, 2),
  b as (select *, max({'a': -a, 'f': -f}) over (partition by l_suppkey order by l_orderkey rows between unbounded preceding and 1 preceding) as m from r)
  select l_suppkey, l_orderkey, f as first_score, round(a, 6) as full_score, -m.f as best_first, round(-m.a, 6) as best_full, coalesce(a < -m.a, true) as improved, round(-m.a - a, 6) as gain,
  round(f - m.a + m.f, 6) as estimated, coalesce(0.95 * f > -m.f, false) as interrupted from b""")
def trial_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of their suppliers' studies, lines as folds, small quantities best."""
    runs = report.trials(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", report.OBJECTIVES["mse"])
    return r6(runs, "full_score", "best_full", "gain", "estimated")


@query("select p_partkey, row_number() over (partition by p_brand order by p_size, p_partkey) as ordinal, rank() over (partition by p_brand order by p_size) as competition from part")
def ordinal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ordinal_ranks(table(spark, sf_dir, "part"), "p_size", ["p_brand"], "p_partkey").select("p_partkey", "ordinal", "competition")


@query("select source, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents join labels using (doc_id) group by source")
def group_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    lists = report.group_lists(rows, "source", "doc_id", ["toxic"])
    ends = (F.sum(F.size("rows")).alias("n"), F.min(F.get("rows", F.lit(0))["doc_id"]).alias("first_id"), F.max(F.element_at("rows", -1)["doc_id"]).alias("last_id"))
    return lists.groupBy("source").agg(*ends)


@query(f"""with s as (select prot_id * 1000 + row_nr as id, replace(aligned, '-', '') as s from ({_ALIGNED})), k as (select distinct id, substr(s, i, 5) as w from (select *, unnest(generate_series(1, length(s) - 4)) as i from s)),
  c as (select a.id as query, b.id as target, count(*) as n_shared from k a join k b on a.w = b.w and a.id <> b.id group by 1, 2 having count(*) >= 2)
  select query, target, n_shared, row_number() over (partition by query order by n_shared desc, target) as rank from c qualify row_number() over (partition by query order by n_shared desc, target) <= 20""")
def sequence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J15 and T07, whose feature is the number of hits."""
    rows = aligned(spark, sf_dir).select((F.col("prot_id") * 1000 + F.col("row_nr")).alias("id"), F.replace("aligned", F.lit("-"), F.lit("")).alias("s"))
    return search.shared_words(rows, rows, "id", "s", 5, 2, 20)


@query()
def scored_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits by similar words, extended and aligned within a band; the best 20 of each query are its feature."""
    rows = aligned(spark, sf_dir).select((F.col("prot_id") * 1000 + F.col("row_nr")).alias("id"), F.replace("aligned", F.lit("-"), F.lit("")).alias("s"))
    return search.scored_hits(rows, rows, "id", "s", most=20).select("query", "target", "score", "rank")


@query("select event_type, count(value) as n, round(avg(value), 6) as mean from events group by event_type")
def stream_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of files, up to what is there now."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema.simpleString()[7:-1].replace(":", " ")
    rows = incremental.samples(spark, f"{sf_dir}/events.parquet*", schema)
    out = scratch(spark, "stream")
    run = incremental.upsert(incremental.running_means(rows, ["event_type"], "value"), f"{out}/table", f"{out}/checkpoint")
    run.awaitTermination()
    versions = spark.read.parquet(f"{out}/table")
    last = versions.agg(F.max("version").alias("version"))
    return r6(versions.join(F.broadcast(last), "version").select("event_type", "n", "mean"), "mean")
