"""Correlations, scores and group statistics over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlab.operators import stats
from variantlab.plans.common import query, table


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Columns rounded to six places, as engines differ in the last bits of a sum."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


_RANKS = """select l_suppkey, rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2.0 as a,
  rank() over (partition by l_suppkey order by l_extendedprice) + (count(*) over (partition by l_suppkey, l_extendedprice) - 1) / 2.0 as b from lineitem"""
_CORR = "case when isnan(corr(a, b)) then null else corr(a, b) end"


@query(f"select l_suppkey, count(*) as n, round({_CORR}, 6) as r from ({_RANKS}) group by l_suppkey")
def group_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.group_spearman(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"), "r")


@query(f"with g as (select l_suppkey, {_CORR} as r from ({_RANKS}) group by l_suppkey) select count(*) as n_groups, count(*) filter (r is null) as n_undefined, round(coalesce(avg(abs(r)), 0), 6) as mean_abs_r from g")
def mean_group_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = stats.group_spearman(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return r6(stats.mean_group_corr(groups), "mean_abs_r")


@query(f"with g as (select l_suppkey, {_CORR} as r from ({_RANKS}) group by l_suppkey) select round(1 - coalesce(avg(r), 0), 6) as objective from g")
def rank_objective(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = stats.group_spearman(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return r6(stats.rank_objective(groups), "objective")


@query("select l_suppkey, count(*) as n, round(case when isnan(corr(l_quantity, l_extendedprice)) then null else corr(l_quantity, l_extendedprice) end, 6) as r from lineitem group by l_suppkey")
def group_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.group_pearson(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice"), "r")


@query("""with x as (select rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as a,
  rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2.0 as b from orders) select count(*) as n, round(corr(a, b), 6) as r from x""")
def global_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.spearman(table(spark, sf_dir, "orders"), "o_totalprice", "o_custkey"), "r")


@query("""
select o_orderkey, rank() over (partition by o_orderstatus order by o_totalprice) + (count(*) over (partition by o_orderstatus, o_totalprice) - 1) / 2.0 as r from orders""")
def tie_averaged_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W01 in groups of which one may hold most rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return stats.ranked(orders, "o_totalprice", "r", ["o_orderstatus"]).select("o_orderkey", "r")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    means = orders.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("pred"))
    return orders.join(means, "o_custkey").withColumn("weight", F.lit(1.0) + F.pmod("o_orderkey", F.lit(3)))


_PRED = "select o_orderkey, o_orderstatus, o_totalprice as y, avg(o_totalprice) over (partition by o_custkey) as p, 1.0 + o_orderkey % 3 as w from orders"


@query(f"select o_orderstatus, count(*) as n, round(avg((y - p) ** 2), 2) as mse, round(1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)), 6) as r2, round(corr(y, p), 6) as pearson from ({_PRED}) group by o_orderstatus")
def regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.regression_scores(_predicted(spark, sf_dir), "o_totalprice", "pred", by=["o_orderstatus"])
    return r6(out, "r2", "pearson").withColumn("mse", F.round("mse", 2))


@query(f"select count(*) as n, round(sum(w * (y - p) ** 2) / sum(w), 2) as mse, round(1 - sum(w * (y - p) ** 2) / (sum(w * y * y) - sum(w * y) ** 2 / sum(w)), 6) as r2, round(corr(y, p), 6) as pearson from ({_PRED})")
def weighted_regression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.regression_scores(_predicted(spark, sf_dir), "o_totalprice", "pred", "weight")
    return r6(out, "r2", "pearson").withColumn("mse", F.round("mse", 2))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id")


@query("""with c as (select lang, count(*) filter (quality = 1 and n_chars >= 1000) as tp, count(*) filter (quality = 0 and n_chars >= 1000) as fp,
  count(*) filter (quality = 1 and n_chars < 1000) as fn, count(*) filter (quality = 0 and n_chars < 1000) as tn from documents join labels using (doc_id) group by lang)
  select lang, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn)::double, 6) as accuracy, round(tp / nullif(tp + fp, 0)::double, 6) as precision,
  round(tp / nullif(tp + fn, 0)::double, 6) as recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 6) as f1 from c""")
def classification_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("pred", (F.col("n_chars") >= 1000).cast("int"))
    return r6(stats.classification_scores(rows, "quality", "pred", ["lang"]), "accuracy", "precision", "recall", "f1")


@query("""with r as (select quality, rank() over (order by n_chars) + (count(*) over (partition by n_chars) - 1) / 2.0 as r from documents join labels using (doc_id)),
  c as (select count(*) filter (quality = 1) as n_pos, count(*) filter (quality = 0) as n_neg, sum(r) filter (quality = 1) as s from r)
  select n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 6) as auc from c""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.roc_auc(_labelled(spark, sf_dir), "quality", "n_chars"), "auc")


@query("""with r as (select lang, quality, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as r from documents join labels using (doc_id)),
  c as (select lang, count(*) filter (quality = 1) as n_pos, count(*) filter (quality = 0) as n_neg, sum(r) filter (quality = 1) as s from r group by lang)
  select lang, n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / nullif(n_pos * n_neg, 0), 6) as auc from c""")
def group_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.roc_auc(_labelled(spark, sf_dir), "quality", "n_chars", ["lang"]), "auc")


@query(f"""with x as ({_PRED}), m as (select median(y) as my, median(p) as mp from x),
  c as (select count(*) filter (y >= my and p >= mp)::double as tp, count(*) filter (y < my and p >= mp)::double as fp, count(*) filter (y >= my and p < mp)::double as fn, count(*) filter (y < my and p < mp)::double as tn from x, m)
  select round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc from c""")
def mcc_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.matthews(_predicted(spark, sf_dir), "o_totalprice", "pred"), "mcc")


def long_features(spark: SparkSession, sf_dir: str, count: int = 64) -> DataFrame:
    """vec_id, label, feature (f00, f01, ...), value."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, count)).alias("i", "value"))
    return rows.select("vec_id", "label", F.format_string("f%02d", "i").alias("feature"), F.col("value").cast("double").alias("value"))


LONG = "select vec_id, label, format('f{:02d}', i - 1) as feature, embedding[i]::double as value from (select *, unnest(generate_series(1, 64)) as i from embeddings)"


@query(f"select feature, round(min(value), 6) as low, round(max(value), 6) as high, round(avg(value), 6) as mean, round(median(value), 6) as median from ({LONG}) group by feature")
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.feature_stats(long_features(spark, sf_dir)), "low", "high", "mean", "median")


@query("""with t as (select sum(l_quantity) as q, count(*) as n from lineitem), x as (select l_discount * l_quantity * n / q as x from lineitem, t) select round(avg(x), 6) as mean, round(stddev_samp(x), 6) as sd from x""")
def weighted_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.weighted_moments(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity"), "mean", "sd")


@query("select p_brand, round(quantile_cont(p_retailprice, 0.25), 6) as q1, round(quantile_cont(p_retailprice, 0.5), 6) as q2, round(quantile_cont(p_retailprice, 0.75), 6) as q3 from part group by p_brand")
def quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats.quartiles(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice"), "q1", "q2", "q3")


@query(f"""with s as (select o_orderstatus, avg((y - p) ** 2) as mse, 1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)) as r2, corr(y, p) as pearson from ({_PRED}) group by o_orderstatus)
  select round(avg(mse), 2) as mse, round(avg(r2), 6) as r2, round(avg(pearson), 6) as pearson, round(stddev_samp(pearson), 6) as pearson_sd from s""")
def mean_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = stats.regression_scores(_predicted(spark, sf_dir), "o_totalprice", "pred", by=["o_orderstatus"])
    out = stats.mean_scores(scores, ["mse", "r2", "pearson"], "pearson")
    return r6(out, "r2", "pearson", "pearson_sd").withColumn("mse", F.round("mse", 2))


@query("""with m as (select feature, avg(value) as x from (%s) group by feature) select feature, row_number() over (order by x desc, feature) - 1 as place, rank() over (order by x desc) - 1 as low_rank,
  round(x, 6) as score, round((x - min(x) over ()) / (max(x) over () - min(x) over ()), 6) as scaled from m""" % LONG)
def rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W02 over features, of which there are as many as columns."""
    from variantlab.operators.select import rank_table as ranks

    means = long_features(spark, sf_dir).groupBy("feature").agg(F.avg("value").alias("score"))
    return r6(ranks(means, "feature", "score"), "score", "scaled")


@query(f"""with x as ({_PRED}), g as (select o_orderstatus, rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0 as ra, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as rb,
    rank() over (partition by o_orderstatus order by y) + (count(*) over (partition by o_orderstatus, y) - 1) / 2.0 as ga, rank() over (partition by o_orderstatus order by p) + (count(*) over (partition by o_orderstatus, p) - 1) / 2.0 as gb from x),
  m as (select median(y) as my, median(p) as mp from x), k as (select count(*) filter (y >= my and p >= mp)::double as tp, count(*) filter (y < my and p >= mp)::double as fp, count(*) filter (y >= my and p < mp)::double as fn, count(*) filter (y < my and p < mp)::double as tn from x, m),
  s as (select count(*) as n, avg((y - p) ** 2) as mse, 1 - sum((y - p) ** 2) / (sum(y * y) - sum(y) ** 2 / count(*)) as r2, corr(y, p) as pearson from x)
  select n, round(mse, 2) as mse, round(r2, 6) as r2, round(pearson, 6) as pearson, round((select corr(ra, rb) from g), 6) as spearman,
    round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) as mcc, round((select avg(abs(c)) from (select corr(ga, gb) as c from g group by o_orderstatus)), 6) as mean_spearman from s, k""")
def score_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A34."""
    out = stats.score_record(_predicted(spark, sf_dir), "o_totalprice", "pred", "o_orderstatus")
    return r6(out, "r2", "pearson", "spearman", "mcc", "mean_spearman").withColumn("mse", F.round("mse", 2))
