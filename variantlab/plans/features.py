"""Alignments, windows, profiles, joins of predictions, and feature selection over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variantlab.functions import expr
from variantlab.operators import alignment, explain, select
from variantlab.plans.common import query, table
from variantlab.plans.statistics import LONG, long_features, r6


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts as alignments of five proteins: letters that are residues stay, the rest are gaps, short rows are filled up."""
    upper = F.translate(F.coalesce("text", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("prot_id"), "item_id", F.regexp_replace(upper, f"[^{expr.RESIDUES}]", "-").alias("t"))
    b = b.withColumn("row_nr", (F.row_number().over(Window.partitionBy("prot_id").orderBy("item_id")) - 1).cast("int"))
    return b.select("prot_id", "row_nr", F.rpad("t", F.max(F.length("t")).over(Window.partitionBy("prot_id")).cast("int"), "-").alias("aligned"))


_ALIGNED = f"""select item_id % 5 as prot_id, row_number() over (partition by item_id % 5 order by item_id) - 1 as row_nr,
  rpad(regexp_replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^{expr.RESIDUES}]', '-', 'g'), max(length(text)) over (partition by item_id % 5)::int, '-') as aligned from benchmark"""
_CELLS = f"select prot_id, row_nr, i - 1 as pos, aligned[i] as residue from (select *, unnest(generate_series(1, length(aligned))) as i from ({_ALIGNED}))"


@query(f"""with c as ({_CELLS}), s as (select prot_id, pos from c where row_nr = 0 and residue <> '-'), k as (select c.* from c join s using (prot_id, pos))
  select prot_id, row_nr::int as row_nr, string_agg(residue, '' order by pos) as aligned from k group by prot_id, row_nr having count(*) filter (residue <> '-') > 0""")
def seed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.ungapped(aligned(spark, sf_dir)).select("prot_id", "row_nr", "aligned")


@query(f"""with c as ({_CELLS}), n as (select prot_id, pos, count(*) as n, count(*) filter (residue <> '-') as f, count(*) filter (residue = '-') as g from c group by prot_id, pos),
  v as (select prot_id, pos, residue as wt, 'S' as mut from c where row_nr = 0 and residue <> '-' and residue <> 'S')
  select v.prot_id, v.pos::int as pos, v.wt, v.mut, round((select count(*) from c where c.prot_id = v.prot_id and c.pos = v.pos and residue = v.wt) / n::double, 6) as wt_share,
  round((select count(*) from c where c.prot_id = v.prot_id and c.pos = v.pos and residue = 'S') / n::double, 6) as mut_share, round(g / n::double, 6) as gap_share, round(f / n::double, 6) as column_cover
  from v join n using (prot_id, pos)""")
def column_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(spark, sf_dir)
    cells = alignment.column_cells(rows)
    wanted = cells.where("row_nr = 0 and residue <> '-' and residue <> 'S'").select("prot_id", "pos", F.col("residue").alias("wt"), F.lit("S").alias("mut"))
    out = alignment.composition(wanted, cells)
    return r6(out.select("prot_id", "pos", "wt", "mut", "wt_share", "mut_share", "gap_share", "column_cover"), "wt_share", "mut_share", "gap_share", "column_cover")


def _pairs_sql(values: list[tuple]) -> str:
    return ", ".join(str(v) for v in values)


_SHARES = _pairs_sql(list(zip(expr.RESIDUES, alignment.BACKGROUND)))
_BLOSUM = _pairs_sql([(a, b, v) for a, row in zip(expr.RESIDUES, expr.blosum()) for b, v in zip(expr.RESIDUES, row)])
_PROFILE = f"""c as ({_CELLS}), a as (select aa, bg from (values {_SHARES}) v(aa, bg)), b as (select x, y, m from (values {_BLOSUM}) v(x, y, m)),
  p as (select distinct prot_id, pos from c), k as (select prot_id, pos, residue, count(*) as n from c where residue <> '-' group by 1, 2, 3),
  d as (select u.prot_id, u.pos, u.residue, w.pos as other, count(distinct w.residue) as n from c u join c w using (prot_id, row_nr) where u.residue <> '-' and w.residue <> '-' group by 1, 2, 3, 4),
  s as (select prot_id, pos, residue, case when any_value(k.n) = 1 then 1 else sum(d.n) / count(*)::double end as sim from d join k using (prot_id, pos, residue) group by 1, 2, 3),
  h as (select *, greatest(sim / 0.5 - 2, 0) as z from s),
  e as (select prot_id, pos, residue, case when sim < 1 then 1.0 when sim < {alignment.MOST_SIMILAR} then {list(alignment.EFFECTIVE)}[least((floor(2 * (z - floor(z))) + floor(z))::int, {len(alignment.EFFECTIVE) - 1}) + 1] else {alignment.MOST_EFFECTIVE} end::double as eff from h),
  t as (select prot_id, pos, sum(eff) as total from e group by 1, 2), g as (select prot_id, pos, aa, bg, coalesce(eff, 0)::double as eff, coalesce(total, 0)::double as total from p cross join a left join t using (prot_id, pos) left join e on e.prot_id = p.prot_id and e.pos = p.pos and e.residue = aa),
  q as (select g.prot_id, g.pos, b.x as aa, sum(g.eff / g.total * exp({alignment.SCALE} * b.m)) as mix from g join b on b.y = g.aa where g.total > 0 group by 1, 2, 3),
  f as (select g.prot_id, g.pos::int as pos, g.aa, case when total > 0 then round(ln(greatest(((total - 1) * eff / total + {alignment.PSEUDO} * sqrt(total) * bg * mix) / case when total - 1 + {alignment.PSEUDO} * sqrt(total) = 0 then 1 else total - 1 + {alignment.PSEUDO} * sqrt(total) end / bg, 1e-300)), 3) + 0.0 else 0.0 end as score,
    (select coalesce(sum(n), 0) from k where k.prot_id = g.prot_id and k.pos = g.pos)::bigint as n_rows from g left join q using (prot_id, pos, aa))"""


@query(f"with {_PROFILE} select prot_id, pos, aa, score, n_rows from f")
def profile_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A36-A40."""
    return alignment.profiles(aligned(spark, sf_dir)).withColumn("score", F.col("score") + 0.0)


@query(f"""with {_PROFILE}, v as (select prot_id, pos, residue as wt from c where row_nr = 0 and residue <> '-')
  select v.prot_id, v.pos::int as pos, wt, 'A' as mut, w.score as wt_score, m.score as mut_score, round(w.score - m.score, 3) as difference from v join f w on w.prot_id = v.prot_id and w.pos = v.pos and w.aa = v.wt join f m on m.prot_id = v.prot_id and m.pos = v.pos and m.aa = 'A'""")
def profile_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = aligned(spark, sf_dir)
    wanted = alignment.column_cells(rows).where("row_nr = 0 and residue <> '-'").select("prot_id", "pos", F.col("residue").alias("wt"), F.lit("A").alias("mut"))
    scores = alignment.profiles(rows).withColumn("score", F.col("score") + 0.0)
    return alignment.profile_differences(wanted, scores).withColumn("difference", F.round("difference", 3))


_DAYS = "select user_id, dayofyear(ts)::int - 1 as pos, value from events"


@query(f"select user_id, pos, round(median(value), 6) as median from ({_DAYS}) group by user_id, pos")
def position_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", (F.dayofyear("ts") - 1).alias("pos"), "value")
    return r6(alignment.position_medians(rows, "user_id", "pos", "value"), "median")


@query(f"""with m as (select user_id, pos, median(value) as v from ({_DAYS}) group by user_id, pos), l as (select user_id, max(pos) + 1 as n from m group by user_id),
  w as (select user_id, pos, v, greatest(0, least(pos - 10, n - 21)) as lo, least(n - 1, greatest(0, least(pos - 10, n - 21)) + 20) as hi from m join l using (user_id))
  select w.user_id, w.pos, round(w.v, 6) as median, round(median(m.v), 6) as window_median from w join m on m.user_id = w.user_id and m.pos between w.lo and w.hi group by w.user_id, w.pos, w.v""")
def window_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", (F.dayofyear("ts") - 1).alias("pos"), "value")
    return r6(alignment.window_medians(alignment.position_medians(rows, "user_id", "pos", "value"), "user_id", "pos"), "median", "window_median")


@query("select event_id, round(median(value) over (partition by user_id), 6) as middle from events")
def group_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return r6(alignment.group_median(rows, "user_id", "value", "middle").select("event_id", "middle"), "middle")


@query("""with s as (select o_orderkey, list_sort(list(l_discount)) as e from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey)
  select o_orderkey, round(case when len(e) = 1 then e[1] else greatest(e[1], 0) * greatest(e[2], 0) end, 6) as effect, round(list_sum(e) + 1 - len(e), 6) as additive from s""")
def multi_variant_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("effect"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    sets = orders.join(parts, "o_orderkey").groupBy("o_orderkey").agg(F.collect_list("effect").alias("effects"))
    return r6(sets.select("o_orderkey", expr.combined_effect(F.col("effects")).alias("effect"), expr.additive_effect(F.col("effects")).alias("additive")), "effect", "additive")


@query(f"""with x as ({LONG}), r as (select vec_id, feature, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as r from x)
  select a.feature as feat_a, b.feature as feat_b, round(corr(a.r, b.r), 6) as corr, 1.0::double as cov_a, 1.0::double as cov_b, 1.0::double as cov_both from r a join r b on a.vec_id = b.vec_id and a.feature < b.feature group by 1, 2""")
def feature_pair_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(select.pair_statistics(long_features(spark, sf_dir), "vec_id", complete=True), "corr")


_HOLES = f"select vec_id, label, feature, case when (vec_id + feature[2:]::int) % 5 = 0 then null else value end as value from ({LONG})"


@query(f"""with x as (select * from ({_HOLES}) where value is not null), n as (select count(distinct vec_id) as n from ({_HOLES})),
  p as (select a.feature as feat_a, b.feature as feat_b, a.value as va, b.value as vb from x a join x b on a.vec_id = b.vec_id and a.feature < b.feature),
  r as (select feat_a, feat_b, rank() over (partition by feat_a, feat_b order by va) + (count(*) over (partition by feat_a, feat_b, va) - 1) / 2.0 as ra, rank() over (partition by feat_a, feat_b order by vb) + (count(*) over (partition by feat_a, feat_b, vb) - 1) / 2.0 as rb from p),
  c as (select feature, count(*) as n from x group by feature)
  select feat_a, feat_b, round(corr(ra, rb), 6) as corr, round(any_value(ca.n) / any_value(n.n)::double, 6) as cov_a, round(any_value(cb.n) / any_value(n.n)::double, 6) as cov_b, round(count(*) / (any_value(ca.n) + any_value(cb.n) - count(*))::double, 6) as cov_both
  from r join c ca on ca.feature = feat_a join c cb on cb.feature = feat_b, n group by feat_a, feat_b""")
def feature_pair_corr_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14 with NULLs: ranks are taken anew for each pair."""
    long = long_features(spark, sf_dir)
    long = long.withColumn("value", F.when((F.col("vec_id") + F.substring("feature", 2, 2).cast("int")) % 5 != 0, F.col("value")))
    return r6(select.pair_statistics(long, "vec_id"), "corr", "cov_a", "cov_b", "cov_both")


@query(f"""with r as (select feature, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as a, rank() over (partition by feature order by label) + (count(*) over (partition by feature, label) - 1) / 2.0 as b from ({LONG}))
  select feature, round(corr(a, b), 6) as tv from r group by feature""")
def feature_target_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(select.target_correlation(long_features(spark, sf_dir), "label"), "tv")


@query(f"""with m as (select *, avg(label) over (partition by vec_id % 7) as mean from ({LONG})), r as (select feature, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as a,
  rank() over (partition by feature order by label) + (count(*) over (partition by feature, label) - 1) / 2.0 as b, rank() over (partition by feature order by round(mean, 9)) + (count(*) over (partition by feature, round(mean, 9)) - 1) / 2.0 as c from m)
  select feature, round(abs(corr(a, c)) - abs(corr(a, b)), 6) as bias from r group by feature""")
def bias_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = long_features(spark, sf_dir).withColumn("grp", F.col("vec_id") % 7)
    return r6(select.bias_scores(long, "grp", "label"), "bias")


@query(f"select feature from ({LONG}) group by feature having min(value) = max(value) union all select 'none'")
def constant_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.constant_features(long_features(spark, sf_dir)).union(spark.sql("select 'none' as feature"))


@query("""with q as (select unnest([0.5, 1.0, 2.0, 5.0]) as t) select event_id, max(case when t <= value then t end) as below, min(case when t > value then t end) as above from events, q group by event_id""")
def nearest_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.nearest(table(spark, sf_dir, "events").select("event_id", "value"), "value", [0.5, 1.0, 2.0, 5.0]).select("event_id", "below", "above")


@query("""with c as (select p_partkey, case when p_type like '%STEEL' or p_type like 'S%' then 'x' when p_type like 'E%' then 'y' else 'z' end as cat from part)
  select l_suppkey, cat as category, round(sum(l_discount), 6) as total, arg_max(l_partkey, (abs(l_discount), -l_partkey)) as strongest from lineitem join c on p_partkey = l_partkey group by 1, 2""")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("end", "STEEL", "x"), ("start", "S", "x"), ("start", "E", "y")]
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.coalesce(expr.feature_category(F.col("p_type"), rules), F.lit("z")).alias("category"))
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_discount")
    return r6(explain.category_rollup(lines, part, "l_suppkey", "l_partkey", "l_discount"), "total")


@query("""with d as (select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) as d from events) select event_id, round(log10(exp(sum(ln(log2(d + 1))) over (partition by user_id order by d))), 6) as weight from d""")
def cumulative_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf_dir, "events").withColumn("depth", depth)
    out = explain.path_weights(rows, "user_id", "depth", "weight")
    return r6(out.select("event_id", F.log10("weight").alias("weight")), "weight")


@query(f"""with m as (select feature, avg(value) as bias from ({LONG}) group by feature) select feature, round(bias, 6) as bias from m qualify row_number() over (order by bias desc, feature) > 5""")
def without_most_biased(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = long_features(spark, sf_dir).groupBy("feature").agg(F.avg("value").alias("bias"))
    return r6(select.without_most_biased(means, 5), "bias")
