"""Parsing, filtering, encoding and imputation over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlab.functions import expr
from variantlab.operators import clean, encode
from variantlab.plans.common import query, table
from variantlab.plans.statistics import r6


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 7 == 0, "-").when(F.col("event_id") % 7 == 1, "None").when(F.col("event_id") % 7 == 2, "inf").when(F.col("event_id") % 7 == 3, F.concat(F.lit(" "), k, F.lit(".5 "))).otherwise(k)
    return table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))


@query("""select event_id, case event_id % 7 when 0 then null when 1 then null when 2 then null when 3 then (props->>'$.k')::double + 0.5 else (props->>'$.k')::double end as x,
  case when event_id % 7 < 3 then 'None' else null end as missing from events""")
def typed_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    x = expr.as_real(F.col("raw"))
    return cells.select("event_id", x.alias("x"), F.when(x.isNull(), expr.as_text(x)).alias("missing"))


@query("""select event_id, round(case when event_id % 5 = 0 then null else ((props->>'$.k')::double + value) / 2 end, 6) as effect from events""")
def tag_effect_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    good = F.concat(F.lit("x,#e:"), k, F.lit(",#e="), F.col("value").cast("string"), F.lit(",#e:bad,#f:9"))
    tags = F.when(F.col("event_id") % 5 == 0, F.lit("plain,#e:none")).otherwise(good)
    return r6(table(spark, sf_dir, "events").select("event_id", expr.tag_effect(tags, "#e").alias("effect")), "effect")


@query("select event_id, event_type as label from events")
def tag_label_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.concat(F.lit("label:first, other,label:"), "event_type")
    return table(spark, sf_dir, "events").select("event_id", expr.tag_label(tags).alias("label"))


_AAC = "substr('ARNDCQEGHILKMFPSTWYV', (p_partkey % 20)::int + 1, 1) || p_size || substr('ARNDCQEGHILKMFPSTWYV', (p_partkey // 20 % 20)::int + 1, 1)"


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter = lambda i: F.substring(F.lit(expr.RESIDUES), i.cast("int") + 1, F.lit(1))
    aac = expr.variant(letter(F.col("p_partkey") % 20), F.col("p_size"), letter(F.floor(F.col("p_partkey") / 20) % 20))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice", aac.alias("aac"))


@query(f"select p_partkey, left(aac, 1) as wt, p_size as pos, right(aac, 1) as mut, p_size || right(aac, 1) as site from (select p_partkey, p_size, {_AAC} as aac from part)")
def variant_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("aac")
    return _variants(spark, sf_dir).select("p_partkey", expr.wild_type(a).alias("wt"), expr.position(a).alias("pos"), expr.mutant(a).alias("mut"), F.concat(expr.position(a).cast("string"), expr.mutant(a)).alias("site"))


@query(f"select p_partkey, aac from (select p_partkey, p_brand, {_AAC} as aac from part) where left(aac, 1) <> right(aac, 1) and p_brand <> 'Brand#11' and p_partkey % 11 <> 0")
def standard_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir).withColumn("tags", F.when(F.col("p_partkey") % 11 == 0, "a,drop").otherwise("a,b"))
    return clean.standard_filter(rows, group="p_brand", target="p_retailprice", tags="tags", aac="aac", drop_groups=["Brand#11"], drop_tags=["drop"]).select("p_partkey", "aac")


@query("""with a as (select value as t, event_id from events), s as (select count(*) as n, min(t) as lo, max(t) as hi from a),
  b as (select event_id, t, least(floor((t - lo) / ((hi - lo) / floor(4 * log10(n)))), floor(4 * log10(n)) - 1) as bin, n from a, s)
  select event_id from b qualify count(*) over (partition by bin) > floor(log10(n))""")
def histogram_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.histogram_outliers(table(spark, sf_dir, "events"), "value").select("event_id")


@query("""with e as (select event_id, case when event_id % 4 = 0 then null else value end as v from events), m as (select min(v) as lo, max(v) as hi from e)
  select event_id, round(coalesce(v, lo - abs(hi - lo)), 6) as v from e, m""")
def range_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("v"))
    return r6(clean.imputed(rows, clean.impute_values(rows, ["v"])), "v")


@query("select o_orderkey, round(sqrt(greatest(o_totalprice - 200000, 0)), 6) as t, case when o_totalprice < 200000 then 0 else 1 end as y from orders")
def target_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return r6(table(spark, sf_dir, "orders").select("o_orderkey", expr.root_target(p - 200000).alias("t"), expr.binarised(p, 200000).alias("y")), "t")


@query(f"""with v as (select p_partkey, p_retailprice as t, p_size, {_AAC} as aac from part)
  select p_partkey, aac, round(t, 6) as t from v union all select p_partkey, right(aac, 1) || p_size || left(aac, 1), round(1000 - t, 6) from v""")
def reverse_augment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _variants(spark, sf_dir).select("p_partkey", "aac", F.col("p_retailprice").alias("t"))
    return r6(clean.reversed_variants(rows, "aac", "t", 1000.0), "t")


@query("""select event_id, (event_type = 'click')::int as oh_event_type_click, (event_type = 'view')::int as oh_event_type_view, (event_type = 'purchase')::int as oh_event_type_purchase from events""")
def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.one_hot(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", ["click", "view", "purchase"])


@query("""with f as (select event_type, min(event_id) as f from events group by event_type), d as (select event_type, row_number() over (order by f) - 1 as code from f)
  select event_id, code from events join d using (event_type)""")
def dictionary_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    return encode.encoded(events, "event_type", encode.dictionary(events, "event_type", "event_id"), "code").select("event_id", "code")


@query("""with h as (select * from events where event_id % 100 = 1), f as (select event_type, min(event_id) as f from h group by event_type), d as (select event_type, row_number() over (order by f) - 1 as code from f),
  n as (select event_type, min(event_id) as f from events where event_type not in (select event_type from d) group by event_type)
  select event_type as value, code from d union all select event_type, (select coalesce(max(code), -1) from d) + row_number() over (order by f) from n""")
def dictionary_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "event_type")
    known = encode.dictionary(events.where("event_id % 100 = 1"), "event_type", "event_id")
    return encode.extended(known, events, "event_type", "event_id")


@query("select l_returnflag as value, count(*) as n, row_number() over (order by count(*) desc, l_returnflag) - 1 as code from lineitem group by l_returnflag")
def frequency_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.by_frequency(table(spark, sf_dir, "lineitem"), "l_returnflag")


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in long form: user_id, feature (event type), value, some of them NULL or 0."""
    v = F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 6 == 1, 0.0).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("feature"), v.alias("value"))


_LONG = "select event_id, user_id, event_type as feature, case event_id % 6 when 0 then null when 1 then 0.0 else value end as value from events"


@query(f"select user_id, feature, round(avg((value is not null)::int), 6) as cov, round(avg(coalesce((value = 0)::int, 0)), 6) as zeros, count(*) as total from ({_LONG}) group by user_id, feature")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(clean.coverage(event_values(spark, sf_dir), "user_id"), "cov", "zeros")


@query(f"""select user_id, round(avg((value is not null)::int) filter (feature = 'click'), 6) as click_cov, round(avg(coalesce((value = 0)::int, 0)) filter (feature = 'click'), 6) as click_zeros, count(*) filter (feature = 'click') as click_total,
  round(avg((value is not null)::int) filter (feature = 'view'), 6) as view_cov, round(avg(coalesce((value = 0)::int, 0)) filter (feature = 'view'), 6) as view_zeros, count(*) filter (feature = 'view') as view_total from ({_LONG}) group by user_id""")
def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean.coverage_matrix(event_values(spark, sf_dir), "user_id", ["click", "view"])
    out = r6(out, "click_cov", "click_zeros", "view_cov", "view_zeros")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("click_total", "view_total")})


@query(f"""select event_id from events where user_id not in (select user_id from (select user_id, avg((value is not null)::int) as c, avg(coalesce((value = 0)::int, 0)) as z from ({_LONG}) where feature = 'click' group by user_id) where c < 0.8 or z > 0.2)""")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = event_values(spark, sf_dir)
    poor = clean.poor_groups(clean.coverage(long, "user_id"), "user_id", "click", 0.8, 0.2)
    return table(spark, sf_dir, "events").join(poor, "user_id", "left_anti").select("event_id")


@query("select source, count(*) as n, count(distinct toxic) as n_targets, count(distinct toxic) = 1 as pure from documents join labels using (doc_id) group by source")
def pure_mixed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return clean.pure_groups(rows, "source", "toxic")


@query("with s as (select least(count(*), 41) as size from events group by user_id) select size, count(*) as n_groups from s group by size")
def size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.size_histogram(table(spark, sf_dir, "events"), "user_id")


@query("""with c as (select source, count(*) filter (toxic = 1) as a, count(*) filter (toxic <> 1) as b from documents join labels using (doc_id) group by source)
  select case when least(a, b) = 0 then 'pure' when greatest(a, b) >= least(a, b) * 4 then 'major' else 'mixed' end as kind, count(*) as n_groups from c group by 1""")
def label_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return clean.label_mixture(rows, "source", F.col("toxic") == 1)


@query("""select user_id, dayofyear(ts) as site, min(case when value < 1 then 0 else 1 end) as label, count(*) as n, arg_min(event_type, event_id) as event_type from events group by 1, 2""")
def position_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("site", F.dayofyear("ts"))
    return clean.fused_positions(rows, "user_id", "site", "value", ["event_type"], "event_id", 1.0)


@query("""select c_custkey as id, c_nationkey as nation, c_acctbal as balance from customer where c_custkey not in (select s_suppkey from supplier) union all select s_suppkey, s_nationkey, s_acctbal from supplier""")
def support_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    right = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return clean.fused(left, right, ["id"])


@query("""with e as (select event_id, value, event_type from events) select event_id, coalesce(case when event_type = 'click' then value end, 0.0) as click, coalesce(case when event_type = 'view' then value end, 0.0) as view from e""")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("feature"), "value")
    return encode.wide(long, ["event_id"], ["click", "view"])


@query("""select e.event_id, coalesce(case when c.event_type = 'click' then c.value end, case when e.event_id % 2 = 0 then e.value end) as x, case when c.event_type = 'click' then c.event_type end as kind, e.value < 1 as below
  from events e left join events c on c.event_id = e.event_id and c.event_type = 'click'""")
def feature_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    samples = events.select("event_id", "value", F.when(F.col("event_id") % 2 == 0, F.col("value")).alias("x"))
    found = events.where("event_type = 'click'").select("event_id", F.col("value").alias("x"), F.col("event_type").alias("kind"))
    return clean.two_sides(clean.upserted(samples, found, ["event_id"], ["x", "kind"]), "value", 1.0).select("event_id", "x", "kind", "below")
