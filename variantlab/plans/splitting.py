"""Splits, leakage checks, subsamples and weights over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlab.operators import splits
from variantlab.plans.common import query, table
from variantlab.plans.statistics import r6


def _hash(*columns: str, seed: int = 0) -> str:
    return f"md5(concat_ws('|', {', '.join(columns)}, '{seed}'))"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts")


@query(f"select event_id, substr({_hash('event_id')}, 1, 8) < '33333333' as test from events")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.holdout(_events(spark, sf_dir), ["event_id"]).select("event_id", "test")


@query(f"""with s as (select user_id, count(*) as n, {_hash('user_id')} as h from events group by user_id), c as (select user_id, coalesce(sum(n) over (order by h, user_id rows between unbounded preceding and 1 preceding), 0) as before, sum(n) over () as total from s)
  select event_id, before < floor(total * 0.2) - floor(total * 0.2) * 0.2 as test from events join c using (user_id)""")
def grouped_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_holdout(_events(spark, sf_dir), "user_id").select("event_id", "test")


@query(f"select event_id, (('0x' || substr({_hash('event_id')}, 1, 8))::bigint % 4)::int as fold from events")
def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.kfold(_events(spark, sf_dir), ["event_id"]).select("event_id", "fold")


@query("""with recursive s as (select user_id, count(*) as n, row_number() over (order by user_id) as i from events group by user_id), t as (select sum(n) / 4.0 as share from s),
  w as (select i, user_id, 0 as fold, n as size from s where i = 1 union all
    select s.i, s.user_id, case when w.fold < 3 and (w.size >= share or abs(w.size + s.n - share) > abs(w.size - share)) then w.fold + 1 else w.fold end,
      case when w.fold < 3 and (w.size >= share or abs(w.size + s.n - share) > abs(w.size - share)) then s.n else w.size + s.n end from w join s on s.i = w.i + 1, t)
  select event_id, fold from events join w using (user_id)""")
def grouped_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.grouped_kfold(_events(spark, sf_dir), "user_id").select("event_id", "fold")


@query("select event_type as fold, count(*) as n_test, (select count(*) from events) - count(*) as n_train from events group by event_type")
def leave_one_group_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.leave_one_out(_events(spark, sf_dir), "event_type")
    total = rows.agg(F.count("*").alias("n"))
    return rows.groupBy("fold").agg(F.count("*").alias("n_test")).crossJoin(F.broadcast(total)).select("fold", "n_test", (F.col("n") - F.col("n_test")).alias("n_train"))


@query("select event_id, (user_id % 3)::int as fold from events where user_id % 5 <> 0")
def given_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    bins = events.where("user_id % 5 <> 0").select("user_id", (F.col("user_id") % 3).cast("int").alias("bin")).distinct()
    return splits.given_folds(events, bins, ["user_id"]).select("event_id", "fold")


@query(f"""with f as (select (('0x' || substr({_hash('event_id')}, 1, 8))::bigint % 4)::int as fold from events) select o.i::int as "outer", fold as "inner", count(*) as n from f, range(4) o(i) where fold <> o.i group by 1, 2""")
def nested_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.kfold(_events(spark, sf_dir), ["event_id"])
    return splits.nested_folds(rows).groupBy("outer", "inner").agg(F.count("*").alias("n"))


_TEST = "(select * from events where dayofyear(ts) % 4 = 0)"
_TRAIN = "(select * from events where dayofyear(ts) % 4 <> 0)"


def _train_test(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _events(spark, sf_dir).withColumn("day", F.dayofyear("ts"))
    return rows.where("day % 4 <> 0"), rows.where("day % 4 = 0")


@query(f"select (select count(*) from {_TRAIN} t where exists (select 1 from {_TEST} s where s.user_id = t.user_id and s.event_type = t.event_type)) as type1, (select count(*) from {_TRAIN} t where user_id in (select user_id from {_TEST} s)) as type2")
def circularity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return splits.circularity(train, test, ["user_id", "event_type"], "user_id")


@query(f"select event_id from {_TRAIN} t where not exists (select 1 from {_TEST} s where s.user_id = t.user_id and s.event_type = t.event_type)")
def leak_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return splits.without_leaks(train, test, ["user_id", "event_type"]).select("event_id")


@query(f"""with d as (select doc_id, source, toxic, {_hash('doc_id')} as h from documents join labels using (doc_id)), c as (select source, toxic, count(*) as n from d group by 1, 2),
  u as (select source, min(n) as least from c group by source having count(*) > 1 or sum(n) = 1)
  select doc_id from (select doc_id, source, row_number() over (partition by source, toxic order by h, doc_id) as i from d) join u using (source) where i <= least""")
def balanced_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return splits.balanced(rows, "source", "toxic", "doc_id").select("doc_id")


@query("""with e as (select user_id, event_id, value, abs(value - 1.0) as d, (value >= 1.0)::int as side from events where value is not null),
  n as (select user_id, count(*) filter (side = 0) as n0, count(*) filter (side = 1) as n1, sum(d) filter (side = 0) as s0, sum(d) filter (side = 1) as s1 from e group by user_id having n0 > 0 and n1 > 0),
  w as (select user_id, case when n0 < n1 then 0 else 1 end as few, least(n0, n1) as m, greatest(n0, n1) as a, case when n0 < n1 then s0 else s1 end as s from n),
  r as (select e.*, few, m, a, s, row_number() over o - 1 as pos, sum(d) over (partition by e.user_id, side order by d, event_id rows between current row and unbounded following) as rest from e join w on w.user_id = e.user_id window o as (partition by e.user_id, side order by d, event_id)),
  k as (select x.user_id, arg_min(x.pos, (round(abs(x.rest - coalesce(y.rest, 0) - x.s), 6), x.pos)) as k0 from r x left join r y on y.user_id = x.user_id and y.side = x.side and y.pos = x.pos + x.m where x.side <> x.few and x.pos <= x.a - x.m group by x.user_id)
  select r.user_id, event_id, value::double as value from r join k on k.user_id = r.user_id where side = few or (pos >= k0 and pos < k0 + m)""")
def levelled_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.levelled(_events(spark, sf_dir), "user_id", "event_id", "value", 1.0)


@query(f"select event_id from events order by {_hash('event_id', seed=7)}, event_id limit 500")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X10, whose feature is the number of rows."""
    return splits.sample_rows(_events(spark, sf_dir), ["event_id"], 500, 7).select("event_id")


@query("""with e as (select event_id, user_id, case when dayofyear(ts) % 4 = 0 then 'test' else 'train' end as role from events)
  select event_id, round(count(*) over (partition by role) / (count(*) over (partition by user_id))::double, 6) as weight from e""")
def inverse_frequency_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("role", F.when(F.dayofyear("ts") % 4 == 0, "test").otherwise("train"))
    return r6(splits.inverse_frequency(rows, "user_id", "role").select("event_id", "weight"), "weight")


@query("with m as (select avg(value) as m, var_pop(value) as v from events) select value, round((value - m) ** 2 + v, 3) as weight from (select distinct value from events), m")
def distance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.distance_weights(_events(spark, sf_dir), "value").withColumn("weight", F.round("weight", 3))


@query("with c as (select l_quantity as q, count(*) as n from lineitem group by 1) select a.q as l_quantity, round(sum(abs(a.q - b.q) * b.n) / sum(b.n), 6) as weight from c a, c b group by 1")
def distance_weights_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(splits.distance_weights(table(spark, sf_dir, "lineitem"), "l_quantity", 1.0), "weight")


@query("with c as (select value, count(*) as n from events where value is not null group by 1) select a.value, round(sum(sqrt(abs(a.value - b.value)) * b.n) / sum(b.n), 6) as weight from c a, c b group by 1")
def distance_weights_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22 for a power that has no closed form."""
    return r6(splits.distance_weights(_events(spark, sf_dir), "value", 0.5), "weight")


@query(f"with m as (select user_id, avg(value) as m from {_TRAIN} group by user_id) select event_id, round(coalesce(m, 0.5), 6) as mean_target from {_TEST} left join m using (user_id)")
def group_mean_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return r6(splits.group_means(train, test, ["user_id"], "value", "mean_target").select("event_id", "mean_target"), "mean_target")


@query(f"with m as (select user_id, event_type, avg(value) as m from {_TRAIN} group by 1, 2) select event_id, round(coalesce(m, 0.5), 6) as mean_target from {_TEST} left join m using (user_id, event_type)")
def position_mean_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    return r6(splits.group_means(train, test, ["user_id", "event_type"], "value", "mean_target").select("event_id", "mean_target"), "mean_target")


@query(f"select (select count(*) from events where user_id not in (select user_id from {_TEST} s where event_type = 'click') and user_id not in (select user_id from {_TEST} s where event_type = 'view')) as n_left, (select count(*) from (select user_id from {_TRAIN} t intersect select user_id from {_TEST} s)) as n_common")
def group_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _train_test(spark, sf_dir)
    left = splits.without_groups(_events(spark, sf_dir), "user_id", test.where("event_type = 'click'"), test.where("event_type = 'view'")).agg(F.count("*").alias("n_left"))
    return left.crossJoin(splits.common_groups(train, test, "user_id").agg(F.count("*").alias("n_common")))


@query(f"""with n as (select count(*) as n from events), s as (select value as t from events order by {_hash('event_id')}, event_id limit (select least(n, greatest(100, round(n * 0.005)))::bigint from n)), v as (select distinct value from events)
  select value, round(avg((value - t) ** 2), 6) as weight from v, s group by value""")
def sampled_distance_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, whose feature is the sample's size."""
    return r6(splits.sampled_distance_weights(_events(spark, sf_dir), ["event_id"], "value"), "weight")
