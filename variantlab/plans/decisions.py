"""Decisions of trees, selections and joins of predictions over the given tables: what needs no training has SQL.

The paths here come from the line items: an order is a sample, its lines are the decisions of three trees.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from variantlab.operators import encode, explain, model, partition, search, select, splits
from variantlab.plans.common import query, table
from variantlab.plans.features import _ALIGNED, aligned
from variantlab.plans.statistics import LONG, long_features, r6
from variantlab.tables import written

_ORDER = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax"
_PATHS = f"""select l_orderkey as sample, (l_suppkey % 3)::int as tree, (l_partkey % 40)::int as feature, (row_number() over (partition by l_orderkey, l_suppkey % 3 order by {_ORDER}))::int as depth,
  ((l_orderkey * 7 + l_suppkey % 3 * 13) % 100) / 10.0::double as prediction, (l_orderkey % 50) / 5.0::double as target from lineitem"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = F.col("l_suppkey") % 3
    depth = F.row_number().over(Window.partitionBy("l_orderkey", tree).orderBy(*_ORDER.split(", ")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample"), tree.cast("int").alias("tree"), (F.col("l_partkey") % 40).cast("int").alias("feature"), depth.alias("depth"),
        (((F.col("l_orderkey") * 7 + tree * 13) % 100) / 10.0).alias("prediction"), ((F.col("l_orderkey") % 50) / 5.0).alias("target"),
        F.col("l_discount").cast("double").alias("threshold"), F.col("l_tax").cast("double").alias("value"),
    )


_ERRORS = f"select *, sqrt(abs(prediction - target)) * exp(sum(ln(log2(depth + 1))) over (partition by sample, tree order by depth)) as e from ({_PATHS})"


_SIDES = "s as (select vec_id, embedding[1] <= 0 as a, embedding[2] <= 0 as b from embeddings)"


def _two_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple]]:
    """Samples and a tree that splits by their first feature, then on the right by the second; covers are the rows' counts."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    a, b = (F.get("features", i) <= 0 for i in (0, 1))
    n, left, low = (float(c) for c in rows.agg(F.count("*"), F.count_if(a), F.count_if(~a & b)).first())
    right, p = n - left, lambda x, y: x / y if y else 0.0
    inner = p(low * 2 + (right - low) * 4, right)
    return rows, [
        (0, 0, 1, 2, 0, 0.0, p(left + right * inner, n), 1, n), (0, 1, -1, -1, -1, 0.0, 1.0, 2, left), (0, 2, 3, 4, 1, 0.0, inner, 2, right),
        (0, 3, -1, -1, -1, 0.0, 2.0, 3, low), (0, 4, -1, -1, -1, 0.0, 4.0, 3, right - low),
    ]


@query(f"""with {_SIDES}, c as (select count(*) filter (a) / count(*) as p, count(*) filter (not a and b) / count(*) filter (not a) as q from s),
  v as (select vec_id, p + (1 - p) * (4 - 2 * q) as v0, case when a then 1 else 4 - 2 * q end as va, p + (1 - p) * case when b then 2 else 4 end as vb, case when a then 1 when b then 2 else 4 end as vab from s, c)
  select vec_id, 0 as feature, round((va - v0 + vab - vb) / 2, 6) as value from v union all select vec_id, 1, round((vb - v0 + vab - va) / 2, 6) from v""")
def shapley_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15, for a tree of two splits."""
    rows, nodes = _two_splits(spark, sf_dir)
    return r6(explain.shapley(rows, nodes, ["vec_id"]), "value")


@query(f"""with {_SIDES}, c as (select count(*) filter (a) / count(*) as p, count(*) filter (not a and b) / count(*) filter (not a) as q from s),
  v as (select vec_id, a, case when a then 1 else 4 - 2 * q end - (p + (1 - p) * (4 - 2 * q)) as f0, case when b then 2 else 4 end - (4 - 2 * q) as f1 from s, c)
  select vec_id, 0 as feature, round(f0, 6) as value from v union all select vec_id, 1, round(f1, 6) from v where not a""")
def path_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M15 along paths, for a tree of two splits."""
    rows, nodes = _two_splits(spark, sf_dir)
    return r6(explain.attributions(rows, nodes, ["vec_id"]), "value")


@query(f"""with c as (select feature, round(round(sum(e) / count(*) ** 0.9, 5), 3) as confusion, count(*) as n from ({_ERRORS}) group by feature)
  select i::int as feature, coalesce(confusion, 0.9)::double as confusion, coalesce(n, 0) as n from range(45) r(i) left join c on c.feature = i""")
def confusion_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion of features from raw errors, which serve any exponents."""
    raw = explain.raw_errors(paths(spark, sf_dir), ["sample"], "target")
    return explain.confusion_of(raw, power=0.5, norm=0.9, goodwill=0.1, all_features=45).withColumn("confusion", F.round("confusion", 3))


@query(f"with c as (select feature, sample % 4 as fold, round(sum(e) / count(*), 5) as confusion from ({_ERRORS}) group by 1, 2) select feature, max(confusion) as confusion from c group by feature")
def worst_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A28."""
    rows, parts = paths(spark, sf_dir), None
    for fold in range(4):
        part = explain.confusion(rows.where(F.col("sample") % 4 == fold), ["sample"], "target", power=0.5)
        parts = part if parts is None else parts.union(part)
    return explain.worst_confusion(parts)


@query(f"""with t as (select sample, tree, any_value(prediction) as p, any_value(target) as y from ({_PATHS}) group by 1, 2)
  select sample, round(stddev_samp(p), 6) as tree_sd, arg_min(tree, (abs(y - p), tree)) as best_tree, arg_max(tree, (abs(y - p), -tree)) as worst_tree, round(sum(abs(p - y)), 6) as loss from t group by sample""")
def tree_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A35, T06, A49."""
    rows = paths(spark, sf_dir)
    out = explain.tree_spread(rows, ["sample"]).join(explain.tree_extremes(rows, ["sample"], "target"), "sample")
    return r6(out.join(explain.sample_losses(rows, ["sample"], "target"), "sample"), "tree_sd", "loss")


_LEAVES = f"select sample, tree, arg_max(feature, depth) as leaf from ({_PATHS}) group by 1, 2"


@query(f"""with l as ({_LEAVES}), c as (select a.tree as ta, b.tree as tb, a.leaf as la, b.leaf as lb, count(*) as n from l a join l b on a.sample = b.sample and a.tree < b.tree group by 1, 2, 3, 4),
  j as (select ta, tb, sum(n * n) as s, sum(n) as n from c group by 1, 2), x as (select ta, tb, sum(m * m) as s from (select ta, tb, la, sum(n) as m from c group by 1, 2, 3) group by 1, 2), y as (select ta, tb, sum(m * m) as s from (select ta, tb, lb, sum(n) as m from c group by 1, 2, 3) group by 1, 2),
  d as (select ta, tb, case when j.n > 1 then (x.s + y.s - 2 * j.s) / (j.n * (j.n - 1))::double end as d from j join x using (ta, tb) join y using (ta, tb)),
  m as (select tree, avg(d) as m from (select ta as tree, d from d union all select tb, d from d) group by tree)
  select tree, round(m, 6) as mean_distance, row_number() over (order by m is null, round(m, 9), tree) as rank from m""")
def representative_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees by how alike they put samples into leaves."""
    leaves = paths(spark, sf_dir).groupBy("sample", "tree").agg(F.max_by("feature", "depth").alias("leaf"))
    return r6(explain.representative_trees(explain.tree_distances(leaves, ["sample"])), "mean_distance")


@query(f"""with t as (select sample, tree, abs(any_value(prediction) - any_value(target)) as d from ({_PATHS}) group by 1, 2)
  select sample, arg_min(tree, (d, tree)) as tree, round(min(d), 6) as distance from t group by sample""")
def nearest_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M17, by sample."""
    return r6(explain.nearest_tree(paths(spark, sf_dir), ["sample"], "target"), "distance")


_CUTS = _PATHS.replace("as target", "as target, l_discount::double as threshold, l_tax::double as value")


@query(f"""with p as ({_CUTS}), t as (select sample, tree, abs(any_value(target) - any_value(prediction)) as e from p group by 1, 2), w as (select sample, tree, avg(e) over (partition by sample) - e as w from t),
  f as (select sample, tree, feature, max(threshold) filter (threshold <= value) as l, min(threshold) filter (threshold > value) as r from p group by 1, 2, 3)
  select sample, feature, round(sum(w), 6) + 0.0 as weight, max(l) as below, min(r) as above from f join w using (sample, tree) group by 1, 2""")
def explained_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M16."""
    out = explain.explained(paths(spark, sf_dir), ["sample"], "target")
    return out.withColumn("weight", F.round("weight", 6) + F.lit(0.0))


@query(f"select feature, list_aggregate(list_sort(list(distinct tree))::varchar[], 'string_agg', ',') as trees from ({_PATHS}) group by feature")
def feature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32."""
    nodes = paths(spark, sf_dir).withColumn("left", F.lit(1))
    return explain.feature_trees(nodes).select("feature", F.array_join(F.col("trees").cast("array<string>"), ",").alias("trees"))


@query(f"select sample, tree, depth, feature, row_number() over (partition by sample order by tree, depth) as place from ({_PATHS}) qualify row_number() over (partition by sample order by tree, depth) <= 3")
def first_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T08, whose feature is the number of decisions."""
    return explain.first_decisions(paths(spark, sf_dir), ["sample"], 3).select("sample", "tree", "depth", "feature", "place")


_SHARES = "select l_orderkey as sample, (l_partkey % 40)::int as feature, sum(l_discount) as value from lineitem group by 1, 2"
_PREDICTED = "select o_orderkey as sample, o_totalprice / 100000 as y, (o_orderkey % 100) / 20.0::double as p from orders"


def _impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("sample"), (F.col("l_partkey") % 40).cast("int").alias("feature")).agg(F.sum("l_discount").alias("value"))
    predicted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample"), (F.col("o_totalprice") / 100000).alias("y"), ((F.col("o_orderkey") % 100) / 20.0).alias("p"))
    return r6(explain.impacts(shares, predicted, ["sample"], "y", "p"), "impact")


_IMPACTS = f"select feature, round(sum(abs(y - p) - abs(y - (p - value))) / (select count(*) from orders), 6) as impact from ({_SHARES}) join ({_PREDICTED}) using (sample) group by feature"


@query(_IMPACTS)
def feature_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    return _impacts(spark, sf_dir)


@query(f"with i as ({_IMPACTS}) select feature from i where impact >= (select median(impact) from i)")
def harmful_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold is the middle impact of the features."""
    found = _impacts(spark, sf_dir)
    return select.harmful(found, found.agg(F.median("impact")).first()[0])


@query(f"with m as (select feature, round(avg(value), 6) as score from ({LONG}) group by feature) select feature, score from m order by score, feature limit 7")
def lowest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T02, whose feature is the number of features kept."""
    means = r6(long_features(spark, sf_dir).groupBy("feature").agg(F.avg("value").alias("score")), "score")
    return select.lowest(means, "feature", "score", 7)


@query("select event_id, -1 as fold from events")
def full_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X06."""
    return splits.full_slice(table(spark, sf_dir, "events").select("event_id"))


_GREEDY = f"""with recursive r as (select vec_id, feature, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as r from ({LONG})),
  n as (select feature, row_number() over (order by feature) - 1 as i from (select distinct feature from r)),
  c as (select a.feature as fa, b.feature as fb, corr(a.r, b.r) as c from r a join r b on a.vec_id = b.vec_id and a.feature <> b.feature group by 1, 2 having abs(corr(a.r, b.r)) > 0.1),
  e as (select n.i, coalesce(list(m.i) filter (m.i is not null), []) as l from n left join c on c.fa = n.feature left join n m on m.feature = c.fb group by n.i),
  w(i, kept) as (select -1::bigint, []::bigint[] union all select w.i + 1, case when list_has_any(w.kept, e.l) then w.kept else list_append(w.kept, e.i) end from w join e on e.i = w.i + 1)
  select feature from n where not list_contains((select arg_max(kept, i) from w), n.i)"""


@query(_GREEDY)
def correlated_feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that a scan in their order drops, as a kept one before them correlates too much."""
    pairs = select.pair_statistics(long_features(spark, sf_dir), "vec_id", complete=True)
    gone = select.correlated_filter(pairs, [f"f{i:02d}" for i in range(64)], 0.1)
    return spark.createDataFrame([(x,) for x in gone], "feature string")


# joins of predictions


@query("""with p as (select l_partkey as part, avg(l_discount) as p from lineitem group by 1), s as (select l_orderkey, list_sort(list(p)) as e from lineitem join p on part = l_partkey group by 1)
  select l_orderkey, round(case when len(e) = 1 then e[1] else greatest(e[1], 0) * greatest(e[2], 0) end, 6) as effect from s""")
def combined_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sets' effects from their parts' predictions, all of which must be there."""
    lines = table(spark, sf_dir, "lineitem")
    known = lines.groupBy(F.col("l_partkey").alias("part")).agg(F.avg("l_discount").alias("p"))
    sets = lines.groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"))
    return r6(model.combined_predictions(sets, known, "l_orderkey", "parts", "part", "p"), "effect")


@query("select event_id, user_id, round(p, 6) as p from events left join (select c_custkey, c_acctbal as p from customer where c_custkey % 3 = 0) on c_custkey = user_id")
def prediction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12."""
    known = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("p"))
    return r6(model.looked_up(table(spark, sf_dir, "events").select("event_id", "user_id"), known, ["user_id"], "p"), "p")


@query("""with h as (select * from events where event_id % 100 = 1), f as (select event_type, min(event_id) as f from h group by event_type), d as (select event_type, row_number() over (order by f) - 1 as code from f),
  n as (select event_type, min(event_id) as f from events where event_type not in (select event_type from d) group by event_type),
  a as (select event_type, code from d union all select event_type, (select coalesce(max(code), -1) from d) + row_number() over (order by f) from n)
  select event_id, round(coalesce(value, (select min(value) - abs(max(value) - min(value)) from h)), 6) as value, code::double as code, 0.0::double as oh_new from events join a using (event_type)""")
def prediction_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to predict, by the categories and the imputed values of the training rows; unknown categories get new codes."""
    from variantlab.operators import clean

    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    train = events.where("event_id % 100 = 1")
    known = {"event_type": encode.dictionary(train, "event_type", "event_id")}
    out = model.prediction_input(events, ["event_id"], known, "event_id", clean.impute_values(train, ["value"]), ["value", "event_type", "oh_new"])
    x = F.col("features")
    return out.select("event_id", F.round(x[0], 6).alias("value"), x[1].alias("code"), x[2].alias("oh_new"))


# clusters of sequences


@query(f"""with recursive s as (select prot_id * 1000 + row_nr as id, replace(aligned, '-', '') as s from ({_ALIGNED})), k as (select distinct id, substr(s, i, 5) as w from (select *, unnest(generate_series(1, length(s) - 4)) as i from s)),
  e as (select a.id as u, b.id as v from k a join k b on a.w = b.w and a.id <> b.id group by 1, 2 having count(*) >= 6), c(id, x) as (select id, id from s union select c.id, e.v from c join e on e.u = c.x)
  select id, min(x) as cluster from c group by id""")
def similarity_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters over any number of links, which folds keep together."""
    rows = aligned(spark, sf_dir).select((F.col("prot_id") * 1000 + F.col("row_nr")).alias("id"), F.replace("aligned", F.lit("-"), F.lit("")).alias("s"))
    return search.similarity_folds(rows, "id", "s", 3, least=6).select("id", "cluster")


def _similar(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sequences as nodes, and links by the number of words that two share."""
    rows = aligned(spark, sf_dir).select((F.col("prot_id") * 1000 + F.col("row_nr")).alias("id"), F.replace("aligned", F.lit("-"), F.lit("")).alias("s"))
    links = search.shared_words(rows, rows, "id", "s", 5, 2, 1 << 30).select(F.col("query").alias("u"), F.col("target").alias("v"), (F.col("n_shared") / 2).alias("weight"))
    return rows.select("id", F.lit(1.0).alias("size")), written(links, "links")


@query()
def balanced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of sequences that share few words across them, each within a tenth of an equal share."""
    nodes, links = _similar(spark, sf_dir)
    return partition.balanced_split(nodes, links, 3, 0.1, rounds=6, orders=6).select("id", F.col("part").alias("fold"))


@query(f"""with s as (select prot_id * 1000 + row_nr as id, replace(aligned, '-', '') as s from ({_ALIGNED})), k as (select distinct id, substr(s, i, 5) as w from (select *, unnest(generate_series(1, length(s) - 4)) as i from s)),
  e as (select a.id as u, b.id as v, count(*) as n from k a join k b on a.w = b.w and a.id < b.id group by 1, 2 having count(*) >= 2)
  select 3::bigint as n_parts, true as within, true as below_plain, (select count(*) from s) as n_rows, (select coalesce(sum(n), 0)::double from e) as weight""")
def balanced_split_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds' sizes are within their bounds, and their cut is below that of folds by the id's remainder."""
    nodes, links = _similar(spark, sf_dir)
    found = partition.balanced_split(nodes, links, 3, 0.1, rounds=6, orders=6)
    plain = partition.split_report(nodes.withColumn("part", (F.col("id") % 3).cast("int")), links).select(F.col("cut").alias("plain"))
    n = found.agg(F.count("*").alias("n_rows"))
    within = (F.col("largest") <= F.ceil(F.col("n_rows") / 3 * 1.1)) & (F.col("smallest") >= F.floor(F.col("n_rows") / 3 * 0.9))
    rows = partition.split_report(found, links).crossJoin(F.broadcast(plain)).crossJoin(F.broadcast(n))
    return rows.select("n_parts", within.alias("within"), (F.col("cut") <= F.col("plain")).alias("below_plain"), "n_rows", "weight")
