"""Models over the given tables. SQL can't express training, so tests hold these against properties and small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variantlab.operators import boosting, encode, explain, model, report, select, stats
from variantlab.plans.common import query, table
from variantlab.plans.statistics import r6
from variantlab.tables import scratch

WIDTH = 64


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, grp, fold, label (double), features."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return rows.withColumns({"fold": (F.col("vec_id") % 3).cast("int"), "grp": F.col("vec_id") % 10})


@query()
def forest_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.vectors(samples(spark, sf_dir))
    fitted = model.forest(rows.where("fold <> 0"), "label", 10, 5)
    return fitted.transform(rows).select("vec_id", "label", (F.col("fold") == 0).alias("held_out"), "prediction")


BOOSTING = boosting.Settings(rounds=5, depth=3, bins=16, patience=3)

ROOT_SPLITS = """
with v as (select vec_id, vec_id % 3 as fold, label::double as y, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as feature from embeddings),
o as (select feature, x, row_number() over (partition by feature order by x) as r, count(*) over (partition by feature) as n from v),
e as (select distinct feature, min(x) as e from o, (select unnest(generate_series(1, 15)) as k) where r >= ceil(k * n / 16.0) group by feature, k),
m as (select run, avg(label::double) as base from embeddings, (select unnest([0, 1, 2]) as run) where vec_id % 3 <> run group by run),
b as (select v.vec_id, v.fold, v.y, v.feature, count(e.e) as bin from v left join e on e.feature = v.feature and e.e < v.x group by all),
c as (select run, feature, bin, sum(base - y) as g, count(*) as n from b join m on b.fold <> m.run group by run, feature, bin),
s as (select *, sum(g) over l as gl, sum(n) over l as nl, sum(g) over a as ga, sum(n) over a as na from c
  window l as (partition by run, feature order by bin rows unbounded preceding), a as (partition by run, feature)),
k as (select *, gl * gl / (nl + 1) + (ga - gl) * (ga - gl) / (na - nl + 1) - ga * ga / (na + 1) as gain from s where na > nl),
f as (select feature, e, row_number() over (partition by feature order by e) - 1 as bin from e)
select run, k.feature, e as threshold, round(gain, 6) as gain, nl::bigint as n_left, (na - nl)::bigint as n_right
from k join f on f.feature = k.feature and f.bin = k.bin
qualify row_number() over (partition by run, k.feature order by round(gain, 9) desc, k.bin) = 1
"""


@query(ROOT_SPLITS)
def boosted_root_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best first split of every feature, of three folds at once, from their histograms."""
    rows = samples(spark, sf_dir)
    bins = boosting.bins_of(rows, WIDTH, BOOSTING.bins)
    runs = [boosting.Run(k) for k in range(3)]
    for k, r in enumerate(runs):
        r.base = rows.where(F.col("fold") != k).agg(F.avg("label")).first()[0] or 0.0
    state = boosting.first_level(runs, BOOSTING, WIDTH)
    found = boosting.splits(boosting.cells(boosting.binned(rows, bins, ["vec_id"], "label", "grp", "fold"), state), BOOSTING)
    edges = spark.createDataFrame([(f, i, float(e)) for f, own in enumerate(bins.edges) for i, e in enumerate(own)], "feature int, bin int, threshold double")
    best = boosting.best_splits(found, "run", "feature").join(edges, ["feature", "bin"])
    return best.select("run", "feature", "threshold", F.round("gain", 6).alias("gain"), "n_left", "n_right")


@query()
def boosted_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three folds trained side by side, each stopped by its own objective; every sample predicted by the run that didn't see it."""
    rows = samples(spark, sf_dir)
    found = boosting.cross_validated(rows, ["vec_id"], "label", "grp", "fold", 3, WIDTH, BOOSTING, final=False)
    return boosting.out_of_fold(rows, found, "fold").select("vec_id", "fold", "label", "prediction")


@query()
def boosted_two_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    fitted, kept = boosting.two_rounds(rows, ["vec_id"], "label", "grp", "fold", 0, WIDTH, BOOSTING, BOOSTING)
    narrow = rows.withColumn("_kept", F.array(*[F.get("features", i) for i in kept]))
    return fitted.predicted(narrow, "_kept").select("vec_id", "label", "prediction")


@query()
def confusion_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.confusion_selection(samples(spark, sf_dir), ["vec_id"], "fold", 3, "label", WIDTH, 8, trees=5, depth=4)


@query()
def attribution_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.vectors(samples(spark, sf_dir))
    fitted = model.forest(rows.where("fold <> 0"), "label", 8, 4)
    out = fitted.transform(rows)
    shares = explain.shapley(out, explain.node_table(fitted), ["vec_id"], target="label")
    return explain.impacts(shares, out, ["vec_id"], "label", "prediction")


@query()
def attribution_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.vectors(samples(spark, sf_dir))
    fitted = model.forest(rows, "label", 6, 4)
    shares = explain.attributions(rows, explain.node_table(fitted), ["vec_id"])
    catalog = spark.range(WIDTH).select(F.col("id").cast("int").alias("feature"), F.concat(F.lit("part"), (F.col("id") % 4).cast("string")).alias("category"))
    return explain.category_rollup(shares, catalog, "vec_id", "feature", "value")


@query()
def tree_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model.vectors(samples(spark, sf_dir))
    fitted = model.forest(rows, "label", 6, 4)
    paths = explain.decision_paths(rows, explain.node_table(fitted), ["vec_id"], target="label")
    return explain.tree_spread(paths, ["vec_id"]).join(explain.tree_extremes(paths, ["vec_id"], "label"), "vec_id").join(explain.sample_losses(paths, ["vec_id"], "label"), "vec_id")


@query()
def lasso_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = model.lasso_selection(model.vectors(samples(spark, sf_dir)), "label", 3)
    return spark.createDataFrame([(i,) for i in kept], "feature int")


@query()
def hinge_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features that tell labels from each other by an L1-penalised squared hinge."""
    rows = samples(spark, sf_dir)
    classes = sorted(r.label for r in rows.select("label").distinct().collect())
    kept = model.hinge_selection(rows, "label", classes, WIDTH, 3, penalty=0.01, steps=40)
    return spark.createDataFrame([(i,) for i in kept], "feature int")


@query()
def bayes_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The objective is a job over all samples: how well a weighted pair of features ranks labels within groups."""
    rows = samples(spark, sf_dir).select("grp", "label", F.get("features", 0).alias("a"), F.get("features", 1).alias("b")).cache()

    def objective(point: dict[str, float]) -> float:
        score = rows.withColumn("s", F.col("a") * point["wa"] + F.col("b") * point["wb"])
        return stats.mean_group_corr(stats.group_spearman(score, ["grp"], "label", "s")).first().mean_abs_r

    search = model.Search({"wa": (-1.0, 1.0), "wb": (-1.0, 1.0)})
    search.run(objective, 6)
    rows.unpersist()
    out = spark.createDataFrame([(i, p["wa"], p["wb"], v) for i, (p, v) in enumerate(search.seen)], "step int, wa double, wb double, score double")
    return r6(out, "wa", "wb", "score")


@query()
def feature_rank_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importances of a forest as a rank table."""
    fitted = model.forest(model.vectors(samples(spark, sf_dir)), "label", 10, 5)
    found = model.importances(fitted, [f"f{i:02d}" for i in range(WIDTH)], 0.0)
    return select.rank_table(spark.createDataFrame(found, "feature string, score double"), "feature", "score")


@query("select count(*) as n, count(*) as n_equal from embeddings")
def saved_model_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written and read predicts what it did before."""
    rows = model.vectors(samples(spark, sf_dir))
    fitted = model.forest(rows, "label", 4, 4)
    path = scratch(spark, "model")
    model.saved(fitted, path)
    again = model.loaded(type(fitted), path).transform(rows.select("vec_id", "vector")).select("vec_id", F.col("prediction").alias("again"))
    both = fitted.transform(rows).select("vec_id", "prediction").join(again, "vec_id")
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("prediction") == F.col("again")).alias("n_equal"))


_GROUPS = {f"f{i:02d}": f"g{i % 3}" for i in range(WIDTH)}


@query(f"""with v as (select vec_id, 'f' || lpad((i - 1)::varchar, 2, '0') as feature, (i - 1) % 3 as g, embedding[i]::double as x from embeddings, generate_series(1, {WIDTH}) t(i))
  select vec_id, count(*) as n_features, round(sum(x), 6) as total from v where g <> 1 and feature not in ('f02', 'f03') group by vec_id""")
def active_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """samples by the features that are neither dropped nor of a dropped group."""
    rows = samples(spark, sf_dir)
    wide = rows.select("vec_id", *[F.get("features", i).alias(f"f{i:02d}") for i in range(WIDTH)])
    kept = encode.matrix(wide, ["vec_id"], report.active(list(_GROUPS), _GROUPS, {"g1"}, {"f02", "f03"}))
    return r6(kept.select("vec_id", F.size("features").cast("long").alias("n_features"), F.aggregate("features", F.lit(0.0), lambda a, x: a + x).alias("total")), "total")
