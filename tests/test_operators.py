"""Small cases worked out by hand, and properties that must hold."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from variantlab.functions import expr
from variantlab.operators import alignment, clean, encode, explain, model, report, search, select, splits, stats
from variantlab.sources import sequences, settings, tables
from variantlab.streaming import incremental
from variantlab.tables import running


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", float: "double", int: "int", list: "array<double>", type(None): "string"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize("text,value", [("-", None), ("None", None), ("inf", None), ("7", 7.0), (" 7 ", 7.0), ("1.5", 1.5), ("1e3", 1000.0), ("abc", None), ("", None)])
def test_cells(spark, text, value):
    assert one(spark, expr.as_real(F.col("t")), t=text) == value


@pytest.mark.parametrize("tags,effect", [("#e:1.5,#e=2.5,x", 2.0), ("#e:bad", None), ("#f:9", None), ("", None), ("#e:1:2", None)])
def test_tag_effect(spark, tags, effect):
    assert one(spark, expr.tag_effect(F.col("t"), "#e"), t=tags) == effect


def test_tag_label(spark):
    assert one(spark, expr.tag_label(F.col("t")), t="label:a,x, label:b") == "b"
    assert one(spark, expr.tag_label(F.col("t")), t="x") is None


@pytest.mark.parametrize("effects,value", [([0.5], 0.5), ([-0.5], -0.5), ([0.5, 0.4], 0.2), ([3.0, 0.5, 0.4], 0.2), ([0.5, -1.0], 0.0)])
def test_combined_effect(spark, effects, value):
    assert one(spark, expr.combined_effect(F.col("e")), e=effects) == pytest.approx(value)


def test_residues(spark):
    assert [one(spark, expr.residue_index(F.col("r")), r=r) for r in ("A", "v", "-", "AR")] == [0, 19, -1, -1]
    assert one(spark, expr.substitution(F.lit("W"), F.col("r")), r="F") == one(spark, expr.substitution(F.lit("F"), F.col("r")), r="W") == 1
    matrix = np.array(expr.blosum())
    assert matrix.shape == (20, 20) and (matrix == matrix.T).all() and (np.diag(matrix) >= 4).all()
    assert one(spark, expr.feature_category(F.col("n")), n="Site_x") == "structural conservation"
    assert one(spark, expr.feature_category(F.col("n")), n="zzz") is None


def test_correlation_of_constant_and_single_groups(spark):
    df = spark.createDataFrame([("c", 1.0, 2.0), ("c", 1.0, 3.0), ("s", 1.0, 1.0), ("t", 1.0, 1.0), ("t", 1.0, 2.0), ("t", 2.0, 3.0)], "g string, a double, b double")
    r = {x.g: x.r for x in stats.group_spearman(df, ["g"], "a", "b").collect()}
    assert r["c"] is None and r["s"] is None and r["t"] == pytest.approx(0.8660254)
    mean = stats.mean_group_corr(stats.group_spearman(df, ["g"], "a", "b")).first()
    assert (mean.n_groups, mean.n_undefined) == (3, 2) and mean.mean_abs_r == pytest.approx(0.8660254)
    assert stats.mean_group_corr(stats.group_spearman(df.limit(0), ["g"], "a", "b")).first().mean_abs_r == 0


def test_sliced_ranks_are_ranks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(g), float(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 2, 500), rng.integers(0, 40, 500)))]
    df = spark.createDataFrame(rows, "id int, g int, v double")
    a = {r.id: r.r for r in stats.ranked(df, "v", "r", ["g"]).collect()}
    b = {r.id: r.r for r in df.select("id", stats.avg_rank("v", "g").alias("r")).collect()}
    assert a == b


def test_spearman_survives_monotone_maps(spark):
    df = spark.range(200).select(F.lit(1).alias("g"), F.pmod(F.hash("id"), F.lit(50)).cast("double").alias("a"), F.pmod(F.hash("id", F.lit(3)), F.lit(50)).cast("double").alias("b"))
    r = stats.group_spearman(df, ["g"], "a", "b").first().r
    assert stats.group_spearman(df.withColumn("a", F.exp(F.col("a") / 10)), ["g"], "a", "b").first().r == pytest.approx(r)


def test_histogram_outliers(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(100)] + [(100, 1000.0), (101, None)], "id int, t double")
    kept = {r.id for r in clean.histogram_outliers(df, "t").collect()}
    assert kept == {*range(100), 101}
    same = spark.createDataFrame([(i, 1.0) for i in range(50)], "id int, t double")
    assert clean.histogram_outliers(same, "t").count() == 50
    assert clean.histogram_outliers(same.limit(0), "t").count() == 0


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (None, None)], "a double, b double")
    values = clean.impute_values(df, ["a", "b"])
    assert values == {"a": -1.0, "b": 0.0}
    assert sorted(r.a for r in clean.imputed(df, values).collect()) == [-1.0, 1.0, 3.0]


def test_dictionary_keeps_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "i int, c string")
    known = encode.dictionary(df.where("i < 3"), "c", "i")
    assert {r.value: r.code for r in known.collect()} == {"b": 0, "a": 1}
    assert {r.value: r.code for r in encode.extended(known, df, "c", "i").collect()} == {"b": 0, "a": 1, None: 2}


@pytest.mark.parametrize("length", [1, 15, 20, 21, 22, 60])
def test_window_median_at_borders(spark, length):
    rng = np.random.default_rng(length)
    values = rng.normal(size=length)
    df = spark.createDataFrame([("p", i, float(v)) for i, v in enumerate(values)], "prot_id string, pos int, median double")
    got = {r.pos: r.window_median for r in alignment.window_medians(df, "prot_id", "pos").collect()}
    for i in range(length):
        low = max(0, min(i - 10, length - 21))
        assert got[i] == pytest.approx(np.median(values[low : low + 21]))


def test_profile_by_hand():
    codes = np.array([[0, 1, -1, 3], [0, 2, -1, 3], [0, 1, -1, -1]])
    s = alignment.similarities(codes)
    # all three rows have residue 0 in column 0: distinct residues by column 1, 2, (none), 1
    assert s[0, 0] == pytest.approx(4 / 3) and s[1, 2] == 1 and s[2].sum() == 0
    # rows 0 and 2 have residue 1 in column 1: 1, 1, (none), 1
    assert s[1, 1] == 1 and s[3, 3] == pytest.approx(4 / 3)
    n = alignment.effective_number(np.array([0.0, 0.5, 1.0, 4 / 3, 17.9, 18.0]))
    assert n.tolist() == [0.0, 1.0, 1.0, 1.5, 55.0, 100.0]
    score = alignment.profile(codes)
    assert (score[2] == 0).all() and score[0, 0] > 0 > score[0].min()
    background, matrix = np.array(alignment.BACKGROUND), np.array(expr.blosum(), float)
    share = np.zeros(20)
    share[0] = 1.0
    pseudo = background * (np.exp(0.225 * matrix) @ share)
    total = 1.5
    expected = np.log(((total - 1) * share + 5 * math.sqrt(total) * pseudo) / (total - 1 + 5 * math.sqrt(total)) / background)
    assert score[0] == pytest.approx(np.round(expected, 3))


def test_seed_gaps_are_cut(spark):
    df = spark.createDataFrame([("p", 0, "A-CD"), ("p", 1, "AX-D"), ("p", 2, "-X--")], "prot_id string, row_nr int, aligned string")
    assert sorted((r.row_nr, r.aligned) for r in alignment.ungapped(df).collect()) == [(0, "ACD"), (1, "A-D")]


def test_composition_shares_sum_to_one(spark):
    df = spark.createDataFrame([("p", 0, "AC"), ("p", 1, "A-"), ("p", 2, "GC"), ("p", 3, "TC")], "prot_id string, row_nr int, aligned string")
    variants = spark.createDataFrame([("p", 0, "A", "G"), ("p", 1, "C", "W"), ("p", 9, "A", "G")], "prot_id string, pos int, wt string, mut string")
    got = {r.pos: r for r in alignment.composition(variants, alignment.column_cells(df)).collect()}
    assert (got[0].wt_share, got[0].mut_share, got[0].other_share) == (0.5, 0.25, 0.25)
    assert (got[1].wt_share, got[1].gap_share, got[1].wt_share_filled) == (0.75, 0.25, 1.0)
    assert got[9].wt_share is None


def test_correlated_filter_depends_on_order(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9, 1.0, 1.0, 1.0, 0.1, 0.9), ("b", "c", 0.9, 1.0, 1.0, 1.0, 0.9, 0.2), ("a", "c", 0.1, 1.0, 1.0, 1.0, 0.1, 0.2)], "feat_a string, feat_b string, corr double, cov_a double, cov_b double, cov_both double, tv_a double, tv_b double")
    assert select.correlated_filter(pairs, ["a", "b", "c"], 0.5) == ["b"]
    assert select.correlated_filter(pairs, ["b", "a", "c"], 0.5) == ["a", "c"]
    assert select.correlated_filter(pairs, ["a", "b", "c"], 0.5, mode="by_score") == ["a", "c"]


def test_pair_statistics_with_disjoint_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", None), (2, "b", 2.0), (3, "a", 3.0), (3, "b", 3.0), (4, "a", 4.0), (4, "b", 5.0)], "id int, feature string, value double")
    r = select.pair_statistics(df, "id").first()
    assert (r.cov_a, r.cov_b, r.cov_both) == (0.75, 0.75, 0.5) and r.corr == pytest.approx(1.0)


def packed_in_order(sizes, k):
    """The fold of each size, one after the other."""
    share, out, size = sum(sizes) / k, [], 0
    for n in sizes:
        fold = out[-1] if out else 0
        if fold < k - 1 and size and (size >= share or abs(size + n - share) > abs(size - share)):
            fold, size = fold + 1, 0
        out.append(fold)
        size += n
    return out


def test_grouped_folds_pack_in_order(spark):
    rng = np.random.default_rng(5)
    for sizes in ([50, 1, 1, 1, 20, 20], [3], [1, 1, 60, 1], rng.integers(1, 30, 40).tolist()):
        df = spark.createDataFrame([(f"{i:03d}",) for i, n in enumerate(sizes) for _ in range(n)], "g string")
        got = dict(splits.grouped_kfold(df, "g", 4).distinct().collect())
        assert [got[f"{i:03d}"] for i in range(len(sizes))] == packed_in_order(sizes, 4)
    assert packed_in_order([50, 1, 1, 1, 20, 20], 4) == [0, 1, 1, 1, 1, 2]
    assert splits.grouped_kfold(df.limit(0), "g").count() == 0


def test_running_totals_and_quantiles(spark):
    rng = np.random.default_rng(6)
    values = rng.integers(0, 40, 300)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "id int, v int").repartition(5)
    got = {r.id: r.s for r in running(df, ["v", "id"], {"s": F.col("v")}).collect()}
    order = sorted(range(300), key=lambda i: (values[i], i))
    assert got == dict(zip(order, np.cumsum(values[order]).tolist()))
    rows = [(g, None if v % 11 == 0 else float(v)) for g, v in zip(["a", "b", None, "a"] * 75, values)] + [("empty", None), ("one", 2.5)]
    parts = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.low, r.mid, r.top) for r in stats.quantiles(parts, ["g"], "v", {"low": 0.25, "mid": 0.5, "top": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "one"}
    for g, found in got.items():
        assert found == pytest.approx(np.quantile([v for h, v in rows if h == g and v is not None], [0.25, 0.5, 1.0]))
    assert stats.quantiles(parts.limit(0), ["g"], "v", {"mid": 0.5}).count() == 0


def test_group_correlation_in_slices(spark):
    df = spark.range(400).select(F.when(F.col("id") % 5 > 0, "hot").alias("g"), F.pmod(F.xxhash64("id"), F.lit(30)).alias("a"), (F.col("id") % 37).cast("double").alias("b"))
    one, two = ({r.g: (r.n, r.r) for r in stats.group_spearman(df, ["g"], "a", "b", sliced).collect()} for sliced in (False, True))
    assert set(one) == {"hot", None}
    for g in one:
        assert one[g] == pytest.approx(two[g])


def test_levelled_groups_are_the_best_stretches(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 800, "hot").when(F.col("id") < 950, "other").when(F.col("id") < 990, F.lit(None)).otherwise("high").alias("g"), (F.when(F.col("id") < 990, F.xxhash64("id") % 100 / 100.0).otherwise(5.0)).alias("v"))
    df = df.union(spark.createDataFrame([(2000, "hot", None), (2001, "hot", float("nan")), (2002, "one", 1.0)], "id long, g string, v double"))
    given, got = {}, {}
    for table, rows in ((given, df.collect()), (got, splits.levelled(df, "g", "id", "v", 0.1).collect())):
        for r in rows:
            if r.v is not None and r.v == r.v:
                table.setdefault(r.g, []).append((abs(r.v - 0.1), r.id, r.v >= 0.1))
    assert set(got) == {"hot", "other", None}
    for g, own in got.items():
        low, high = ([x for x in sorted(given[g]) if x[2] is side] for side in (False, True))
        few, many = (low, high) if len(low) < len(high) else (high, low)
        m, total = len(few), sum(x[0] for x in few)
        k = min(range(len(many) - m + 1), key=lambda i: (round(abs(sum(x[0] for x in many[i : i + m]) - total), 6), i))
        assert sorted(own) == sorted(few + many[k : k + m])


def test_folds_and_leaks(spark):
    df = spark.range(400).select("id", (F.col("id") % 13).alias("g"))
    parts = splits.grouped_kfold(df, "g", 4)
    assert parts.count() == 400 and parts.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    train, test = parts.where("fold <> 0"), parts.where("fold = 0")
    assert splits.circularity(train, test, ["id"], "g").first() == (0, 0)
    assert splits.without_leaks(df, test, ["g"]).join(test, "g", "left_semi").count() == 0
    a = {r.id for r in splits.sample_rows(df, ["id"], 50, 3).collect()}
    assert a == {r.id for r in splits.sample_rows(df.repartition(7), ["id"], 50, 3).collect()} and len(a) == 50


def test_weights(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 4.0)], "id int, t double")
    for power in (1.0, 2.0, 3.0):
        got = {r.t: r.weight for r in splits.distance_weights(df, "t", power).collect()}
        assert got == pytest.approx({t: np.mean([abs(t - u) ** power for u in (1.0, 1.0, 4.0)]) for t in (1.0, 4.0)})


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    rows = [(i, float(2 * a + 0.1 * b), [float(a), float(b), float(c)]) for i, (a, b, c) in enumerate(x)]
    df = model.vectors(spark.createDataFrame(rows, "id int, y double, features array<double>"))
    return df, model.forest(df, "y", 5, 4)


def test_attributions_add_up(fitted):
    df, forest = fitted
    nodes = explain.node_table(forest)
    base = np.mean([n[6] for n in nodes if n[7] == 1])
    sums = {r.id: r.s for r in explain.attributions(df, nodes, ["id"]).groupBy("id").agg(F.sum("value").alias("s")).collect()}
    for r in forest.transform(df).collect():
        assert base + sums.get(r.id, 0.0) == pytest.approx(r.prediction)


def test_paths_end_in_the_trees_predictions(fitted):
    df, forest = fitted
    paths = explain.decision_paths(df, explain.node_table(forest), ["id"], target="y")
    mean = {r.id: r.p for r in paths.groupBy("id", "tree").agg(F.first("prediction").alias("p")).groupBy("id").agg(F.avg("p").alias("p")).collect()}
    assert all(mean[r.id] == pytest.approx(r.prediction) for r in forest.transform(df).collect())
    worst = explain.confusion(paths, ["id"], "y", all_features=4, goodwill=0.25)
    assert {r.feature: r.confusion for r in worst.collect()}[3] == 0.75


def test_missing_part_is_an_error(spark):
    sets = spark.createDataFrame([("s", ["a", "b"])], "id string, parts array<string>")
    known = spark.createDataFrame([("a", 0.5), ("b", 0.4)], "part string, prediction double")
    assert model.combined_predictions(sets, known, "id", "parts", "part", "prediction").first().effect == pytest.approx(0.2)
    with pytest.raises(Exception, match="no prediction"):
        model.combined_predictions(sets, known.limit(1), "id", "parts", "part", "prediction").collect()


def test_search_nears_the_top():
    search = model.Search({"a": (0.0, 1.0), "b": (0.0, 10.0)}, frozenset({"b"}))
    best, value = search.run(lambda p: -((p["a"] - 0.3) ** 2) - ((p["b"] - 7) / 10) ** 2, 25)
    assert value > -0.02 and best["b"] == round(best["b"])
    assert len({tuple(p.items()) for p, _ in search.seen}) == len(search.seen)


def test_feature_table(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("Uniprot Ac\tAAC\tTarget value\tTags\tn\tx\ty\tWT Amino Acid\nP1\tA1G\t0.5\t#e:1,#e=2\t3\t1\t1\tA\nP1\tA2G\tNone\t\tbad\t-\t2.5\tG\n")
    df, features = tables.feature_table(spark, str(path))
    assert features == ["x", "y", "Wildtype AA"] and dict(df.dtypes)["x"] == "bigint" and dict(df.dtypes)["y"] == "double"
    rows = {r.aac: r for r in df.collect()}
    assert (rows["A1G"].target, rows["A1G"].structures, rows["A2G"].target, rows["A2G"].structures, rows["A2G"].x) == (0.5, 3, None, 0, None)
    tagged, _ = tables.feature_table(spark, str(path), target_tag="#e")
    assert {r.aac: r.target for r in tagged.collect()} == {"A1G": 1.5, "A2G": None}
    tables.write_samples(df, str(tmp_path / "out"))
    again, _ = tables.feature_table(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, df.collect()))


def test_sequences(spark, tmp_path):
    path = tmp_path / "s.fasta"
    path.write_text(">sp|P1|X some text\nacd/\nE*F\n>Q2 other\nGG\n\n>R3\n")
    got = {r.prot_id: r.seq for r in sequences.fasta(spark, str(path)).collect()}
    assert got == {"P1": "ACDEF", "Q2": "GG", "R3": ""}
    sequences.write_fasta(spark.createDataFrame([("A", "CC"), ("B", "DD")], "prot_id string, seq string").coalesce(1), str(tmp_path / "out"))
    assert {r.prot_id: r.seq for r in sequences.fasta(spark, str(tmp_path / "out")).collect()} == {"A": "CC", "B": "DD"}
    aligned = tmp_path / "P9.fa"
    aligned.write_text(">P9\nA-C\n>h1\nAGC\n")
    assert [tuple(r) for r in sequences.alignment(spark, str(aligned)).orderBy("row_nr").collect()] == [("P9", 0, "P9", "A-C"), ("P9", 1, "h1", "AGC")]
    assert tuple(sequences.pairwise(spark, str(aligned)).select("hit_id", "q_aln", "t_aln").first()) == ("h1", "A-C", "AGC")


def test_profile_files(spark, tmp_path):
    scores = spark.createDataFrame([("p", pos, aa, 0.5 + i / 100, 3) for pos in range(2) for i, aa in enumerate(expr.RESIDUES)], "prot_id string, pos int, aa string, score double, n_rows int")
    lines = [r.line for r in tables.profile_lines(scores).orderBy("pos").collect()]
    assert lines[0].startswith("0001 +0.500 +0.510") and lines[1].endswith("  3")
    path = tmp_path / "p.txt"
    path.write_text("File: x\nPos A R\n" + "\n".join(lines) + "\n")
    back = {(r.pos, r.aa): r.score for r in tables.profile_table(spark, str(path), "p").collect()}
    assert len(back) == 40 and back[1, "R"] == 0.51


def test_matrix_and_settings(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text('"V1" "V2"\n"a" NA -0.5\n"c" 0.25 NA\n')
    assert {r.aac: r.value for r in tables.effect_matrix(spark, str(path), "p", "GW").collect()} == {"W2A": -0.5, "G1C": 0.25}
    assert settings.pairs("a = 1 # c\n# b = 2\nc = x = y\n") == [("a", "1"), ("c", "x")]
    assert settings.hyperparameters("depth 7\nrate = 0.1\nkind = gbt") == {"depth": 7, "rate": 0.1, "kind": "gbt"}
    assert settings.updated("a = 1\nb = 2\n", "b", 3) == "a = 1\nb = 3\n" and settings.updated("", "z", 1) == "\nz = 1\n".lstrip()


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i % 3, f"f{i % 2}", None if i % 5 == 0 else float(i % 4)) for i in range(60)]
    schema = "g int, feature string, value double"
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.running_coverage(incremental.samples(spark, str(tmp_path / "in"), schema, 1), "g")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("cover").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    batch = clean.coverage(spark.createDataFrame(rows, schema), "g")
    assert sorted(map(tuple, spark.table("cover").collect())) == sorted(map(tuple, batch.collect()))


def test_search_and_pairwise_alignment(spark):
    rows = spark.createDataFrame([("a", "ARNDCQEGHIL"), ("b", "ARNDCQEGHAL"), ("c", "WWWWWWWWW"), ("d", "AR")], "id string, s string")
    hits = {(r.query, r.target): r.n_shared for r in search.shared_words(rows, rows, "id", "s", 5).collect()}
    assert hits == {("a", "b"): 5, ("b", "a"): 5}
    assert search.aligned_pair("ARND", "AND") == ("ARND", "A-ND", 4 - 8 + 6 + 6)
    assert search.aligned_pair("", "AC")[:2] == ("--", "AC")
    pairs = spark.createDataFrame([("ARND", "ARND"), (None, "A")], "q_seq string, t_seq string")
    assert [(r.q_aln, r.t_aln) for r in search.aligned_hits(pairs).collect()] == [("ARND", "ARND"), ("-", "A")]


def test_similar_sequences_share_a_fold(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    rows = spark.createDataFrame([("a", "ARNDCQEGHIL"), ("b", "ARNDCQEGHAL"), ("c", "WWWWWWFFFFF"), ("d", "MMMMMMKKKKK")], "id string, s string")
    fold = {r.id: r.fold for r in search.similarity_folds(rows, "id", "s", 2).collect()}
    assert fold["a"] == fold["b"] != fold["c"] == fold["d"]


def test_reports():
    assert report.OBJECTIVES["mse"].better(0.1, 0.2) and not report.OBJECTIVES["r2"].better(0.1, 0.2) and report.OBJECTIVES["r2"].better(0.1, None)
    assert report.cross_validated(3, lambda k: 0.5, 0.9) == [0.5] and len(report.cross_validated(3, lambda k: 0.9, 0.9)) == 3
    assert report.active(["b", "a", "c"], {"c": "g"}, {"g"}) == ["a", "b"] and report.bound("max", 5) == 4.0
    assert report.estimated_full(0.5, 0.4, 0.45) == pytest.approx(0.55)


def test_other_readers(spark, tmp_path):
    xml = tmp_path / "h.xml"
    xml.write_text("<Out><Hit><Hit_id>sp|P1|x</Hit_id><Hit_def>d</Hit_def><Hit_len>9</Hit_len><Hit_hsps><Hsp><Hsp_evalue>1e-5</Hsp_evalue><Hsp_hseq>AC-D</Hsp_hseq></Hsp></Hit_hsps></Hit></Out>")
    assert [tuple(r) for r in tables.blast_hits(spark, str(xml)).collect()] == [("P1", 9, 1e-5, "ACD")]
    aln = tmp_path / "a.aln"
    aln.write_text("CLUSTAL\n\nq   AC-\nh   ACD\n    **\n\nq   GG\nh   -G\n")
    assert [tuple(r) for r in tables.block_alignment(spark, str(aln), "p").orderBy("row_nr").collect()] == [("p", 0, "q", "AC-GG"), ("p", 1, "h", "ACD-G")]
    assert tables.substitution_matrix("# x\n  A R\nA 4 -1\nR -1 5\n")["A", "R"] == -1.0
    wanted, stored = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a",)], "id string")
    assert [r.id for r in tables.missing(wanted, stored, "id").collect()] == ["b"]


def test_saved_models(fitted, tmp_path):
    from pyspark.ml.regression import RandomForestRegressionModel

    df, forest = fitted
    model.saved(forest, str(tmp_path / "m"))
    again = model.loaded(RandomForestRegressionModel, str(tmp_path / "m"))
    assert again.transform(df).first().prediction == forest.transform(df).first().prediction
    info = model.ensemble_info(forest)
    assert info["trees"] == 5 and info["nodes"] == info["trees"] + 2 * info["splits"]
    with pytest.raises(ValueError, match="no selection"):
        model.selected("other", df)
    assert 0 in model.selected("lasso", df, target="y", exponent=1)


def test_contributions_sum_to_the_prediction(spark):
    from variantlab.operators import explain, model

    rows = model.vectors(spark.createDataFrame([(i, float(i % 7 + (i % 3) * 2), [float(i % 7), float(i % 3), float(i % 5)]) for i in range(200)], "id long, y double, features array<double>"))
    for fitted in (model.forest(rows, "y", 4, 3), model.boosted(rows, "y", 6, 3)):
        nodes, weights = explain.node_table(fitted), explain.tree_weights(fitted)
        shares = {r.id: r.v for r in explain.attributions(rows, nodes, ["id"], weights=weights).groupBy("id").agg(F.sum("value").alias("v")).collect()}
        base = explain.base_value(nodes, weights)
        for r in fitted.transform(rows).collect():
            assert abs(base + shares.get(r.id, 0.0) - r.prediction) < 1e-9
