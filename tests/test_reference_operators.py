"""Micro-fixtures for the semantic traps of the analytics operators."""

import math

import pytest
from pyspark.sql import functions as F

from matrica.functions.stats import average_rank, bh_adjust, check_unique, checked_join, mann_whitney, spearman
from matrica.operators import blocks, contamination, evidence, filters, knn, master, matrix, models, neighborhood, pairs, sample_qc, sequences, views


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_spearman_ties_and_constants(spark):
    df = spark.createDataFrame([("g", 1.0, 1.0), ("g", 1.0, 2.0), ("g", 2.0, 3.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0), ("n", None, 1.0)], "k string, x double, y double")
    out = {r["k"]: r["rho"] for r in spearman(df, ["k"], "x", "y").collect()}
    assert math.isclose(out["g"], 0.8660254037844387) and out["c"] is None and "n" not in out


def test_hot_ranks_equal_plain_ranks(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.floor(F.rand(1) * 400).cast("double").alias("x"), "id")
    plain = average_rank(df, ["k"], "x", "r").select("id", "r")
    hot = average_rank(df, ["k"], "x", "r", hot_limit=100).select("id", "r")
    assert plain.exceptAll(hot).isEmpty() and hot.exceptAll(plain).isEmpty()


def test_bh_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.02), (4, None), (5, 0.9)], "id int, p double")
    got = {r["id"]: r["q_value"] for r in bh_adjust(df.withColumn("t", F.lit(1)), ["t"], "p").collect()}
    assert got[4] is None and [round(got[i], 6) for i in (1, 2, 3, 5)] == [0.026667, 0.026667, 0.026667, 0.9]


def test_mann_whitney_extremes(spark):
    data = [("one", True, 2.0), ("one", False, 1.0), ("half", True, 1.0), ("half", False, 1.0), ("none", True, 1.0)]
    out = {r["f"]: r for r in mann_whitney(spark.createDataFrame(data, "f string, p boolean, x double"), ["f"], "x", "p").collect()}
    assert out["one"]["auc"] == 1 and out["one"]["cliffs_delta"] == 1 and out["half"]["auc"] == 0.5 and out["half"]["z"] is None and out["none"]["auc"] is None
    full = [("f", i < 26, float(i < 26) * 100 + i) for i in range(52)]
    z = mann_whitney(spark.createDataFrame(full, "f string, p boolean, x double"), ["f"], "x", "p").first()["z"]
    assert math.isclose(math.erfc(z / math.sqrt(2)), 6.5475e-10, rel_tol=1e-4)  # 26 against 26, no overlap


def test_join_contracts(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "y")], "k int, a string"), spark.createDataFrame([(1, "z")], "k int, b string")
    assert checked_join(a, b, ["k"], validate="many_to_one").count() == 2
    with pytest.raises(ValueError, match="repeats"):
        checked_join(a, b, ["k"])
    with pytest.raises(ValueError, match="unknown"):
        checked_join(a, b, ["k"], validate="other")
    assert check_unique(b, ["k"]).count() == 1


def test_matrix_forms_and_orders(spark):
    wide = spark.createDataFrame([("s1", 1.0, float("nan")), ("s2", 0.0, 2.0)], "sample string, `f 1` double, f2 double")
    assert rows(matrix.observations(wide), "sample", "feature", "intensity") == [("s1", "f 1", 1.0), ("s1", "f2", None), ("s2", "f 1", 0.0), ("s2", "f2", 2.0)]
    orders = spark.createDataFrame([(1, 1), (1, 4), (1, 4), (1, 70_000), (2, 5), (None, 1), (None, 3), (1, None)], "batch int, run_order int")
    assert rows(matrix.missing_orders(orders), "batch", "first_missing", "last_missing") == [(1, 2, 3), (1, 5, 69_999), (None, 2, 2)]
    with pytest.raises(ValueError, match="lacks"):
        matrix.require_columns(orders, ["sample"], "orders")


def test_outliers_without_spread(spark):
    df = spark.createDataFrame([(i, 1.0, float(i)) for i in range(9)] + [(9, 50.0, 1000.0)], "id int, flat double, x double")
    out = {r["id"]: r for r in sample_qc.flag_outliers(df, ["flat", "x"]).collect()}
    assert out[9]["flat_robust_z"] is None and not out[9]["outlier_flat"] and out[9]["outlier_x"] and out[9]["any_outlier_flag"] and not out[4]["any_outlier_flag"]


def test_review_falls_back_to_sd_and_zero(spark):
    data = [(i, "a", 1.0, 1.0, 1.0, 0.0) for i in range(8)] + [(8, "a", -9.0, -9.0, -9.0, 9.0), (9, "b", 5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(data, "id int, class string, s double, d double, c double, z double")
    out = {r["id"]: r for r in sample_qc.review_samples(df, low=["s", "d", "c"], high=["z"], decisive=["c"], z=2.0).collect()}
    assert out[8]["n_review_flags"] == 4 and out[8]["recommend_exclude"] and out[8]["review_tier"] == "strong_review"
    assert out[9]["s_robust_z_within_class"] == 0 and out[9]["review_tier"] == "keep"


def test_detected_only_with_none_and_one(spark):
    df = spark.createDataFrame([("n", 0.0), ("n", 1.0), ("o", 0.0), ("o", 5.0)], "feature string, intensity double")
    out = {r["feature"]: r for r in filters.detected_only_stats(df, ["feature"], threshold=1.0).collect()}
    assert out["n"]["mean"] is None and out["n"]["detection_rate"] == 0 and out["o"]["median"] == 5 and out["o"]["cv"] is None


def test_views(spark):
    df = spark.createDataFrame([("s", "f", 1.0), ("s", "g", 3.0), ("t", "f", 0.0), ("t", "g", 0.0)], "sample string, feature string, intensity double")
    tic = {(r["sample"], r["feature"]): r["intensity"] for r in views.processing_view(df, "tic_log1p").collect()}
    assert math.isclose(tic["s", "g"], math.log1p(3.0)) and tic["t", "f"] == 0
    with pytest.raises(ValueError, match="unknown"):
        views.processing_view(df, "other")


def test_carryover_takes_the_row_before(spark):
    data = [(i, c, 1, o, "f", float(i + 1) ** 2) for i, (c, o) in enumerate([("B", 1), ("S", 2), ("B", 4), ("S", 9), ("B", 10), ("S", 11), ("B", 12)])]
    df = spark.createDataFrame(data, "sample int, class string, batch int, run_order int, feature string, intensity double")
    out = contamination.blank_carryover(df, ["B"]).first()
    assert out["n_blank_contexts"] == 3 and math.isclose(out["carryover_rho"], 1.0)


def test_pairs_at_the_limits(spark):
    df = spark.createDataFrame([("a", 100.0, 1.0), ("b", 100.002, 1.1), ("c", 100.002, 1.05), ("d", None, 1.0), ("e", 100.0021, 5.0)], "feature string, mz double, rt double")
    got = rows(pairs.isomer_pairs(df), "feature_a", "feature_b")
    assert ("a", "b") in got and ("a", "c") not in got and ("a", "e") not in got and ("b", "e") in got and ("c", "e") in got
    shifts = spark.createDataFrame([("x", 100.0, 1.0), ("y", 101.003355, 1.1), ("z", 102.5, 1.0)], "feature string, mz double, rt double")
    assert rows(pairs.adduct_pairs(shifts), "feature_a", "feature_b", "shift") == [("x", "y", "13C1")]


def test_clusters_are_components(spark):
    import random

    rng = random.Random(1)
    nodes = [f"n{i:03d}" for i in range(120)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(70)] + [(nodes[i], nodes[i + 1]) for i in range(80, 110)]
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    out = pairs.clusters(spark.createDataFrame([(n,) for n in nodes], "feature string"), spark.createDataFrame(edges, "feature_a string, feature_b string"))
    assert {r["feature"]: r["cluster"] for r in out.collect()} == {n: find(n) for n in nodes}


def test_first_per_cluster_is_composite(spark):
    df = spark.createDataFrame([("c", 1, None, "x"), ("c", 2, 7.0, None)], "cluster string, o int, v double, w string")
    assert rows(evidence.first_per_cluster(df, ["cluster"], ["o"], ["v", "w"]), "v", "w", "n_members") == [(7.0, "x", 2)]


def test_sequences(spark):
    df = spark.createDataFrame([(1, "Neu5Ac(a2-3) Gal(b1-4)[Fuc(a1-3)]GlcNAc"), (2, " "), (3, "nan"), (4, None)], "id int, Glycan string")
    out = sequences.standardise_sequences(df, source_name="t", keep=["id"])
    assert rows(out.select("id", sequences.canonical_exact("glycan_sequence").alias("e"), sequences.canonical_topology("glycan_sequence").alias("t")), "id", "e", "t") == [(1, "Neu5Ac(a2-3)Gal(b1-4)[Fuc(a1-3)]GlcNAc", "neu5acgal[fuc]glcnac")]
    with pytest.raises(KeyError):
        sequences.standardise_sequences(df.select("id"), source_name="t")
    tokens = out.select(sequences.interpretable_tokens("glycan_sequence").alias("t")).first()["t"]
    assert tokens[0] == "RES_Neu5Ac" and "LNK_b1-4" in tokens and "BRANCH_OPEN" in tokens and "PAIR_Neu5Ac__Gal" in tokens


def test_master_prefers_earlier_tables(spark):
    schema = "glycan_sequence string, composition string, source_name string, is_n_glycan int"
    a, b = spark.createDataFrame([("s", None, "a", 0)], schema), spark.createDataFrame([("s", "c", "b", 1)], schema)
    assert rows(master.grouped_reference([a, b], ["composition"]), "composition", "is_n_glycan", "source_names") == [("c", 1, "a|b")]
    left = spark.createDataFrame([(None,), ("x",)], "k string")
    binding = spark.createDataFrame([(None, "p", 1.0)], "k string, protein string, binding_value double")
    assert rows(master.binding_aggregates(left, binding, "k", "exact"), "k", "exact_n_proteins") == [("x", 0), (None, 1)]


def test_knn_with_repeats_zeros_and_nulls(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "vec_id bigint, embedding array<double>")
    got = knn.cosine_neighbours(df, df, 2, block=2)
    first = {r["anchor"]: (r["neighbor"], r["cosine_distance"]) for r in got.where("neighbor_rank = 1").collect()}
    assert first == {1: (2, 0.0), 2: (1, 0.0), 3: (1, 1.0), 4: (1, 1.0), 5: (1, 1.0)}


def test_blocks_and_scores(spark):
    df = spark.createDataFrame([(1, ["a", "a"]), (2, ["a"]), (3, ["b"])], "id int, t array<string>")
    assert rows(blocks.onehot_block(df, "id", ["t"], min_count=2), "id", "col") == [(1, "t::a"), (2, "t::a")]
    scored = neighborhood.priority_score(spark.createDataFrame([(0.5, None)], "a double, b double"), {"a": 1.0, "b": 1.0}).first()
    assert scored["priority_score"] == 0.5 and scored["priority_tier"] == "B"


@pytest.mark.parametrize("most", [20_000, 10])
def test_cross_validation_separates_separable_classes(spark, most):
    data = [("t", i, i % 2 == 0, f, v) for i in range(40) for f, v in (("good", float(i % 2 == 0) * 4 + (i * 7 % 11) / 10), ("noise", float(i % 5)))]
    df = spark.createDataFrame(data, "task_name string, sample int, positive boolean, feature string, intensity double")
    folds = models.fold_table(df.select("task_name", "sample", "positive").distinct(), repeats=1)
    if most == 10:  # two folds suffice for the fits over distributed rows
        folds = folds.withColumn("fold", F.least("fold", F.lit(1)))
    metrics, coefficients = models.cross_validate(df, folds, ["good", "noise"], space="s", k_best=2, most_samples=most)
    rows_ = metrics.collect()
    assert len(rows_) == (10 if most > 10 else 4) and all(r["auroc"] > 0.95 and r["precision"] > 0.8 and r["recall"] > 0.8 and r["n_train"] + r["n_test"] == 40 for r in rows_)
    stable = evidence.selection_stability(coefficients, metrics).collect()
    assert {(r["feature"], r["selection_frequency"]) for r in stable} == {("good", 1.0), ("noise", 1.0)}
    assert all(r["sign_consistency"] == 1.0 and r["mean_coefficient"] > 0 for r in stable if r["feature"] == "good")
    assert {r["n_folds"] for r in models.benchmark_summary(metrics).collect()} == {5 if most > 10 else 2}


def test_cluster_evidence_keeps_the_strongest(spark):
    ev = spark.createDataFrame([("t", "a", 0.2, 0.6, 0.1, "x > y"), ("t", "b", 0.01, 0.9, 0.8, "x < y"), ("t", "c", None, 0.7, 0.3, None)], "task_name string, feature string, q_value double, best_auc double, cliffs_delta double, direction string")
    members = spark.createDataFrame([("a", "k", True), ("b", "k", False), ("c", "m", True)], "feature string, cluster string, is_representative boolean")
    got = {r["cluster"]: r for r in evidence.cluster_evidence(ev, members).collect()}
    assert (got["k"]["feature"], got["k"]["best_feature_in_cluster"], got["k"]["matches_best"], got["k"]["n_members"]) == ("a", "b", False, 2)
    assert got["m"]["matches_best"] and [got[k]["cluster_rank"] for k in "km"] == [1, 2]


def test_hot_medians_equal_plain_ones(spark):
    from matrica.functions.robust import medians

    df = spark.range(4000).select((F.col("id") % 2).alias("k"), F.round(F.randn(3) * 50).alias("x"), F.when(F.col("id") % 5 == 0, F.rand(4)).alias("y"), F.lit(1).alias("metric"))
    plain = medians(df, ["k"], {"mx": F.col("x"), "my": F.col("y")})
    hot = medians(df, ["k"], {"mx": F.col("x"), "my": F.col("y")}, hot_limit=100)
    assert rows(plain, "k", "mx", "my") == rows(hot, "k", "mx", "my") == rows(df.groupBy("k").agg(F.median("x").alias("mx"), F.median("y").alias("my")), "k", "mx", "my")
    assert medians(df, [], {"m": F.col("x")}).count() == 1


def test_nearest_standards_by_cells(spark):
    import random

    from matrica.operators import contamination

    rng = random.Random(5)
    feats = [(f"f{i:03d}", rng.uniform(100, 900), rng.uniform(0, 500)) for i in range(80)] + [("n", None, 1.0)]
    stds = [(f"s{i:02d}", rng.uniform(50, 2000), rng.uniform(0, 900)) for i in range(40)] + [("far", 1e9, 1e9), ("none", None, 3.0)]
    f = spark.createDataFrame(feats, "feature string, mz double, rt double")
    s = spark.createDataFrame(stds, "compound_id string, mz double, rt double")
    plain, cells = contamination.match_standards(f, s), contamination.match_standards(f, s, few=3)
    assert rows(plain, *plain.columns) == rows(cells, *plain.columns) and plain.count() == 41


@pytest.mark.parametrize("limit", [10**9, 3])
def test_skewed_join(spark, limit):
    from matrica.functions.keys import join_skewed

    left = spark.createDataFrame([(1, i) for i in range(9)] + [(2, 50), (3, 60), (None, 70)], "k int, v int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, w string")
    assert rows(join_skewed(left, right, "k", "left", limit=limit), "k", "v", "w") == rows(left.join(right, "k", "left"), "k", "v", "w")
