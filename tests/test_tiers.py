"""Tiers from the stability of selections, significant tests and redundancy."""

from matrica.operators import evidence


def test_tiers_need_stable_selection(spark):
    features = spark.createDataFrame([(f, f, True, True, False) for f in ("stable", "never", "signs", "weak")], "feature string, cluster string, is_representative boolean, high_confidence boolean, warning boolean")
    tests = spark.createDataFrame([("stable", 0.95, True), ("stable", 0.6, False), ("never", 0.95, True), ("signs", 0.95, True), ("weak", 0.95, False)], "feature string, best_auc double, significant boolean")
    selected = [("stable", "logreg_l1", 0.4, 0.1), ("stable", "logreg_l1", 0.6, 0.8), ("signs", "logreg_l1", 0.9, 0.2), ("never", "linear_svm", 1.0, 1.0), ("weak", "logreg_l1", 0.1, 1.0)]
    stability = spark.createDataFrame(selected, "feature string, model_name string, selection_frequency double, sign_consistency double")
    out = {r["feature"]: r for r in evidence.feature_tiers(evidence.tier_features(features, tests, stability)).collect()}
    assert {f: r["tier"] for f, r in out.items()} == {"stable": "Tier 1", "never": "Tier 2", "signs": "Tier 2", "weak": "Tier 3"}
    assert out["never"]["max_frequency"] == 0 and out["stable"]["n_significant"] == 1


def test_tiering_joins_stability_and_clusters(spark, monkeypatch):
    from matrica.plans import analytics, model

    names = ["a", "b", "c"]
    filtered = [(f, m, 1.0, True, cv, 0.5, 1.0, False, False, f != "c") for f, m, cv in (("a", 100.0, 20.0), ("b", 110.0, 10.0), ("c", 120.0, 5.0))]
    schema = "feature string, mz double, rt double, high_confidence boolean, qc_cv double, d_ratio_log double, bio_detection_rate_max double, blank_veto boolean, carryover_flag boolean, retained_main boolean"
    monkeypatch.setattr(analytics, "_filtered", lambda s, d: s.createDataFrame(filtered, schema))
    monkeypatch.setattr(analytics, "_evidence", lambda s, d: s.createDataFrame([(f, 0.99, True) for f in names], "feature string, best_auc double, significant boolean"))
    monkeypatch.setattr(analytics, "selection_stability", lambda s, d: s.createDataFrame([("b", "logreg_l1", 0.3, 1.0)], "feature string, model_name string, selection_frequency double, sign_consistency double"))
    monkeypatch.setattr(model, "observations", lambda s, d: s.createDataFrame([(i, f, "x", float(i * k % 7)) for i in range(6) for k, f in enumerate(names, 1)], "sample int, feature string, class string, intensity double"))
    out = {r["feature"]: (r["cluster"], r["tier"]) for r in analytics.tiering(spark, "").collect()}
    assert out == {"a": ("a", "Tier 3_supportive_family_member"), "b": ("a", "Tier 2"), "c": ("c", "Tier 3")}
