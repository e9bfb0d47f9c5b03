"""Redundancy edges against the rules over all pairs."""

import math
import random

from matrica.operators import pairs


def relation(a, b, rho=None):
    mz, rt, high = abs(b[1] - a[1]), abs(b[2] - a[2]), rho is not None and rho >= 0.95
    if mz <= 0.02 and rt >= 5:
        return "candidate_isomer_correlated" if high else "candidate_isomer"
    if rt <= 20 and 0.5 <= mz <= 30:
        return "candidate_isotope_or_adduct_correlated" if high else "candidate_isotope_or_adduct"
    if rho is not None and rho >= 0.97 and mz <= 5 and rt <= 60:
        return "high_corr_near_duplicate"
    return "high_corr_other" if high else None


def test_edges_of_all_rules_without_intensities(spark):
    rng = random.Random(3)
    data = [(f"f{i:03d}", round(rng.choice([300, 900, 2000]) + rng.uniform(0, 60), 2), rng.uniform(0, 80)) for i in range(150)]
    data += [("g1", 500.0, 1.0), ("g2", 500.015, 9.0), ("g3", 530.0, 21.0), ("n", None, 1.0), ("t", 500.0, None)]
    got = {(r["feature_a"], r["feature_b"]): r["relation_type"] for r in pairs.redundancy_edges(spark.createDataFrame(data, "feature string, mz double, rt double")).collect()}
    full = sorted((r for r in data if None not in r), key=lambda r: (r[1], r[0]))
    want = {(a[0], b[0]): k for i, a in enumerate(full) for b in full[i + 1 :] if (k := relation(a, b))}
    assert got == want and {"candidate_isomer", "candidate_isotope_or_adduct"} == set(want.values())
    assert want["g1", "g2"] == "candidate_isomer" and want["g1", "g3"] == "candidate_isotope_or_adduct"  # 30 ppm apart; at both limits


def test_edges_from_correlations(spark):
    data = [("a", 100.0, 1.0), ("b", 103.0, 50.0), ("c", 900.0, 999.0), ("d", 901.0, 5.0)]
    level = {"a": lambda i: i, "b": lambda i: i * i, "c": lambda i: i + 7, "d": lambda i: i * 37 % 11}
    obs = [(i, f, "x", float(level[f](i + 1))) for i in range(10) for f in level]
    out = pairs.redundancy_edges(spark.createDataFrame(data, "feature string, mz double, rt double"), spark.createDataFrame(obs, "sample int, feature string, class string, intensity double")).collect()
    assert {(r["feature_a"], r["feature_b"]): r["relation_type"] for r in out} == {("a", "b"): "high_corr_near_duplicate", ("a", "c"): "high_corr_other", ("b", "c"): "high_corr_other"}
    assert all(math.isclose(r["rho"], 1.0) for r in out)


def test_all_six_types_in_order(spark):
    low = lambda a, b, rho: (*a, *b, rho)
    data = [low((0.01, 9.0), (0, 0), r) for r in (0.96, 0.1, None)] + [low((1.0, 9.0), (0, 0), r) for r in (0.96, 0.1)] + [low((3.0, 50.0), (0, 0), r) for r in (0.97, 0.96, -0.99)] + [low((99.0, 1.0), (0, 0), 0.95)]
    df = spark.createDataFrame([(i, x[0], x[1], x[4]) for i, x in enumerate(data)], "i int, delta_mz double, delta_rt double, rho double")
    got = {r["i"]: r["relation_type"] for r in pairs.relation_types(df).collect()}
    want = {i: relation((None, 0.0, 0.0), (None, x[0], x[1]), x[4]) for i, x in enumerate(data)}
    assert got == {i: k for i, k in want.items() if k} and len(set(got.values())) == 6


def test_correlations_in_blocks(spark):
    import numpy as np
    import pandas as pd
    from matrica.functions.linear import pairwise_correlations

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 9))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 1.0
    data = [("v", i, f"f{j}", float(x[i, j])) for i in range(40) for j in range(9) if not np.isnan(x[i, j])]
    want = pd.DataFrame(x).corr()
    got = pairwise_correlations(spark.createDataFrame(data, "view string, s int, f string, x double"), "s", "f", "x", by=["view"], block=3).collect()
    assert len(got) == 36
    for r in got:
        w = want.loc[int(r["a"][1]), int(r["b"][1])]
        assert (r["rho"] is None and np.isnan(w)) or math.isclose(r["rho"], w, abs_tol=1e-9)


def test_clusters_hold_adducts(spark, tmp_path):
    from matrica.plans import analytics

    data = [("a", 100.0, 1.0, 0.2, 0.1), ("b", 110.0, 2.0, 0.1, 0.1), ("c", 900.0, 2.0, 0.1, 0.1)]
    spark.createDataFrame(data, "feature string, mz double, rt double, mz_std double, rt_std double").write.parquet(f"{tmp_path}/feature_metadata.parquet")
    assert {r["feature"]: r["cluster"] for r in analytics.redundancy_clusters(spark, str(tmp_path)).collect()} == {"a": "a", "b": "a", "c": "c"}
