"""Fits of the small linear models, and spaces that share them."""

import numpy as np
import pytest

from matrica.operators import models


@pytest.mark.parametrize("model", models.MODELS)
@pytest.mark.parametrize("seed", [1, 2])
def test_fits_end_at_the_optimum(model, seed):
    """No descent is left at the weights, however alike the features are."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(800, 12)) + 4 * rng.normal(size=(800, 1))
    x = (x - x.mean(0)) / x.std(0)
    y = (x[:, 0] - x[:, 1] + 0.5 * rng.normal(size=800) > 0.2).astype(float)
    own, bias = models._fit(x, y, model)
    w = np.r_[own, bias]
    weight, sign = np.where(y > 0, 400 / y.sum(), 400 / (800 - y.sum())), np.where(y > 0, 1.0, -1.0)
    a = np.c_[x, np.ones(800)] * sign[:, None]
    if model == "logreg_l1":
        g = -a.T @ (weight / (1 + np.exp(a @ w)))
        assert np.abs(np.where(w != 0, g + np.sign(w), np.maximum(np.abs(g) - 1, 0))).max() < 1e-5
    else:
        assert np.abs(w - 2 * a.T @ (weight * np.maximum(0, 1 - a @ w))).max() < 1e-5


def test_separable_and_constant_values():
    y = np.r_[np.zeros(10), np.ones(10)]
    for x in (np.c_[y * 2 - 1, np.zeros(20)], np.zeros((20, 2))):
        for model in models.MODELS:
            w, bias = models._fit(x, y, model)
            assert np.isfinite(w).all() and np.isfinite(bias) and w[1] == 0 and (w[0] > 0) == x.any()


def test_equal_spaces_are_fitted_once(spark, monkeypatch):
    asked, fit = [], models.cross_validate
    monkeypatch.setattr(models, "cross_validate", lambda *a, **k: asked.append(a[2]) or fit(*a, **k))
    rows = [("t", s, s % 2 == 0, f, float((s * (3 + i)) % 7)) for s in range(20) for i, f in enumerate("abc")]
    cells = spark.createDataFrame(rows, "task_name string, sample int, positive boolean, feature string, intensity double")
    folds = models.fold_table(cells.select("task_name", "sample", "positive").distinct(), repeats=1, folds=2)
    found = models.benchmark_spaces(cells, folds, {"main": ["a", "b", "c"], "high": ["a", "b"], "same": ["a", "b", "c"], "none": []}, models=("linear_svm",))
    assert [len(x) for x in asked] == [3, 2]
    for df in found:
        by = {}
        for r in df.collect():
            by.setdefault(r["feature_space"], set()).add(str({c: r[c] for c in df.columns if c != "feature_space"}))
        assert set(by) == {"main", "high", "same"} and by["main"] == by["same"] != by["high"]


def test_metrics_and_coefficients_read_the_same_fits(spark):
    """What follows from both, as the tiers do, fits no fold twice."""
    cells = spark.createDataFrame([("t", s, s % 2 == 0, f, float(s * 3 % 7)) for s in range(12) for f in "ab"], "task_name string, sample int, positive boolean, feature string, intensity double")
    folds = models.fold_table(cells.select("task_name", "sample", "positive").distinct(), repeats=1, folds=2)
    for df in models.cross_validate(cells, folds, ["a", "b"], space="main"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapGroups" not in plan and df.count() > 0
