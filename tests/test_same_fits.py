"""Cross-validation of a task gives the same results wherever its fits are made."""

import numpy as np
import pytest

from matrica.operators import evidence, models


def results(spark, most):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(90, 6)), 1)
    y = x[:, 0] + x[:, 1] + rng.normal(size=90) > 0.4
    x[:, 3], x[:, 4], x[:, 5] = 0.1, x[:, 0] * 3 + 0.7, rng.integers(0, 2, 90)  # constant, in proportion, of ties
    x[60:] = x[:30]
    rows = [(t, s, bool(y[s]), f"f{j}", float(x[s, j])) for t, n in (("a", 90), ("b", 40)) for s in range(n) for j in range(6)]
    cells = spark.createDataFrame(rows + [("lone", s, True, "f0", float(s)) for s in range(8)], "task_name string, sample int, positive boolean, feature string, intensity double")
    folds = models.fold_table(cells.select("task_name", "sample", "positive").distinct(), repeats=2, folds=2)
    return models.cross_validate(cells, folds, [f"f{j}" for j in range(6)], space="s", k_best=3, most_samples=most)


def test_results_do_not_depend_on_the_size_limit(spark):
    """Task a (90 samples) beyond the limit, b and the one of a single class within it; then all within it, and none."""
    names = ("task_name", "model_name", "repeat", "fold")
    held = []
    for most in (1000, 50, 0):
        metrics, coefficients = results(spark, most)
        by = {tuple(r[c] for c in names): [r[c] for c in (*models._METRICS, "n_train", "n_test")] for r in metrics.collect()}
        weights = {(*(r[c] for c in names), r["feature"]): r["coefficient"] for r in coefficients.collect()}
        held.append((by, weights))
    assert len(held[0][0]) == 16
    for by, weights in held[1:]:
        assert by.keys() == held[0][0].keys() and weights.keys() == held[0][1].keys()
        assert all(by[k] == pytest.approx(held[0][0][k], abs=1e-9, nan_ok=True) for k in by)
        assert all(weights[k] == pytest.approx(held[0][1][k], abs=1e-7) for k in weights)


def test_a_feature_that_tells_the_classes_is_chosen(spark):
    """Its values do not vary within a class, so its F statistic is beyond all others."""
    rows = [("t", s, s % 2 == 0, f, v) for s in range(20) for f, v in (("a", float(s % 3)), ("b", float(s % 5)), ("whole", 0.1 + s % 2))]
    cells = spark.createDataFrame(rows, "task_name string, sample int, positive boolean, feature string, intensity double")
    folds = models.fold_table(cells.select("task_name", "sample", "positive").distinct(), repeats=1, folds=2)
    metrics, coefficients = models.cross_validate(cells, folds, ["a", "b", "whole"], space="s", k_best=2, models=("linear_svm",))
    assert {r["auroc"] for r in metrics.collect()} == {1.0}
    stable = {r["feature"]: r["selection_frequency"] for r in evidence.selection_stability(coefficients, metrics).collect()}
    assert stable["whole"] == 1.0


def test_stability_does_not_depend_on_the_size_limit(spark):
    held = []
    for most in (1000, 0):
        metrics, coefficients = results(spark, most)
        stable = evidence.selection_stability(coefficients, metrics).collect()
        held.append({(r["task_name"], r["model_name"], r["feature"]): [r[c] for c in ("selection_frequency", "sign_consistency", "mean_coefficient")] for r in stable})
    assert held[0] and held[0].keys() == held[1].keys()
    assert all(held[1][k] == pytest.approx(held[0][k], abs=1e-7, nan_ok=True) for k in held[0])
