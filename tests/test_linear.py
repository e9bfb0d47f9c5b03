"""Singular vectors against numpy, by cross products and by iteration."""

import numpy as np
import pytest

from matrica.functions.linear import singular_vectors


@pytest.mark.parametrize(("most", "centre", "scale"), [(4096, False, None), (4096, False, "max"), (4096, True, "sd"), (2, True, "sd")])
def test_scores_equal_numpy(spark, most, centre, scale):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 14)) * 3 + rng.normal(size=(30, 14)) * 0.1
    x[rng.random(x.shape) < 0.2] = 0
    x[:, 3] = 2.0 if centre else 0.0
    data = [(i, f"c{j}", float(x[i, j])) for i in range(30) for j in range(14) if x[i, j]]
    scores, values, total = singular_vectors(spark.createDataFrame(data, "id int, col string, val double"), "id", 2, centre=centre, scale=scale, most_columns=most)
    z = x - x.mean(0) if centre else x
    size = x.std(0) if scale == "sd" else np.abs(x).max(0) if scale == "max" else np.ones(14)
    z = z / np.where(size > 1e-12, size, 1)
    _, s, vt = np.linalg.svd(z)
    got = np.array([[r["y0"], r["y1"]] for r in scores.orderBy("id").collect()])
    want = z @ vt[:2].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4) and np.allclose(values, s[:2] ** 2, rtol=1e-6)
    assert np.isclose(total, (z**2).sum())


def test_nothing_varies(spark):
    flat = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0)], "id int, col string, val double")
    scores, values, _ = singular_vectors(flat, "id", 2, centre=True)
    assert scores.count() == 2 and not len(values)
    assert singular_vectors(flat.limit(0), "id", 2)[0].count() == 0
