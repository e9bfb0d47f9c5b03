"""Exact neighbours over several groups of rows and anchors, and what baselines need."""

import numpy as np
import pyarrow as pa

from matrica.operators import embeddings, knn


def test_groups_match_all_pairs_with_ties(spark, monkeypatch):
    monkeypatch.setattr(knn, "ANCHOR_BLOCKS", 1)
    monkeypatch.setattr(knn, "ROW_BLOCKS", 1)
    rng = np.random.default_rng(4)
    m = rng.integers(0, 3, size=(160, 4)).astype(float)  # many equal and zero vectors
    df = spark.createDataFrame([(i * 7 - 300, v.tolist()) for i, v in enumerate(m)], "vec_id bigint, embedding array<double>")
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    d = np.round(1 - unit @ unit.T, 12)
    np.fill_diagonal(d, np.inf)
    want = {(i * 7 - 300, r + 1): (int(j) * 7 - 300) for i in range(160) for r, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    found = knn.cosine_neighbours(df, df, 5, block=16)
    assert {(r["anchor"], r["neighbor_rank"]): r["neighbor"] for r in found.collect()} == want
    assert "CartesianProduct" not in (plan := found._jdf.queryExecution().toString()) and plan.count("hashpartitioning(cell") >= 1


def test_close_distances_are_told_apart_in_double_precision():
    v = [[1.0, 1e-4 * (1 + 1e-6 * i)] for i in range(50)]
    table = pa.table({"id": pa.array(range(50), pa.int64()), "v": pa.array(v)})
    got = knn._nearest(table, table.slice(0, 1), 3, 8).to_pydict()
    m = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.round(1 - m @ m[0], 12)
    d[0] = np.inf
    assert got["neighbor"] == np.argsort(d, kind="stable")[:3].tolist()


def test_baseline_evaluation_builds_no_suite(spark, monkeypatch):
    from matrica.plans import analytics

    monkeypatch.setattr(analytics, "_suite", None)
    monkeypatch.setattr(analytics, "_suite_rows", lambda s, d: "rows")
    monkeypatch.setattr(embeddings, "baseline_spaces", lambda rows, key: {"composition": spark.range(1).toDF("row_id")})
    monkeypatch.setattr(embeddings, "evaluate_baselines", lambda spaces, rows, key, anchors: spark.createDataFrame([(*spaces, rows)], "a string, b string"))
    assert tuple(analytics.baseline_evaluation(spark, "").first()) == ("composition", "rows")
