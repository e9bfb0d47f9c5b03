"""Tasks of many samples, and tables that the parts of a query share."""

from matrica.operators import models
from matrica.plans import analytics, model


def test_many_samples_of_few_features_need_no_fit_over_rows(spark, monkeypatch):
    """More samples than MOST_SAMPLES, but few values: every repeat in one group, not a Spark ML job for each fit."""
    monkeypatch.setattr(models, "MOST_SAMPLES", 10)
    monkeypatch.setattr(models, "_validate_large", None)
    data = [("t", i, i % 2 == 0, f, v) for i in range(40) for f, v in (("good", float(i % 2 == 0) * 4 + (i * 7 % 11) / 10), ("noise", float(i % 5)))]
    df = spark.createDataFrame(data, "task_name string, sample int, positive boolean, feature string, intensity double")
    folds = models.fold_table(df.select("task_name", "sample", "positive").distinct(), repeats=2)
    metrics, coefficients = models.cross_validate(df, folds, ["good", "noise"], space="s", k_best=2)
    got = metrics.collect()
    assert {(r["repeat"], r["fold"], r["model_name"]) for r in got} == {(r, f, m) for r in (1, 2) for f in range(5) for m in models.MODELS}
    assert all(r["auroc"] > 0.95 and (r["n_train"], r["n_test"]) == (32, 8) for r in got) and coefficients.count() == 2 * len(got)


def test_a_query_reads_the_observations_once(spark, monkeypatch):
    made = []
    table = model.shared(lambda s, d: made.append(d) or s.range(1).toDF("x"))
    query = model.sharing(lambda s, d: table(s, d).union(model.sharing(table)(s, d)))
    assert query(spark, "a").count() == 2 and made == ["a"]
    assert query(spark, "a").count() == 2 and made == ["a", "a"]  # the next query reads its tables anew
    assert table(spark, "a").count() == 1 and len(made) == 3
    assert analytics.QUERIES["tiering"].__wrapped__.__name__ == "tiering" and model.observations.__wrapped__.__name__ == "observations"
