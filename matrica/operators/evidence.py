"""Pairwise evidence per feature, its collapse by cluster, stability of selections, tiers and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matrica.functions.keys import HOT_ROWS
from matrica.functions.robust import with_medians
from matrica.functions.stats import bh_adjust, erfc, mann_whitney


def task_table(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """task_name, positive_class, negative_class of pairwise tasks."""
    return spark.createDataFrame([(f"{p}_vs_{n}", p, n) for p, n in pairs], "task_name string, positive_class string, negative_class string")


def task_rows(obs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Observations of every task's two classes with task_name and positive; all tasks run in one plan."""
    sides = tasks.select("task_name", F.explode(F.array(F.struct(F.col("positive_class").alias("class"), F.lit(True).alias("positive")), F.struct(F.col("negative_class").alias("class"), F.lit(False).alias("positive")))).alias("s")).select("task_name", "s.*")
    return obs.join(F.broadcast(sides), "class")  # two rows per task


def univariate_evidence(obs: DataFrame, tasks: DataFrame, *, value: str = "intensity", raw: str | None = None, threshold: float = 0.0, hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """Per task and feature: sizes, medians and mean difference, raw medians and their log2 ratio, detection rates,
    Mann-Whitney U, p and q (Benjamini-Hochberg within the task) with its -log10, AUC, rank-biserial correlation and Cliff's
    delta, differences of medians and detection rates, direction and rank.

    Ties take average ranks; a side without values leaves the statistics NULL.
    """
    raw = raw or value
    rows = task_rows(obs, tasks)
    side = lambda c, s: F.when(F.col("positive") == s, F.col(c))
    stats = rows.groupBy("task_name", "feature").agg(
        (F.avg(side(value, True)) - F.avg(side(value, False))).alias("mean_difference"),
        F.avg((side(raw, True) > threshold).cast("int")).alias("pos_detection_rate"), F.avg((side(raw, False) > threshold).cast("int")).alias("neg_detection_rate"),
    )
    middle = {"pos_median": side(value, True), "neg_median": side(value, False), "pos_raw_median": side(raw, True), "neg_raw_median": side(raw, False)}
    stats = with_medians(stats, rows, ["task_name", "feature"], middle, hot_limit=hot_limit or HOT_ROWS)
    u = mann_whitney(rows, ["task_name", "feature"], value, "positive", hot_limit=hot_limit).withColumn("p_value", erfc(F.col("z") / F.sqrt(F.lit(2.0))))
    out = bh_adjust(stats.join(u, ["task_name", "feature"]), ["task_name"], "p_value")
    out = out.withColumn("log2_ratio", F.log2((F.col("pos_raw_median") + 1) / (F.col("neg_raw_median") + 1))).withColumn("best_auc", F.greatest("auc", 1 - F.col("auc")))
    out = out.withColumns({
        "median_difference": F.col("pos_median") - F.col("neg_median"), "detection_rate_difference": F.col("pos_detection_rate") - F.col("neg_detection_rate"),
        "rank_biserial": 2 * F.col("auc") - 1, "neg_log10_q": -F.log10(F.when(F.col("q_value").isNotNull(), F.greatest("q_value", F.lit(1e-300)))),
        "significant": F.coalesce(F.col("q_value") < 0.05, F.lit(False)),
    })
    classes = F.broadcast(tasks.select("task_name", "positive_class", "negative_class"))  # one row per task
    sign = F.when(F.col("median_difference") >= 0, " > ").otherwise(" < ")
    out = out.join(classes, "task_name").withColumn("direction", F.concat("positive_class", sign, "negative_class")).drop("positive_class", "negative_class")
    order = Window.partitionBy("task_name").orderBy(F.desc("significant"), F.col("q_value").asc_nulls_last(), F.col("best_auc").desc_nulls_last(), F.col("cliffs_delta").desc_nulls_last(), "feature")
    return out.withColumn("evidence_rank", F.row_number().over(order))


def first_per_cluster(evidence: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per cluster the first non-null value of each column in the given ascending order, so a row may be composite."""
    key = F.struct(*[F.col(c) for c in order])
    return evidence.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), key)).alias(c) for c in columns], F.count(F.lit(1)).alias("n_members"))


def cluster_evidence(evidence: DataFrame, members: DataFrame, *, task: str = "task_name") -> DataFrame:
    """One row per task and cluster: the representative's evidence, and the cluster's strongest feature.

    members: feature, cluster, is_representative. The strongest comes first by q, then AUC, Cliff's delta and name. A task
    without any representative takes all its features. Columns of the representatives' rows are filled each on its own
    with the first non-null value in that order. matches_best tells whether both are one feature; cluster_rank orders the
    task's clusters, of which there are fewer than features.
    """
    rows = evidence.join(members.select("feature", "cluster", F.coalesce("is_representative", F.lit(False)).alias("is_representative")), "feature")
    last = F.lit(float("inf"))
    rows = rows.withColumns({"__q": F.coalesce("q_value", last), "__a": -F.coalesce("best_auc", -last), "__c": -F.coalesce("cliffs_delta", -last)})
    order = ["__q", "__a", "__c", "feature"]
    best = first_per_cluster(rows, [task, "cluster"], order, ["feature", "q_value", "best_auc", "cliffs_delta", "direction"])
    best = best.select(task, "cluster", *[F.col(c).alias(f"best_{c}_in_cluster") for c in ("feature", "q_value", "best_auc", "cliffs_delta", "direction")], "n_members")
    any_one = rows.groupBy(task).agg(F.bool_or("is_representative").alias("__any"))
    chosen = rows.join(any_one, task).where("is_representative or not __any")
    own = [c for c in evidence.columns if c not in (task, "evidence_rank")]
    out = first_per_cluster(chosen, [task, "cluster"], order, own).drop("n_members").join(best, [task, "cluster"])
    rank = Window.partitionBy(task).orderBy(F.col("q_value").asc_nulls_last(), F.col("best_q_value_in_cluster").asc_nulls_last(), F.col("best_auc").desc_nulls_last(), "cluster")
    return out.withColumn("matches_best", F.col("feature") == F.col("best_feature_in_cluster")).withColumn("cluster_rank", F.row_number().over(rank))


def selection_stability(coefficients: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per task, space, model and feature: in how many of the folds a feature was selected, its mean coefficients, the share
    of positive ones and the sign consistency. coefficients and metrics are those of models.cross_validate."""
    keys = ["task_name", "feature_space", "model_name"]
    folds = metrics.groupBy(*keys).agg(F.count_distinct("repeat", "fold").alias("n_folds"))
    positive = F.avg((F.col("coefficient") > 0).cast("int"))
    out = coefficients.groupBy(*keys, "feature").agg(
        F.count(F.lit(1)).alias("n_selected"), F.avg("coefficient").alias("mean_coefficient"), F.avg(F.abs("coefficient")).alias("mean_abs_coefficient"), positive.alias("positive_fraction")
    )
    out = out.join(folds, keys).withColumn("selection_frequency", F.col("n_selected") / F.col("n_folds"))
    return out.withColumn("sign_consistency", F.abs(2 * F.col("positive_fraction") - 1))


def tier_features(features: DataFrame, evidence: DataFrame, stability: DataFrame, *, model: str = "logreg_l1") -> DataFrame:
    """Add best_auc, n_significant (tasks with a significant q), max_frequency and max_sign of ``model`` to features.

    The last two are the largest selection frequency and sign consistency over tasks; 0 for a feature never selected.
    """
    tests = evidence.groupBy("feature").agg(F.max("best_auc").alias("best_auc"), F.count_if("significant").alias("n_significant"))
    stable = stability.where(F.col("model_name") == model).groupBy("feature").agg(F.max("selection_frequency").alias("max_frequency"), F.max("sign_consistency").alias("max_sign"))
    out = features.join(tests, "feature", "left").join(stable, "feature", "left")
    return out.na.fill(0, ["n_significant"]).na.fill(0.0, ["max_frequency", "max_sign"])


def feature_tiers(features: DataFrame, *, first_auc: float = 0.90, second_auc: float = 0.85) -> DataFrame:
    """Add tier to features with is_representative, high_confidence, warning, n_significant, best_auc, max_frequency
    and max_sign, and cluster; a member of a cluster with a tier 1 or 2 representative supports it."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    clean = F.col("is_representative") & ~F.col("warning")
    one = clean & F.col("high_confidence") & (F.col("n_significant") >= 1) & (F.col("best_auc") >= first_auc) & (F.col("max_frequency") >= 0.50) & (F.col("max_sign") >= 0.70)
    two = clean & (F.col("best_auc") >= second_auc) & ((F.col("n_significant") >= 1) | yes(F.col("max_frequency") >= 0.25))
    out = features.withColumn("__tier", F.when(yes(one), 1).when(yes(two), 2).otherwise(3))
    strong = out.where("__tier < 3").select("cluster").distinct().withColumn("__strong", F.lit(True))
    out = out.join(strong, "cluster", "left")
    name = F.when(F.col("__tier") == 1, "Tier 1").when(F.col("__tier") == 2, "Tier 2").when(~F.col("is_representative") & F.col("__strong"), "Tier 3_supportive_family_member").otherwise("Tier 3")
    return out.withColumn("tier", name).drop("__tier", "__strong")


def evidence_pivot(evidence: DataFrame, tasks: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per feature with <column>__<task> for each task."""
    own = lambda c, t: F.max(F.when(F.col("task_name") == t, F.col(c))).alias(f"{c}__{t}")
    return evidence.groupBy("feature").agg(*[own(c, t) for t in tasks for c in columns])


def class_profile(medians: DataFrame, evidence: DataFrame, classes: Sequence[str], *, margin: float = 0.05) -> DataFrame:
    """Per feature the class medians, the number of strong tasks and the profile they make: which class leads (or trails)
    the others by the margin, or none.

    strong: q <= 0.05, best AUC >= 0.85 and an absolute log2 ratio of at least 0.10.
    """
    wide = medians.groupBy("feature").agg(*[F.max(F.when(F.col("class") == c, F.col("median"))).alias(f"median_{c}") for c in classes])
    strong = (F.col("q_value") <= 0.05) & (F.col("best_auc") >= 0.85) & (F.abs("log2_ratio") >= 0.10)
    out = wide.join(evidence.groupBy("feature").agg(F.count_if(strong).alias("n_strong_tasks")), "feature", "left").na.fill(0, ["n_strong_tasks"])
    ordered = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"median_{c}").isNotNull(), F.struct(F.col(f"median_{c}").alias("m"), F.lit(c).alias("c"))) for c in classes])))
    out = out.withColumn("__o", ordered)
    n = F.size("__o")
    top, below, low, above = F.get("__o", n - 1), F.get("__o", n - 2), F.get("__o", F.lit(0)), F.get("__o", F.lit(1))
    profile = F.when((F.col("n_strong_tasks") == 0) | (n < 2), "no_clear_profile").when(top["m"] - below["m"] >= margin, F.concat(top["c"], F.lit("_high"))).when(above["m"] - low["m"] >= margin, F.concat(low["c"], F.lit("_low"))).otherwise("mixed")
    return out.withColumn("profile", profile).drop("__o")


def decision_table(features: DataFrame, pivoted: DataFrame, profiles: DataFrame) -> DataFrame:
    """Tier 1 and 2 representatives with their evidence and profile, and priority_rank (tier, AUC, significance, name).

    The rank is a window over the candidates, a short list by construction of the tiers.
    """
    kept = features.where(F.col("is_representative") & F.col("tier").isin("Tier 1", "Tier 2"))
    out = kept.join(pivoted, "feature", "left").join(profiles, "feature", "left")
    order = Window.orderBy("tier", F.col("best_auc").desc_nulls_last(), F.col("n_significant").desc_nulls_last(), "feature")
    return out.withColumn("priority_rank", F.row_number().over(order))
