"""Stability of features over control samples, sample correlations, drift and principal components."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import HOT_ROWS
from matrica.functions.linear import pairwise_correlations, singular_vectors
from matrica.functions.robust import medians, robust_z, with_median_mad, with_medians
from matrica.functions.stats import average_rank, spearman
from matrica.operators.matrix import key_values
from matrica.session import cut_lineage


def percent_cv(sd: Column, mean: Column) -> Column:
    """100 sd / mean where the mean is positive."""
    return 100 * sd / F.when(mean > 0, mean)


def qc_feature_metrics(obs: DataFrame, classes: Sequence[str], *, threshold: float = 0.0, prefix: str = "qc", hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """Per feature over the samples of the control classes: n, detection rate, mean, median, sd, CV% and the Spearman
    drift of the log intensity along the run order. All values count, zeros too."""
    rows = obs.where(F.col("class").isin(*classes))
    x = F.col("intensity")
    stats = rows.groupBy("feature").agg(
        F.count(x).alias(f"{prefix}_n"), F.avg((x > threshold).cast("double")).alias(f"{prefix}_detection_rate"), F.avg(x).alias(f"{prefix}_mean"),
        F.stddev_samp(x).alias(f"{prefix}_sd"),
    )
    stats = stats.withColumn(f"{prefix}_cv", percent_cv(F.col(f"{prefix}_sd"), F.col(f"{prefix}_mean")))
    stats = with_medians(stats, rows, ["feature"], {f"{prefix}_median": x}, hot_limit=hot_limit or HOT_ROWS)
    drift = spearman(rows.withColumn("__log", F.log1p("intensity")), ["feature"], "__log", "run_order", f"{prefix}_drift", hot_limit=hot_limit).drop("n")
    return stats.join(drift, "feature", "left")


def qc_batch_cv(obs: DataFrame, classes: Sequence[str]) -> DataFrame:
    """feature, batch, mean and CV% over the control samples of each batch."""
    x = F.col("intensity")
    rows = obs.where(F.col("class").isin(*classes)).groupBy("feature", "batch").agg(F.avg(x).alias("batch_mean"), F.stddev_samp(x).alias("sd"))
    return rows.select("feature", "batch", "batch_mean", percent_cv(F.col("sd"), F.col("batch_mean")).alias("batch_cv"))


def summarise_qc(metrics: DataFrame, *, limit: float = 30.0, prefix: str = "qc") -> DataFrame:
    """One row: features, median and mean CV, number and share of CVs under the limit (an absent CV is not under it)."""
    under = F.coalesce(F.col(f"{prefix}_cv") < limit, F.lit(False))
    stats = metrics.agg(
        F.count(F.lit(1)).alias("n_features"), F.avg(f"{prefix}_cv").alias("mean_cv"), F.count_if(under).alias("n_stable"), F.avg(under.cast("int")).alias("share_stable")
    )
    return with_medians(stats, metrics, [], {"median_cv": F.col(f"{prefix}_cv"), "median_detection_rate": F.col(f"{prefix}_detection_rate")})


def compare_qc(obs: DataFrame, first: Sequence[str], second: Sequence[str], *, limit: float = 30.0, threshold: float = 0.0) -> DataFrame:
    """Metrics of two control sets side by side, with stability flags, the gap of CVs and the distance of absolute drifts.

    concentration_sensitive: stable in the first and not in the second. A feature that only one set has keeps NULLs
    for the other.
    """
    a, b = qc_feature_metrics(obs, first, threshold=threshold, prefix="qc"), qc_feature_metrics(obs, second, threshold=threshold, prefix="dqc")
    stable = lambda p: F.coalesce(F.col(f"{p}_cv") < limit, F.lit(False)).alias(f"{p}_stable")
    out = a.join(b, "feature", "full").select("*", stable("qc"), stable("dqc"))
    out = out.withColumn("cv_gap", F.col("dqc_cv") - F.col("qc_cv")).withColumn("drift_gap", F.abs(F.abs("dqc_drift") - F.abs("qc_drift")))
    return out.withColumn("concentration_sensitive", F.col("qc_stable") & ~F.col("dqc_stable"))


def compare_summary(compared: DataFrame, *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """metric and value: features, stable ones by either set, both and one, and median CVs and absolute drifts."""
    counts = {
        "n_features": F.count_distinct("feature"), "n_qc_stable": F.count_if("qc_stable"), "share_qc_stable": F.avg(F.col("qc_stable").cast("int")), "n_dqc_stable": F.count_if("dqc_stable"),
        "share_dqc_stable": F.avg(F.col("dqc_stable").cast("int")), "n_stable_in_both": F.count_if(F.col("qc_stable") & F.col("dqc_stable")), "n_concentration_sensitive": F.count_if("concentration_sensitive"),
    }
    middle = {f"median_{p}_cv": F.col(f"{p}_cv") for p in ("qc", "dqc")} | {f"median_abs_{p}_drift": F.abs(f"{p}_drift") for p in ("qc", "dqc")}
    medians_ = medians(compared, [], middle, hot_limit=hot_limit)
    return key_values(compared, counts).unionByName(medians_.unpivot([], list(middle), "metric", "value"))


def sample_correlations(obs: DataFrame, classes: Sequence[str], *, method: str = "spearman", by: Sequence[str] = (), hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """by, sample_a < sample_b, rho and n: correlations of log intensities of all pairs of samples of the classes, over the
    features that both have. The result has a row per pair, which is what is asked for; it comes from products of
    blocks of samples."""
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method}")
    by = list(by)
    rows = obs.where(F.col("class").isin(*classes) & F.col("intensity").isNotNull()).select(*by, "sample", "feature", F.log1p("intensity").alias("x"))
    if method == "spearman":  # a dense matrix: ranks over all features of a sample
        rows = average_rank(rows, [*by, "sample"], "x", "r", hot_limit=hot_limit).select(*by, "sample", "feature", F.col("r").alias("x"))
    out = pairwise_correlations(cut_lineage(rows), "feature", "sample", "x", by=by)
    return out.select(*by, F.col("a").alias("sample_a"), F.col("b").alias("sample_b"), "rho", "n")


def principal_components(obs: DataFrame, k: int = 2, *, log: bool = True, scale: bool = True) -> tuple[DataFrame, np.ndarray]:
    """(sample with PC1..PCk, explained variance ratios) of the samples by features matrix.

    Missing cells are 0. Columns are centred and, if asked, divided by their population standard deviation; constant ones are
    left out. The covariance is summed on Spark from the long form; k is at most the number of varying features.
    """
    value = F.coalesce(F.log1p("intensity") if log else F.col("intensity"), F.lit(0.0))
    cells = obs.select("sample", F.col("feature").alias("col"), value.alias("val")).where("col is not null")
    scores, values, total = singular_vectors(cut_lineage(cells.groupBy("sample", "col").agg(F.first("val").alias("val"))), "sample", k, centre=True, scale="sd" if scale else None)
    return scores.select("sample", *[F.col(f"y{i}").alias(f"PC{i + 1}") for i in range(len(values))]), values / total if total else values


def flag_pca_outliers(scores: DataFrame, *, limit: float = 3.5, hot_limit: int = HOT_ROWS) -> DataFrame:
    """Add the distance to the median point of the first two components, its robust z and a flag."""
    scores = cut_lineage(scores)
    centre = medians(scores, [], {"m1": F.col("PC1"), "m2": F.col("PC2")}, hot_limit=hot_limit)
    out = scores.crossJoin(F.broadcast(centre)).withColumn("pca_distance", F.hypot(F.col("PC1") - F.col("m1"), F.col("PC2") - F.col("m2"))).drop("m1", "m2")
    out = with_median_mad(cut_lineage(out), [], ["pca_distance"], hot_limit=hot_limit)
    out = out.withColumn("pca_robust_z", robust_z(F.col("pca_distance"), F.col("med_pca_distance"), F.col("mad_pca_distance"))).drop("med_pca_distance", "mad_pca_distance", "n_pca_distance")
    return out.withColumn("outlier_pca", F.coalesce(F.abs("pca_robust_z") > limit, F.lit(False)))


def pc1_order_rho(scores: DataFrame, samples: DataFrame, shares: Sequence[float] = (), *, hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """One row: absolute Spearman of the first component with the run order (NULL under three samples), the samples, and
    the first of the given variance shares."""
    rows = scores.join(samples.select("sample", "run_order"), "sample").withColumn("all", F.lit(1))
    return spearman(rows, ["all"], "PC1", "run_order", "rho", hot_limit=hot_limit).select(F.when(F.col("n") >= 3, F.abs("rho")).alias("abs_pc1_order_rho"), "n", F.lit(float(shares[0]) if len(shares) else None).cast("double").alias("pc1_variance"))
