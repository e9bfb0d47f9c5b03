"""Quality metrics of samples, robust outlier flags and review tiers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import HOT_ROWS, join_counted, join_null_safe
from matrica.functions.robust import medians, robust_z, robust_z_or_sd, with_median_mad, with_medians
from matrica.functions.stats import spearman
from matrica.operators.feature_qc import principal_components
from matrica.session import cut_lineage

#: Metrics that outlier flags look at.
OUTLIER_METRICS = ("log10_total_signal_plus1", "detected_features", "zero_fraction", "mean_feature_intensity_nonzero")


def sample_metrics(obs: DataFrame, by: Sequence[str] = ("sample",), threshold: float = 0.0) -> DataFrame:
    """Per sample: total signal, its logarithm, features above the threshold and their rate, the share at or below
    it, and the mean of the non-zero intensities. NULL intensities count as not detected."""
    x = F.coalesce("intensity", F.lit(0.0))
    n = F.count(F.lit(1))
    return obs.groupBy(*by).agg(
        F.sum(x).alias("total_signal"), F.log10(F.sum(x) + 1).alias("log10_total_signal_plus1"), F.count_if(x > threshold).alias("detected_features"),
        (F.count_if(x > threshold) / n).alias("detection_rate"), (F.count_if(x <= threshold) / n).alias("zero_fraction"),
        F.avg(F.when(x != 0, x)).alias("mean_feature_intensity_nonzero"),
    )


def class_profile_spearman(obs: DataFrame, *, hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """sample and spearman_corr_to_class_median: each sample against the median log profile of its class."""
    logged = obs.withColumn("x", F.log1p("intensity"))
    profile = medians(logged, ["class", "feature"], {"m": F.col("x")}, hot_limit=hot_limit or HOT_ROWS)
    return spearman(logged.join(profile, ["class", "feature"]), ["sample"], "x", "m", "spearman_corr_to_class_median", hot_limit=hot_limit).drop("n")


def flag_outliers(metrics: DataFrame, columns: Sequence[str] = OUTLIER_METRICS, *, limit: float = 3.5, by: Sequence[str] = (), hot_limit: int = HOT_ROWS) -> DataFrame:
    """Add <metric>_robust_z and outlier_<metric> per metric, and any_outlier_flag.

    z is 0.6745 (x - median) / MAD over all samples (or within ``by``); NULL where MAD is 0, which flags nothing.
    """
    out = with_median_mad(cut_lineage(metrics), by, columns, hot_limit=hot_limit)
    for c in columns:
        out = out.withColumn(f"{c}_robust_z", robust_z(F.col(c), F.col(f"med_{c}"), F.col(f"mad_{c}")))
        out = out.withColumn(f"outlier_{c}", F.coalesce(F.abs(f"{c}_robust_z") > limit, F.lit(False))).drop(f"med_{c}", f"mad_{c}", f"n_{c}")
    return out.withColumn("any_outlier_flag", reduce(Column.__or__, [F.col(f"outlier_{c}") for c in columns]))


def sample_summary(metrics: DataFrame, *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """Sample counts, medians and means per batch and class, with the mean correlation to the class profile where the metrics
    have one; null batches and classes are left out."""
    rows = metrics.where("batch is not null and class is not null")
    stats = rows.groupBy("batch", "class").agg(F.count(F.lit(1)).alias("n_samples"), F.avg("total_signal").alias("mean_total_signal"), F.avg("detected_features").alias("mean_detected_features"), *[F.avg(c).alias(f"mean_{c}") for c in ("spearman_corr_to_class_median",) if c in rows.columns])
    return with_medians(stats, rows, ["batch", "class"], {f"median_{c}": F.col(c) for c in ("total_signal", "detected_features", "zero_fraction")}, hot_limit=hot_limit)


def threshold_sensitivity(obs: DataFrame, thresholds: Sequence[float] = (0, 1, 10, 100, 1000), *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """class, batch, threshold and mean, median, min and max of the samples' detection rates, in one scan."""
    x = F.coalesce("intensity", F.lit(0.0))
    rates = obs.groupBy("sample", "class", "batch").agg(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), (F.count_if(x > t) / F.count(F.lit(1))).alias("rate")) for t in thresholds]).alias("r"))
    rows = rates.select("class", "batch", F.explode("r").alias("r")).select("class", "batch", "r.*")
    rows, keys = cut_lineage(rows), ["class", "batch", "threshold"]
    stats = rows.groupBy(*keys).agg(F.avg("rate").alias("mean_rate"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"))
    return with_medians(stats, rows, keys, {"median_rate": F.col("rate")}, hot_limit=hot_limit)


def centroid_distance(scores: DataFrame, components: Sequence[str], by: str = "class") -> DataFrame:
    """Add pca_distance_to_class_centroid: Euclidean distance to the class means of the components."""
    scores = cut_lineage(scores)
    centre = scores.groupBy(by).agg(*[F.avg(c).alias(f"__{c}") for c in components])
    squares = reduce(Column.__add__, [F.pow(F.col(c) - F.col(f"__{c}"), 2) for c in components], F.lit(0.0))
    return join_counted(scores, centre, [by]).withColumn("pca_distance_to_class_centroid", F.sqrt(squares)).drop(*[f"__{c}" for c in components])


def biological_review(raw: DataFrame, transformed: DataFrame, classes: Sequence[str], *, threshold: float = 10.0, z: float = 3.0, components: int = 5, hot_limit: int = HOT_ROWS) -> DataFrame:
    """Review of the biological samples: signal and detection on raw intensities, coherence with the class and place
    among the components on transformed ones. See review_samples for the flags; low coherence and a large distance
    are the decisive ones."""
    inside = lambda df: df.where(F.col("class").isin(*classes))
    own = cut_lineage(inside(transformed))
    n = own.select("sample").distinct().count()
    scores, values = principal_components(own, min(components, max(1, n - 1)), log=False)
    placed = centroid_distance(scores.join(own.select("sample", "class").distinct(), "sample"), [f"PC{i + 1}" for i in range(len(values))])
    profile = medians(own, ["class", "feature"], {"m": F.col("intensity")}, hot_limit=hot_limit)
    close = spearman(join_null_safe(own, profile, ["class", "feature"]), ["sample"], "intensity", "m", "corr_to_class_median", hot_limit=hot_limit).drop("n")
    rows = sample_metrics(inside(raw), ["sample", "class"], threshold).join(close, "sample").join(placed.select("sample", "pca_distance_to_class_centroid"), "sample")
    low, high = ["log10_total_signal_plus1", "detected_features", "corr_to_class_median"], ["zero_fraction", "pca_distance_to_class_centroid"]
    rows = rows.select("sample", "class", *[F.col(c).cast("double").alias(c) for c in (*low, *high)])
    return review_samples(rows, low=low, high=high, decisive=["corr_to_class_median", "pca_distance_to_class_centroid"], z=z, hot_limit=hot_limit)


def review_samples(metrics: DataFrame, *, low: Sequence[str], high: Sequence[str], decisive: Sequence[str], z: float = 3.0, by: str = "class", hot_limit: int = HOT_ROWS) -> DataFrame:
    """Within-class robust z of the given metrics, one-sided flags, their number, recommend_exclude and review_tier.

    z falls back to the standard deviation where MAD is 0, and to 0 without spread. recommend_exclude: three flags or
    more, one of them decisive. Tiers: strong_review, review (two flags), minor_review (one), keep.
    """
    columns, metrics = [*low, *high], cut_lineage(metrics)
    out = with_median_mad(metrics, [by], columns, hot_limit=hot_limit)
    out = join_counted(out, metrics.groupBy(by).agg(*[F.stddev_samp(c).alias(f"sd_{c}") for c in columns]), [by])
    for c in columns:
        z_score = robust_z_or_sd(F.col(c), F.col(f"med_{c}"), F.col(f"mad_{c}"), F.col(f"sd_{c}"))
        out = out.withColumn(f"{c}_robust_z_within_class", z_score).drop(*[f"{p}_{c}" for p in ("med", "mad", "n", "sd")])
        score = F.col(f"{c}_robust_z_within_class")
        out = out.withColumn(f"flag_{c}", F.coalesce(score < -z if c in low else score > z, F.lit(False)))
    flags = reduce(Column.__add__, [F.col(f"flag_{c}").cast("int") for c in (*low, *high)])
    out = out.withColumn("n_review_flags", flags)
    exclude = (F.col("n_review_flags") >= 3) & reduce(Column.__or__, [F.col(f"flag_{c}") for c in decisive])
    tier = F.when(exclude, "strong_review").when(F.col("n_review_flags") >= 2, "review").when(F.col("n_review_flags") == 1, "minor_review").otherwise("keep")
    return out.withColumn("recommend_exclude", exclude).withColumn("review_tier", tier)
