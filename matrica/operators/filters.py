"""Technical against biological variation, feature filters, acceptance counts and ablations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import HOT_ROWS
from matrica.functions.robust import with_medians
from matrica.operators.feature_qc import percent_cv
from matrica.operators.matrix import key_values


def row_median(columns: Sequence[Column]) -> Column:
    """Median of several columns of a row, nulls left out; NULL if all are."""
    have = F.array_sort(F.array_compact(F.array(*columns)))
    n = F.size(have)
    low, high = F.get(have, F.floor((n - 1) / 2).cast("int")), F.get(have, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def detected_only_stats(obs: DataFrame, by: Sequence[str], *, threshold: float = 0.0, hot_limit: int = HOT_ROWS) -> DataFrame:
    """Statistics over the values above the threshold: count, rate over all, mean, median, CV%, sd of the logarithm.

    Nothing detected gives NULLs; one detected value gives its mean and median and no spread.
    """
    x = F.when(F.col("intensity") > threshold, F.col("intensity"))
    out = obs.groupBy(*by).agg(
        F.count(x).alias("n_detected"), (F.count(x) / F.count(F.lit(1))).alias("detection_rate"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"), F.stddev_samp(F.log1p(x)).alias("log_sd"),
    )
    out = with_medians(out, obs, list(by), {"median": x}, hot_limit=hot_limit)
    return out.withColumn("cv", percent_cv(F.col("sd"), F.col("mean"))).drop("sd")


def technical_biological(obs: DataFrame, control: Sequence[str], biological: Sequence[str], *, threshold: float = 0.0, detected_only: bool = False) -> DataFrame:
    """Per feature the CV% and log sd of the controls (pooled) and of every biological class, their medians and
    extremes over the classes, and d-ratios (control over biological median, where that is positive).

    detected_only: statistics over detected values; else over all values, with the detection rate above the threshold.
    """
    x = F.col("intensity")
    x = F.when(x > threshold, x) if detected_only else x
    aggs = []
    for name, classes in (("qc", control), *((c, [c]) for c in biological)):
        inside = F.col("class").isin(*classes)
        own = F.when(inside, x)
        aggs += [
            F.avg(own).alias(f"{name}_mean"), F.stddev_samp(own).alias(f"__{name}_sd"), F.stddev_samp(F.log1p(own)).alias(f"{name}_log_sd"),
            F.avg(F.when(inside, (F.col("intensity") > threshold).cast("int"))).alias(f"{name}_detection_rate"),
        ]
    out = obs.groupBy("feature").agg(*aggs)
    for name in ("qc", *biological):
        out = out.withColumn(f"{name}_cv", percent_cv(F.col(f"__{name}_sd"), F.col(f"{name}_mean"))).drop(f"__{name}_sd")
    each = lambda what: [F.col(f"{c}_{what}") for c in biological]
    some = lambda f, cols: f(*cols) if len(cols) > 1 else cols[0]
    out = out.withColumn("bio_cv_median", row_median(each("cv"))).withColumn("bio_log_sd_median", row_median(each("log_sd")))
    out = out.withColumn("bio_detection_rate_min", some(F.least, each("detection_rate"))).withColumn("bio_detection_rate_max", some(F.greatest, each("detection_rate")))
    ratio = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return out.withColumn("d_ratio_cv", ratio("qc_cv", "bio_cv_median")).withColumn("d_ratio_log", ratio("qc_log_sd", "bio_log_sd_median"))


def feature_filter(metrics: DataFrame, *, min_mz: float = 500.0, max_cv: float = 30.0, min_rate: float = 0.70, veto_rate: float = 0.5, veto_ratio: float = 0.5, carry_rho: float = 0.70, carry_n: int = 5, max_d_ratio: float = 1.0) -> DataFrame:
    """Add pass flags, retained_main, high_confidence and exclusion_reason to a table with mz, qc_cv, detection rates,
    blank metrics and carry-over of each feature. A NULL metric passes nothing and vetoes nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "pass_mz": yes(F.col("mz") > min_mz), "pass_qc_cv": yes(F.col("qc_cv") < max_cv),
        "pass_detection_any": yes(F.col("bio_detection_rate_max") >= min_rate), "pass_detection_all": yes(F.col("bio_detection_rate_min") >= min_rate),
        "blank_veto": yes((F.col("blank_detection_rate") >= veto_rate) & (yes(F.col("blank_to_qc_ratio") >= veto_ratio) | yes(F.col("blank_to_bio_ratio") >= veto_ratio) | yes(F.col("blank_dominant")))),
        "carryover_flag": yes((F.col("carryover_rho") >= carry_rho) & (F.col("n_blank_contexts") >= carry_n)),
    }
    out = metrics.withColumns(flags)
    main = F.col("pass_mz") & F.col("pass_qc_cv") & F.col("pass_detection_any") & ~F.col("blank_veto")
    out = out.withColumn("retained_main", main).withColumn("high_confidence", F.col("retained_main") & yes(F.col("d_ratio_log") <= max_d_ratio))
    reasons = {"pass_mz": "low m/z", "pass_qc_cv": "unstable in controls", "pass_detection_any": "rarely detected"}
    text = F.concat_ws("; ", *[F.when(~F.col(c), t) for c, t in reasons.items()], F.when(F.col("blank_veto"), "present in blanks"))
    return out.withColumn("exclusion_reason", F.when(F.col("retained_main"), "retained").otherwise(text))


def filter_funnel(filtered: DataFrame) -> DataFrame:
    """metric and value: features left after each successive stage."""
    stages = [("pass_mz", F.col("pass_mz")), ("pass_qc_cv", F.col("pass_qc_cv")), ("pass_detection", F.col("pass_detection_any")), ("no_blank_veto", ~F.col("blank_veto")), ("high_confidence", F.col("high_confidence"))]
    counts, left = {"all": F.count(F.lit(1))}, F.lit(True)
    for name, stage in stages:
        left = left & stage
        counts[name] = F.count_if(left)
    return key_values(filtered, counts)


def threshold_counts(metrics: DataFrame, criteria: dict[str, tuple[Column, str, Sequence[float]]], base: Column | None = None) -> DataFrame:
    """criterion_type, threshold, n_features: features that meet each threshold of each criterion, in one scan.

    criteria: name to (metric, comparison '<', '<=' or '>=', thresholds); base: what every counted feature meets.
    """
    compare = {"<": Column.__lt__, "<=": Column.__le__, ">=": Column.__ge__}
    base = F.lit(True) if base is None else F.coalesce(base, F.lit(False))
    rows = [
        F.struct(F.lit(name).alias("criterion_type"), F.lit(float(t)).alias("threshold"), F.count_if(base & F.coalesce(compare[op](metric, F.lit(float(t))), F.lit(False))).alias("n_features"))
        for name, (metric, op, limits) in criteria.items() for t in limits
    ]
    return metrics.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def acceptance_flags(metrics: DataFrame, *, max_cv: float = 30.0, min_rate: float = 0.70, min_mz: float = 500.0) -> DataFrame:
    """Add pass_cv, pass_detection (in every class) and pass_mz; a NULL metric passes nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return metrics.withColumns({"pass_cv": yes(F.col("qc_cv") < max_cv), "pass_detection": yes(F.col("bio_detection_rate_min") >= min_rate), "pass_mz": yes(F.col("mz") > min_mz)})


def retained_matrix(obs: DataFrame, samples: DataFrame, features: DataFrame) -> DataFrame:
    """Observations of the retained samples and features."""
    keep = features.select("feature").distinct()
    return obs.join(samples.select("sample").distinct(), "sample", "left_semi").join(keep, "feature", "left_semi")


def retained_tables(transformed: DataFrame, review: DataFrame, filtered: DataFrame) -> dict[str, DataFrame]:
    """What later studies start from: manifests of samples and of main and high-confidence features, the transformed
    matrices over both, and a summary (artifact, n)."""
    samples = review.where(~F.col("recommend_exclude"))
    main, high = filtered.where("retained_main"), filtered.where("high_confidence")
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("artifact"), "n")
    summary = reduce(DataFrame.unionByName, [count("retained_samples", samples), count("retained_main_features", main), count("retained_high_confidence_features", high)])
    return {
        "sample_manifest": samples, "feature_manifest_main": main, "feature_manifest_high": high, "matrix_main": retained_matrix(transformed, samples, main),
        "matrix_high": retained_matrix(transformed, samples, high), "summary": summary,
    }


def decision_table(filtered: DataFrame, annotated: DataFrame) -> DataFrame:
    """Every filtered feature with its redundancy: cluster, size, role, neighbours and is_representative.

    annotated: the retained features of pairs.annotate_redundancy. Others stand alone: size 1, no neighbours, no
    representative, role 'not_modeled'.
    """
    counts = [c for c in annotated.columns if c.startswith("n_")]
    kept = annotated.select("feature", "cluster", "cluster_size", (F.col("redundancy_role") != "member").alias("is_representative"), "redundancy_role", *counts)
    out = filtered.join(kept, "feature", "left").na.fill(0, counts).na.fill(1, ["cluster_size"]).na.fill("not_modeled", ["redundancy_role"])
    return out.withColumn("is_representative", F.coalesce("is_representative", F.lit(False)))


def handoff_tables(review: DataFrame, decisions: DataFrame, settings: dict[str, object]) -> dict[str, DataFrame]:
    """Summaries that go with the retained tables: samples by class, features (metric, value), the given settings
    (setting, value) and caveats (caveat, n)."""
    spark, main = review.sparkSession, F.col("retained_main")
    grouped, carried, chosen = main & (F.col("cluster_size") > 1), main & F.coalesce("carryover_flag", F.lit(False)), main & F.col("is_representative")
    at_least = lambda *tiers: F.count_if(F.col("review_tier").isin(*tiers))
    excluded = F.coalesce("recommend_exclude", F.lit(False))
    samples = review.groupBy("class").agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(~excluded).alias("n_retained"), F.count_if(excluded).alias("n_excluded"),
        at_least("minor_review", "review", "strong_review").alias("n_minor_or_worse"), at_least("review", "strong_review").alias("n_review_or_worse"),
    )
    features = key_values(decisions, {
        "n_features": F.count_distinct("feature"), "n_main": F.count_if(main), "n_high_confidence": F.count_if("high_confidence"), "n_main_with_carryover": F.count_if(carried),
        "n_main_in_clusters": F.count_if(grouped), "n_main_representatives": F.count_if(chosen),
    })
    config = spark.createDataFrame([(k, str(v)) for k, v in settings.items()], "setting string, value string")
    one = review.agg(F.count_if(excluded).alias("n")).select(F.lit("excluded_samples").alias("caveat"), "n")
    two = decisions.agg(F.count_if(carried).alias("main_features_with_carryover"), F.count_if(grouped).alias("main_features_in_clusters"))
    caveats = one.unionByName(two.unpivot([], two.columns, "caveat", "n"))
    return {"samples": samples, "features": features, "settings": config, "caveats": caveats}


def handoff_counts(review: DataFrame) -> DataFrame:
    """Per class: samples retained, left out, and of each tier."""
    tiers = ("keep", "minor_review", "review", "strong_review")
    return review.groupBy("class").agg(
        F.count_if(~F.col("recommend_exclude")).alias("n_retained"), F.count_if("recommend_exclude").alias("n_excluded"), *[F.count_if(F.col("review_tier") == t).alias(f"n_{t}") for t in tiers]
    )


def any_of(columns: Sequence[str]) -> Column:
    """True where one of the boolean columns is."""
    return reduce(Column.__or__, [F.coalesce(F.col(c), F.lit(False)) for c in columns])


def without_warnings(features: DataFrame, columns: Sequence[str] = ("carryover_flag", "blank_veto")) -> DataFrame:
    """Features that none of the warning flags marks."""
    return features.where(~any_of(columns))
