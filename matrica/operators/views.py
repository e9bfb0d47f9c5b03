"""Normalisation views of the matrix and their evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import HOT_ROWS
from matrica.functions.robust import medians, with_medians
from matrica.functions.stats import spearman
from matrica.operators.feature_qc import pc1_order_rho, percent_cv, principal_components, sample_correlations
from matrica.session import cut_lineage

VIEWS = ("raw", "log1p", "tic_log1p", "median_log1p")


def processing_view(obs: DataFrame, method: str, *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """obs with intensity replaced by the view; ValueError for an unknown one.

    tic_log1p: over the sample's sum, times the median of the positive sums; a sample without signal is 0.
    median_log1p: over the median of the sample's non-zero values, times the median of those medians; 0 where there
    is none. Both then log(1 + x).
    """
    if method == "raw":
        return obs
    if method == "log1p":
        return obs.withColumn("intensity", F.log1p("intensity"))
    if method == "tic_log1p":
        size = F.sum("intensity")
    elif method == "median_log1p":
        size = F.median(F.when(F.col("intensity") != 0, F.col("intensity")))
    else:
        raise ValueError(f"unknown view {method}")
    sizes = obs.groupBy("sample").agg(size.alias("__size"))
    sizes = sizes.withColumn("__size", F.when(F.col("__size") > 0, F.col("__size")))
    sizes = cut_lineage(sizes)
    centre = medians(sizes, [], {"__centre": F.col("__size")}, hot_limit=hot_limit)
    scaled = obs.join(sizes, "sample").join(F.broadcast(centre), F.lit(True), "left")  # one row
    value = F.coalesce(F.log1p(F.col("intensity") / F.col("__size") * F.col("__centre")), F.lit(0.0))
    return scaled.withColumn("intensity", value).drop("__size", "__centre")


def all_views(obs: DataFrame, methods: Sequence[str] = VIEWS) -> DataFrame:
    """All views as one long table with a column view."""
    return reduce(DataFrame.unionByName, [processing_view(obs, m).withColumn("view", F.lit(m)) for m in methods])


def evaluate_views(views: DataFrame, control: Sequence[str], biological: Sequence[str]) -> DataFrame:
    """Per view: median and least correlation of control samples, median and least correlation of biological samples
    with their class median, CV% of the control samples' total signal, and of their first principal component the
    absolute Spearman with the run order and the explained variance (NULL under three samples or two varying features)."""
    pairs = sample_correlations(views, control, by=["view"])
    pairs = cut_lineage(pairs)
    qc = with_medians(pairs.groupBy("view").agg(F.min("rho").alias("qc_min_rho")), pairs, ["view"], {"qc_median_rho": F.col("rho")})
    bio = views.where(F.col("class").isin(*biological))
    profile = medians(bio, ["view", "class", "feature"], {"m": F.col("intensity")})
    close = spearman(bio.join(profile, ["view", "class", "feature"]), ["view", "sample"], "intensity", "m")
    close = cut_lineage(close)
    bio_rho = with_medians(close.groupBy("view").agg(F.min("rho").alias("bio_min_rho")), close, ["view"], {"bio_median_rho": F.col("rho")})
    totals = views.where(F.col("class").isin(*control)).groupBy("view", "sample").agg(F.sum("intensity").alias("t"))
    signal = totals.groupBy("view").agg(percent_cv(F.stddev_samp("t"), F.avg("t")).alias("qc_signal_cv"))
    parts = []
    for name in [r["view"] for r in views.select("view").distinct().collect()]:  # a short list
        own = views.where((F.col("view") == name) & F.col("class").isin(*control))
        scores, shares = principal_components(own, 2, log=False)
        if len(shares) == 2:
            rho = pc1_order_rho(scores, own.select("sample", "run_order").distinct(), shares)
            parts.append(rho.where("n >= 3").select(F.lit(name).alias("view"), "abs_pc1_order_rho", "pc1_variance"))
    empty = views.select("view", F.lit(None).cast("double").alias("abs_pc1_order_rho"), F.lit(None).cast("double").alias("pc1_variance")).limit(0)
    return qc.join(bio_rho, "view").join(signal, "view").join(reduce(DataFrame.unionByName, parts, empty), "view", "left")
