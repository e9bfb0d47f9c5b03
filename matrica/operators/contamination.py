"""Detection by class group, contamination, carry-over and exogenous standards."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import HOT_ROWS
from matrica.functions.robust import with_medians
from matrica.functions.stats import spearman
from matrica.operators.spikes import cut_pieces, neighbours_along
from matrica.session import cut_lineage

#: Standards that are broadcast as one list.
FEW_STANDARDS = 10_000


def detection_rates(obs: DataFrame, groups: dict[str, Sequence[str]], *, threshold: float = 0.0) -> DataFrame:
    """feature, class_group, detection_rate: over all samples, per class, and per overlapping group of classes.

    The groups are a bridge table class to group, so each observation is read once. A value that equals the
    threshold, or is missing, is not detected.
    """
    members = [(c, g) for g, classes in groups.items() for c in classes]
    bridge = F.create_map(*[x for c in {c for c, _ in members} for x in (F.lit(c), F.array(*[F.lit(g) for k, g in members if k == c]))]) if members else None
    named = F.array(F.lit("all"), F.col("class"))
    per_class = obs.groupBy("feature", "class").agg(F.count_if(F.col("intensity") > threshold).alias("hit"), F.count(F.lit(1)).alias("n"))
    in_groups = F.concat(named, F.coalesce(F.try_element_at(bridge, "class"), F.array().cast("array<string>"))) if members else named
    rows = per_class.select("feature", "hit", "n", F.explode(in_groups).alias("class_group")).where("class_group is not null")
    return rows.groupBy("feature", "class_group").agg((F.sum("hit") / F.sum("n")).alias("detection_rate"))


def detection_summary(rates: DataFrame, classes: Sequence[str]) -> DataFrame:
    """Per class: mean and median detection rate of the features, and the shares of at least 0.70 and 0.90."""
    rows = rates.where(F.col("class_group").isin(*classes))
    share = lambda limit: F.avg((F.col("detection_rate") >= limit).cast("int"))
    # One rate per feature and class: a group is as large as the list of features.
    return rows.groupBy(F.col("class_group").alias("class")).agg(F.avg("detection_rate").alias("mean_rate"), F.median("detection_rate").alias("median_rate"), share(0.7).alias("share_70"), share(0.9).alias("share_90"))


def contamination_metrics(obs: DataFrame, blank: Sequence[str], control: Sequence[str], biological: Sequence[str], *, ratio: float = 1.0, min_rate: float = 0.1, threshold: float = 0.0, hot_limit: int = HOT_ROWS) -> DataFrame:
    """Per feature: mean, median and detection rate in blanks, controls and biological samples, the ratios of blank
    means (plus 1) to the others and their logarithms, and whether blanks dominate."""
    x, aggs, middle = F.col("intensity"), [], {}
    for name, classes in (("blank", blank), ("qc", control), ("bio", biological)):
        own = F.when(F.col("class").isin(*classes), x)
        middle[f"{name}_median"] = own
        aggs += [F.avg(own).alias(f"{name}_mean"), F.avg((own > threshold).cast("int")).alias(f"{name}_detection_rate")]
    out = with_medians(obs.groupBy("feature").agg(*aggs), obs, ["feature"], middle, hot_limit=hot_limit)
    for other in ("qc", "bio"):
        out = out.withColumn(f"blank_to_{other}_ratio", (F.col("blank_mean") + 1) / (F.col(f"{other}_mean") + 1)).withColumn(f"log10_blank_to_{other}", F.log10(f"blank_to_{other}_ratio"))
    dominant = (F.col("blank_to_qc_ratio") >= ratio) & (F.col("blank_to_bio_ratio") >= ratio) & (F.col("blank_detection_rate") >= min_rate)
    return out.withColumn("blank_dominant", F.coalesce(dominant, F.lit(False)))


def blank_carryover(obs: DataFrame, blank: Sequence[str], *, hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """feature, carryover_rho, n_blank_contexts: Spearman of a blank's log intensity with the log total signal of the
    sample before it in the batch (by row, whatever the gap). Blanks without a predecessor are left out."""
    totals = obs.groupBy("sample", "batch", "run_order", "class").agg(F.sum("intensity").alias("total"))
    runs = totals.select("sample", "class", "total", F.col("batch").alias("series"), "run_order", F.struct("run_order", "sample").alias("pos"))
    runs = cut_pieces(runs, "run_order")
    before = neighbours_along(runs, F.col("total")).withColumn("previous", F.log1p("before.v")).where(F.col("class").isin(*blank) & F.col("previous").isNotNull())
    rows = obs.join(before.select("sample", "previous"), "sample").withColumn("x", F.log1p("intensity"))
    return spearman(rows, ["feature"], "x", "previous", "carryover_rho", hot_limit=hot_limit).withColumnRenamed("n", "n_blank_contexts")


def match_standards(features: DataFrame, standards: DataFrame, *, ppm: float = 5000.0, rt: float = 90.0, few: int = FEW_STANDARDS) -> DataFrame:
    """The nearest feature of every standard by |ppm| / tolerance + |rt difference| / tolerance, and whether it is
    within both tolerances; standards without mass or time have none, ties go to the smaller feature name.

    A short list of standards is broadcast, and features meet it once with a partial minimum per standard. A longer
    one is matched over cells of mass and time: within a radius of one tolerance first, then the standards without a
    feature that near over cells four times as wide, until few are left.
    """
    s = cut_lineage(standards.select(F.col("compound_id"), F.col("mz").alias("s_mz"), F.col("rt").alias("s_rt")).where("s_mz > 0 and s_rt is not null"))
    f = features.select("feature", "mz", "rt").where("mz is not null and rt is not null")

    def nearest(pairs: DataFrame) -> DataFrame:
        near = pairs.withColumn("ppm_error", (F.col("mz") - F.col("s_mz")) / F.col("s_mz") * 1e6).withColumn("rt_error", F.col("rt") - F.col("s_rt"))
        near = near.withColumn("score", F.abs("ppm_error") / ppm + F.abs("rt_error") / rt)
        return near.groupBy("compound_id").agg(F.min(F.struct("score", "feature", "ppm_error", "rt_error")).alias("b"))

    found, radius, n = [], 1.0, s.count()
    while n > few and ppm * radius < 5e5:
        wide = -math.log1p(-ppm * radius * 1e-6) * 1.000001  # a reach of ppm is at most this in the logarithm of mass
        cell = lambda m, t: (F.floor(F.log(m) / wide).cast("bigint"), F.floor(F.col(t) / (rt * radius * 1.000001)).cast("bigint"))  # noqa: B023, E731
        m, t = cell("s_mz", "s_rt")
        around = lambda c: F.explode(F.array(c - 1, c, c + 1))
        asked = s.withColumn("cm", around(m)).withColumn("ct", around(t))
        fm, ft = cell("mz", "rt")
        best = cut_lineage(nearest(f.where("mz > 0").withColumn("cm", fm).withColumn("ct", ft).join(asked, ["cm", "ct"])).where(F.col("b.score") <= radius))
        found.append(best)
        s = cut_lineage(s.join(best.select("compound_id"), "compound_id", "left_anti"))
        n, radius = s.count(), radius * 4
    while n > few:  # standards far from every feature: one list after the other
        part = cut_lineage(s.limit(few))
        found.append(cut_lineage(nearest(f.join(F.broadcast(part), F.lit(True)))))
        s = cut_lineage(s.join(part.select("compound_id"), "compound_id", "left_anti"))
        n = s.count()
    best = reduce(DataFrame.unionByName, [nearest(f.join(F.broadcast(s), F.lit(True))), *found])
    return best.select("compound_id", "b.feature", "b.score", "b.ppm_error", "b.rt_error", ((F.abs("b.ppm_error") <= ppm) & (F.abs("b.rt_error") <= rt)).alias("within_tolerance"))


def standard_readings(obs: DataFrame, matches: DataFrame) -> DataFrame:
    """The observations of matched features, with the compound and log10(x + 1)."""
    return obs.join(matches.select("compound_id", "feature"), "feature").withColumn("log10_intensity", F.log10(F.col("intensity") + 1))


def track_standards(obs: DataFrame, matches: DataFrame, *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """compound_id, feature, batch, class: count, mean, median and mean log10(x + 1) of the matched features."""
    rows, keys = cut_lineage(standard_readings(obs, matches)), ["compound_id", "feature", "batch", "class"]
    stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("intensity").alias("mean_intensity"), F.avg("log10_intensity").alias("mean_log10"))
    return with_medians(stats, rows, keys, {"median_intensity": F.col("intensity")}, hot_limit=hot_limit)
