"""Pairs of related features by range joins, their correlations, and redundancy clusters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrica.functions.keys import BROADCAST_ROWS, HOT_ROWS, join_skewed
from matrica.functions.linear import pairwise_correlations
from matrica.functions.stats import average_rank, pearson
from matrica.operators.rectangles import joined_roots, range_counts, range_groups
from matrica.session import cut_lineage, release

# Known mass shifts of isotopes and adducts.
MASS_SHIFTS = (("13C1", 1.003355), ("13C2", 2.006710), ("Na-H", 21.981943), ("K-H", 37.955882), ("O-like", 16.018724))


def range_pairs(rows: DataFrame, on: str, width: Column | float, keep: Sequence[str], group: Sequence[str] = (), *, widths: int = 1) -> DataFrame:
    """Candidate pairs (a_*, b_*) of rows whose ``on`` values lie within ``width``, each once, a's value not larger.

    The value range is cut into buckets of that width; a row meets its own bucket and the next one by an equi-join,
    so no cross join is planned. ``width`` must exceed the exact predicate's reach. Buckets of several ``widths``
    send fewer rows twice and form more candidates.
    """
    bucket = F.floor(F.col(on) / (width * widths)).cast("bigint")
    base = rows.where(F.col(on).isNotNull())
    following = bucket + 1 if widths == 1 else F.floor((F.col(on) + width) / (width * widths)).cast("bigint")
    a = base.select(*group, *[F.col(c).alias(f"a_{c}") for c in keep], F.explode(F.array_distinct(F.array(bucket, following))).alias("bucket"))
    b = base.select(*group, *[F.col(c).alias(f"b_{c}") for c in keep], bucket.alias("bucket"))
    later = (F.col(f"b_{on}") > F.col(f"a_{on}")) | ((F.col(f"b_{on}") == F.col(f"a_{on}")) & (F.col(f"b_{keep[0]}") > F.col(f"a_{keep[0]}")))
    return a.join(b, [*group, "bucket"]).where(later).drop("bucket")


def isomer_pairs(features: DataFrame, *, ppm: float = 20.0, min_rt: float = 0.10) -> DataFrame:
    """Feature pairs whose masses differ by at most ``ppm`` of their mean and whose retention times differ by at
    least ``min_rt``. Features without mass or time pair with none. Buckets are in log mass, where ppm is a constant width."""
    rows = features.where("mz > 0 and rt is not null").withColumn("log_mz", F.log("mz"))
    pairs = range_pairs(rows, "log_mz", ppm * 1.0001e-6, ["feature", "mz", "rt", "log_mz"])
    error = (F.col("b_mz") - F.col("a_mz")) / ((F.col("a_mz") + F.col("b_mz")) / 2) * 1e6
    pairs = pairs.withColumn("delta_ppm", error).withColumn("delta_rt", F.col("b_rt") - F.col("a_rt"))
    return pairs.where((F.abs("delta_ppm") <= ppm) & (F.abs("delta_rt") >= min_rt)).select(F.col("a_feature").alias("feature_a"), F.col("b_feature").alias("feature_b"), "delta_ppm", "delta_rt")


def adduct_pairs(features: DataFrame, *, rt: float = 0.15, tolerance: float = 0.10, shifts: Sequence[tuple[str, float]] = MASS_SHIFTS) -> DataFrame:
    """Feature pairs within ``rt`` whose mass difference is nearest to a known shift and within the tolerance.

    feature_a has the smaller mass; of equally near shifts the first listed wins.
    """
    pairs = range_pairs(features.where("mz is not null"), "rt", rt * 1.000001, ["feature", "mz", "rt"]).where(F.abs(F.col("b_rt") - F.col("a_rt")) <= rt)
    swap = F.col("a_mz") > F.col("b_mz")
    delta = F.abs(F.col("b_mz") - F.col("a_mz"))
    best = F.array_min(F.array(*[F.struct(F.abs(delta - s).alias("error"), F.lit(i).alias("i"), F.lit(n).alias("shift")) for i, (n, s) in enumerate(shifts)]))
    pairs = pairs.withColumn("best", best).where(F.col("best.error") <= tolerance)
    return pairs.select(
        F.when(swap, F.col("b_feature")).otherwise(F.col("a_feature")).alias("feature_a"), F.when(swap, F.col("a_feature")).otherwise(F.col("b_feature")).alias("feature_b"),
        delta.alias("delta_mz"), F.col("best.shift").alias("shift"), F.col("best.error").alias("shift_error"),
    )


def pair_correlations(pairs: DataFrame, obs: DataFrame, subsets: dict[str, Sequence[str] | None], *, method: str = "spearman", hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """feature_a, feature_b, subset, n, rho: correlations of log intensities over subsets of samples (by class; None:
    all). NULL under three samples or where a side is constant."""
    member = F.array_compact(F.array(*[F.when(F.lit(True) if c is None else F.col("class").isin(*c), F.lit(n)) for n, c in subsets.items()]))
    rows = obs.where(F.col("intensity").isNotNull()).select("sample", "feature", F.log1p("intensity").alias("x"), F.explode(member).alias("subset"))
    if method == "spearman":
        rows = average_rank(rows, ["subset", "feature"], "x", "r", hot_limit=hot_limit).select("sample", "feature", "subset", F.col("r").alias("x"))
    a = rows.select(F.col("feature").alias("feature_a"), "subset", "sample", F.col("x").alias("xa"))
    b = rows.select(F.col("feature").alias("feature_b"), "subset", "sample", F.col("x").alias("xb"))
    joined = pairs.select("feature_a", "feature_b").join(a, "feature_a").join(b, ["feature_b", "subset", "sample"])
    out = joined.groupBy("feature_a", "feature_b", "subset").agg(F.count(F.lit(1)).alias("n"), pearson(F.col("xa"), F.col("xb")).alias("rho"))
    return out.withColumn("rho", F.when(F.col("n") >= 3, F.col("rho")))


@dataclass(frozen=True)
class RedundancyRules:
    """Limits of the relations: masses and times within which they hold, and the correlations that report and join."""

    isomer_mz: float = 0.02
    isomer_rt: float = 5.0
    adduct_rt: float = 20.0
    adduct_least_mz: float = 0.5
    adduct_most_mz: float = 30.0
    duplicate_mz: float = 5.0
    duplicate_rt: float = 60.0
    report_rho: float = 0.95
    join_rho: float = 0.97


def relation_types(pairs: DataFrame, rules: RedundancyRules = RedundancyRules()) -> DataFrame:
    """Add the relation flags of pairs (delta_mz, delta_rt, rho) and relation_type by priority; drops unrelated pairs.

    A NULL difference or correlation meets no rule.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    mz, rt, rho = F.abs("delta_mz"), F.abs("delta_rt"), F.col("rho")
    out = pairs.withColumns({
        "is_isomer": yes((mz <= rules.isomer_mz) & (rt >= rules.isomer_rt)), "is_adduct": yes((rt <= rules.adduct_rt) & mz.between(rules.adduct_least_mz, rules.adduct_most_mz)),
        "is_near_duplicate": yes((rho >= rules.join_rho) & (mz <= rules.duplicate_mz) & (rt <= rules.duplicate_rt)), "is_correlated": yes(rho >= rules.report_rho),
    })
    isomer, adduct, correlated = F.col("is_isomer"), F.col("is_adduct"), F.col("is_correlated")
    kind = F.when(isomer & correlated, "candidate_isomer_correlated").when(isomer, "candidate_isomer").when(adduct & correlated, "candidate_isotope_or_adduct_correlated")
    kind = kind.when(adduct, "candidate_isotope_or_adduct").when(F.col("is_near_duplicate"), "high_corr_near_duplicate").when(correlated, "high_corr_other")
    return out.withColumn("relation_type", kind).where("relation_type is not null")


#: Width of a cell in mass and in time, in widths of the pairs: as often as not a row meets one cell more, not five.
CELL_WIDTHS = (2, 4)


def cell_pairs(rows: DataFrame, widths: tuple[float, float], keep: Sequence[str]) -> DataFrame:
    """Candidate pairs (a_*, b_*) of rows whose mz and rt lie within the two widths, each once, a's mass not larger.

    Both ranges are cut into cells of some of these widths; a row meets the cells that it reaches, towards larger masses and
    on both sides in time, by an equi-join: its own and at most one more in mass, and in time. ``keep`` starts with the name
    and holds mz.
    """
    at = lambda c, w, wide, *d: [F.floor((F.col(c) + F.lit(x * w * 1.000001)) / (wide * w)).cast("bigint") for x in d]
    mass, time = (("mz", widths[0], CELL_WIDTHS[0]), ("rt", widths[1], CELL_WIDTHS[1]))
    base = rows.where((F.abs("mz") < float("inf")) & (F.abs("rt") < float("inf")))  # an infinite or NaN value is within no width
    a = base.select(*[F.col(c).alias(f"a_{c}") for c in keep], F.explode(F.array_distinct(F.array(*at(*mass, 0, 1)))).alias("cell_m"), F.array_distinct(F.array(*at(*time, -1, 0, 1))).alias("t"))
    a = a.withColumn("cell_t", F.explode("t")).drop("t")
    b = base.select(*[F.col(c).alias(f"b_{c}") for c in keep], at(*mass, 0)[0].alias("cell_m"), at(*time, 0)[0].alias("cell_t"))
    later = (F.col("b_mz") > F.col("a_mz")) | ((F.col("b_mz") == F.col("a_mz")) & (F.col(f"b_{keep[0]}") > F.col(f"a_{keep[0]}")))
    return a.join(b, ["cell_m", "cell_t"]).where(later).drop("cell_m", "cell_t")


def redundancy_edges(features: DataFrame, obs: DataFrame | None = None, rules: RedundancyRules = RedundancyRules(), *, hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """feature_a, feature_b, delta_mz, delta_rt, rho and the relations of every related pair of features (feature, mz, rt).

    Candidates by mass and time come from each rule's own range by equi-joins over cells. With ``obs``, rho is the
    Spearman correlation of the features over their common samples (ranked within each feature; all pairs, as blocks
    of matrix products), and pairs with a high one are related whatever their mass; without, rho is NULL. feature_a
    has the smaller mass, then the smaller name; a feature without mass or time is related by rho alone.
    """
    rows, keep = features.select("feature", "mz", "rt"), ["feature", "mz", "rt"]
    delta = [(F.col(f"b_{c}") - F.col(f"a_{c}")).alias(f"delta_{c}") for c in ("mz", "rt")]
    ends = [F.col("a_feature").alias("feature_a"), F.col("b_feature").alias("feature_b"), *delta]
    timed = rows.where((F.abs("mz") < float("inf")) & F.col("rt").isNotNull())
    isomer = (F.col("b_mz") - F.col("a_mz") <= rules.isomer_mz) & (F.abs(F.col("b_rt") - F.col("a_rt")) >= rules.isomer_rt)
    isomers = range_pairs(timed, "mz", max(rules.isomer_mz, 1e-9) * 1.000001, keep, widths=4).where(isomer).select(*ends)
    adduct = (F.col("b_mz") - F.col("a_mz")).between(rules.adduct_least_mz, rules.adduct_most_mz) & (F.abs(F.col("b_rt") - F.col("a_rt")) <= rules.adduct_rt)
    adducts = cell_pairs(timed, (rules.adduct_most_mz, rules.adduct_rt), keep).where(adduct & ~isomer).select(*ends)
    related = isomers.unionByName(adducts)
    if obs is None:  # a pair has its differences from its two rows, so none is shuffled
        return relation_types(related.withColumn("rho", F.lit(None).cast("double")), rules)
    own = obs.join(rows.select("feature"), "feature", "left_semi").where(F.col("intensity").isNotNull())
    ranked = average_rank(own.select("sample", "feature", "intensity"), ["feature"], "intensity", "r", hot_limit=hot_limit)
    rho = cut_lineage(pairwise_correlations(ranked, "sample", "feature", "r").drop("n"))
    asked = related.select(F.least("feature_a", "feature_b").alias("a"), F.greatest("feature_a", "feature_b").alias("b")).unionByName(rho.where(F.col("rho") >= rules.report_rho).select("a", "b")).distinct()
    found = asked.join(rho, ["a", "b"], "left").select(F.col("a").alias("feature_a"), F.col("b").alias("feature_b"), "rho")
    return relation_types(_placed(found, rows), rules)


def _placed(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """Pairs with their differences, the feature with the smaller mass (then name) first."""
    side = lambda s: features.select(*[F.col(c).alias(f"{c}_{s}" if c == "feature" else f"__{c}_{s}") for c in ("feature", "mz", "rt")])
    out = pairs.join(side("a"), "feature_a").join(side("b"), "feature_b")
    first = lambda s: F.struct(F.coalesce(f"__mz_{s}", F.lit(float("inf"))), f"feature_{s}")
    turn = first("b") < first("a")
    rest = [c for c in pairs.columns if c not in ("feature_a", "feature_b")]
    delta = lambda c: F.when(turn, F.col(f"__{c}_a") - F.col(f"__{c}_b")).otherwise(F.col(f"__{c}_b") - F.col(f"__{c}_a")).alias(f"delta_{c}")
    a, b = F.col("feature_a"), F.col("feature_b")
    return out.select(F.when(turn, b).otherwise(a).alias("feature_a"), F.when(turn, a).otherwise(b).alias("feature_b"), delta("mz"), delta("rt"), *rest)


def annotate_redundancy(features: DataFrame, obs: DataFrame | None, order: Sequence[Column], rules: RedundancyRules = RedundancyRules()) -> tuple[DataFrame, DataFrame]:
    """(edges, features with cluster, size, representative, role and neighbour counts by relation).

    Clusters join what isomer, adduct and near-duplicate rules relate, not what correlates otherwise. Representatives
    come first by ``order``, then by name.
    """
    edges = cut_lineage(redundancy_edges(features, obs, rules))
    grouped = clusters(features, edges.where("is_isomer or is_adduct or is_near_duplicate")).join(features, "feature")
    out = pick_representatives(grouped, order).join(neighbour_counts(edges), "feature", "left")
    return edges, out.na.fill(0, [f"n_{k}" for k in RELATIONS])


def clusters(nodes: DataFrame, edges: DataFrame, *, node: str = "feature", a: str = "feature_a", b: str = "feature_b", hot_limit: int = HOT_ROWS) -> DataFrame:
    """node and cluster (the smallest node reachable) of every node, by spreading minima with pointer jumping.

    Every round a node takes the least label of its neighbours' labels, then the label of its label; rounds fall with
    the logarithm of the longest chain in practice. Labels go to the shared folder between rounds; vertices and labels
    with more than ``hot_limit`` rows are joined by broadcast.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = cut_lineage(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut_lineage(links.select(F.col("u").alias("n")).distinct().withColumn("label", F.col("n")))
    held, n = labels, links.count()
    while True:
        least = join_skewed(links, labels.withColumnRenamed("n", "v"), "v", limit=hot_limit, rows=n).groupBy(F.col("u").alias("n")).agg(F.min("label").alias("m"))
        near = cut_lineage(labels.join(least, "n").select("n", F.col("label").alias("old"), F.least("label", "m").alias("label")))
        jump = near.select(F.col("n").alias("label"), F.col("label").alias("far"))
        step = cut_lineage(join_skewed(near, jump, "label", "left", limit=hot_limit, rows=n).select("n", "old", F.coalesce("far", "label").alias("label")))
        release(near, held)
        labels, held = step.select("n", "label"), step
        if step.where("old <> label").isEmpty():
            break
    return nodes.select(node).distinct().join(labels.withColumnRenamed("n", node), node, "left").select(node, F.coalesce("label", node).alias("cluster"))


def range_clusters(features: DataFrame, rules: RedundancyRules = RedundancyRules(), *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """feature and cluster, as clusters() over the edges that features (feature, mz, rt) have without intensities.

    Tasks find the components of slabs of mass; only those of them that share a feature are joined here: by one task up
    to ``hot_limit`` links, else in rounds.
    """
    named = features.where("feature is not null")
    alone = named.select("feature", F.lit(None).cast(dict(features.dtypes)["feature"]).alias("root"))
    groups = cut_lineage(range_groups(named, rules).unionByName(alone).groupBy("feature").agg(F.collect_set("root").alias("roots")))  # two roots a row of features
    first = F.array_min("roots")
    met = cut_lineage(groups.select(first.alias("a"), F.explode("roots").alias("b")).where("a <> b").distinct())
    few = met.count() <= hot_limit
    joined = F.broadcast(joined_roots(met)) if few else clusters(met.select(F.explode(F.array("a", "b")).alias("root")), met, node="root", a="a", b="b", hot_limit=hot_limit)
    return groups.select("feature", first.alias("root")).join(joined, "root", "left").select("feature", F.coalesce("cluster", "root", "feature").alias("cluster"))


def pick_representatives(members: DataFrame, order: Sequence[Column], *, node: str = "feature", cluster: str = "cluster") -> DataFrame:
    """Add cluster_size, representative_feature and role (singleton, representative, member).

    The representative comes first by ``order`` (columns or structs that ascend), then by name; a partial minimum per
    cluster finds it. Few clusters are broadcast, so that a large one is not gathered in one task.
    """
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    members = cut_lineage(members)
    per = members.groupBy(cluster).agg(F.min(F.struct(*keys, F.col(node).alias("n"))).alias("best"), F.count(F.lit(1)).alias("cluster_size"))
    per = cut_lineage(per.select(cluster, "cluster_size", F.col("best.n").alias("representative_feature")))
    out = members.join(F.broadcast(per) if per.count() <= BROADCAST_ROWS else per, cluster)
    role = F.when(F.col("cluster_size") == 1, "singleton").when(F.col(node) == F.col("representative_feature"), "representative").otherwise("member")
    return out.withColumn("redundancy_role", role)


#: Relations that neighbours are counted by.
RELATIONS = ("isomer", "adduct", "near_duplicate", "correlated")


def range_neighbours(features: DataFrame, rules: RedundancyRules = RedundancyRules()) -> DataFrame:
    """neighbour_counts of the edges that features (feature, mz, rt) have without intensities, but no pair is formed."""
    counts = range_counts(features, rules)
    return counts.select("feature", *[F.col(f"n_{k}") if f"n_{k}" in counts.columns else F.lit(0).cast("bigint").alias(f"n_{k}") for k in RELATIONS])


def neighbour_counts(edges: DataFrame) -> DataFrame:
    """feature and its number of neighbours by each relation (n_isomer, ...); a pair may have several."""
    flags = [f"is_{k}" for k in RELATIONS]
    ends = edges.select(F.col("feature_a").alias("feature"), *flags).unionByName(edges.select(F.col("feature_b").alias("feature"), *flags))
    return ends.groupBy("feature").agg(*[F.count_if(f"is_{k}").alias(f"n_{k}") for k in RELATIONS])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column], into: str = "rank") -> DataFrame:
    """Add row numbers within ``by``; for top lists per key, not for whole tables."""
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
