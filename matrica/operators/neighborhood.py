"""What the neighbours of chosen rows are: terms, context, support, and a priority score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_terms(neighbours: DataFrame, terms: DataFrame, *, key: str, term: str = "term", n: int = 8) -> DataFrame:
    """anchor, term, n_neighbors, rank: the terms that most of an anchor's neighbours carry; ties in text order.

    terms: one row per (key, term). An anchor has at most k neighbours, so its window is small.
    """
    rows = neighbours.join(terms.select(F.col(key).alias("neighbor"), F.col(term).alias("term")).distinct(), "neighbor")
    counts = rows.groupBy("anchor", "term").agg(F.count(F.lit(1)).alias("n_neighbors"))
    order = Window.partitionBy("anchor").orderBy(F.desc("n_neighbors"), "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def render_terms(top: DataFrame) -> DataFrame:
    """anchor and its terms as text ``term (count) | ...``."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term", "n_neighbors"))), lambda t: F.format_string("%s (%d)", t["term"], t["n_neighbors"]))
    return top.groupBy("anchor").agg(F.array_join(listed, " | ").alias("terms"))


def neighbourhood_summary(neighbours: DataFrame, flags: DataFrame, *, key: str, columns: Sequence[str]) -> DataFrame:
    """Per anchor: neighbours, mean and largest distance, and the share of neighbours with each flag."""
    rows = neighbours.join(flags.select(F.col(key).alias("neighbor"), *columns), "neighbor", "left")
    return rows.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n_neighbors"), F.avg("cosine_distance").alias("mean_distance"), F.max("cosine_distance").alias("max_distance"),
        *[F.avg(F.coalesce(F.col(c), F.lit(False)).cast("int")).alias(f"{c}_fraction") for c in columns],
    )


def context_profile(first: Column, second: Column, third: Column) -> Column:
    """Profile of three shares: the third's context over the second's over the first's, else weak."""
    strong = first >= 0.50
    return F.when((third >= 0.20) & strong, "specific_context").when((second >= 0.20) & strong, "disease_context").when(strong, "general_context").otherwise("weak_context")


def weighted_support(neighbours: DataFrame, binding: DataFrame, *, key: str, top: int = 8) -> DataFrame:
    """anchor, protein, support, mean_value, n_rows, rank: proteins of the neighbours, weighted by 1 / rank."""
    pre = binding.groupBy(F.col(key).alias("neighbor"), "protein").agg(F.avg("binding_value").alias("value"), F.count(F.lit(1)).alias("n"))
    rows = neighbours.join(pre, "neighbor").groupBy("anchor", "protein").agg(F.sum(1 / F.col("neighbor_rank")).alias("support"), F.avg("value").alias("mean_value"), F.sum("n").alias("n_rows"))
    order = Window.partitionBy("anchor").orderBy(F.desc(F.round("support", 9)), "protein")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def distance_score(distance: Column, limit: float = 0.30) -> Column:
    """1 at distance 0 falling to 0 at the limit; 0 for NULL."""
    return F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(distance / limit, F.lit(1.0))), F.lit(0.0))


def priority_score(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Add priority_score, the weighted sum of columns (NULL counts 0), and priority_tier: A from 0.65, B from 0.45, else C."""
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(0.0))
    tier = F.when(F.col("priority_score") >= 0.65, "A").when(F.col("priority_score") >= 0.45, "B").otherwise("C")
    return parts.withColumn("priority_score", score).withColumn("priority_tier", tier)


def token_presence(neighbours: DataFrame, tokens: DataFrame, *, key: str, token: str = "token", n: int = 10) -> DataFrame:
    """anchor, token, n_rows, rank: in how many of the anchor and its neighbours a token occurs, the first ``n``."""
    members = neighbours.select("anchor", F.col("neighbor").alias("member")).unionByName(neighbours.select("anchor", F.col("anchor").alias("member")).distinct())
    rows = members.join(tokens.select(F.col(key).alias("member"), F.col(token).alias("token")).distinct(), "member")
    counts = rows.groupBy("anchor", "token").agg(F.count(F.lit(1)).alias("n_rows"))
    order = Window.partitionBy("anchor").orderBy(F.desc("n_rows"), "token")  # at most k + 1 members an anchor
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def top_means(neighbours: DataFrame, values: DataFrame, *, key: str, columns: Sequence[str], n: int = 8) -> DataFrame:
    """anchor, column, mean, rank: the columns with the largest positive means over an anchor's neighbours."""
    means = neighbours.join(values.select(F.col(key).alias("neighbor"), *columns), "neighbor").groupBy("anchor").agg(*[F.avg(c).alias(c) for c in columns])
    rows = means.unpivot("anchor", list(columns), "column", "mean").where("mean > 0")
    order = Window.partitionBy("anchor").orderBy(F.desc(F.round("mean", 9)), "column")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def bipartite_edges(support: DataFrame, top: int = 5) -> DataFrame:
    """anchor, protein, weight of the first ``top`` supports of each anchor."""
    return support.where(F.col("rank") <= top).select("anchor", "protein", F.col("support").alias("weight"))
