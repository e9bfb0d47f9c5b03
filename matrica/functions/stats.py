"""Rank statistics, correlations and multiple testing as DataFrame expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from matrica.functions.keys import HOT_ROWS, hot_keys, join_null_safe
from matrica.session import cut_lineage

#: Pieces into which the values of a hot group are cut for ranking.
RANK_PIECES = 256


def average_rank(df: DataFrame, keys: Sequence[str], value: str, into: str, *, hot_limit: int | None = None) -> DataFrame:
    """Add the 1-based average rank of ``value`` within its group; NULL values get no rank and count for none.

    With ``hot_limit``, groups of more rows are ranked in two levels: cut points from approximate percentiles part
    the values, ranks within a piece are offset by the counts of the pieces before it. The ranks are exact either way, as
    equal values always share a piece.
    """
    keys = list(keys)

    def ranked(rows: DataFrame, by: list[str]) -> Column:
        order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
        ties = F.count(value).over(Window.partitionBy(*by, value))
        return F.when(F.col(value).isNotNull(), F.rank().over(order) + (ties - 1) / 2)

    if hot_limit is None:
        return df.withColumn(into, ranked(df, keys))
    hot = cut_lineage(hot_keys(df, keys, hot_limit))
    if hot.isEmpty():
        return df.withColumn(into, ranked(df, keys))
    hot = F.broadcast(hot)
    cold, rows = join_null_safe(df, hot, keys, "left_anti"), join_null_safe(df, hot, keys, "left_semi")
    shares = [i / RANK_PIECES for i in range(1, RANK_PIECES)]
    cuts = rows.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, shares, 10_000)).alias("__cuts"))
    rows = join_null_safe(rows, F.broadcast(cuts), keys)
    rows = rows.withColumn("__piece", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    before = F.sum("__n").over(Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.where(F.col(value).isNotNull()).groupBy(*keys, "__piece").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0))).drop("__n")
    rows = join_null_safe(rows.withColumn(into, ranked(rows, [*keys, "__piece"])), F.broadcast(offsets), [*keys, "__piece"])
    rows = rows.withColumn(into, F.col(into) + F.col("__before")).drop("__piece", "__before")
    return cold.withColumn(into, ranked(cold, keys)).unionByName(rows)


def pearson(x: Column, y: Column) -> Column:
    """Pearson correlation aggregate; NULL where either side is constant."""
    sd = F.stddev_samp(x) * F.stddev_samp(y)
    return F.try_divide(F.covar_samp(x, y), F.when(sd > 0, sd))


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, into: str = "rho", *, hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """keys, ``into`` and n: Spearman correlation with average ranks over the rows that have both values.

    NULL where either side has one distinct value or fewer than two rows remain.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x).alias("__x"), F.col(y).alias("__y"))
    rows = average_rank(average_rank(rows, keys, "__x", "__rx", hot_limit=hot_limit), keys, "__y", "__ry", hot_limit=hot_limit)
    return rows.groupBy(*keys).agg(pearson(F.col("__rx"), F.col("__ry")).alias(into), F.count(F.lit(1)).alias("n"))


def bh_adjust(df: DataFrame, keys: Sequence[str], p: str, into: str = "q_value") -> DataFrame:
    """Add Benjamini-Hochberg q-values within keys; NULL p-values stay NULL and count for none, tied ones share a q.

    One row per tested feature is expected, so a group is as large as the number of features.
    """
    tested = F.count(p).over(Window.partitionBy(*keys))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(p).asc_nulls_last()))
    rows = df.withColumn("__raw", F.when(F.col(p).isNotNull(), F.col(p) * tested / rank))
    falling = Window.partitionBy(*keys).orderBy(F.col(p).desc_nulls_first(), F.col("__raw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(into, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__raw").over(falling)))).drop("__raw")


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    """Complementary error function, which Spark lacks."""
    return x.map(math.erfc, na_action="ignore")


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, positive: str, *, hot_limit: int | None = HOT_ROWS) -> DataFrame:
    """keys, n_pos, n_neg, u_stat, z, auc, cliffs_delta: two-sided Mann-Whitney of the rows where ``positive`` is true.

    z is asymptotic with tie and continuity correction; p = erfc(z / sqrt(2)). NULL where a side is empty; z is NULL
    where all values tie.
    """
    rows = average_rank(df.where(F.col(value).isNotNull()), keys, value, "__rank", hot_limit=hot_limit)
    tied = rows.groupBy(*keys, value).agg(
        F.sum(F.when(F.col(positive), F.col("__rank"))).alias("r"), F.count_if(F.col(positive)).alias("a"), F.count(F.lit(1)).alias("t")
    )
    sums = tied.groupBy(*keys).agg(
        F.sum("r").alias("r"), F.sum("a").alias("n_pos"), (F.sum("t") - F.sum("a")).alias("n_neg"),
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("ties"),
    )
    n, product = F.col("n_pos") + F.col("n_neg"), (F.col("n_pos") * F.col("n_neg")).cast("double")
    u = F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2
    spread = F.sqrt(product / 12 * ((n + 1) - F.try_divide(F.col("ties"), (n * (n - 1)).cast("double"))))
    some = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    out = sums.withColumn("u_stat", F.when(some, u)).withColumn("auc", F.try_divide(F.col("u_stat"), product))
    z = F.greatest(F.lit(0.0), F.abs(F.col("u_stat") - product / 2) - 0.5) / F.when(spread > 0, spread)
    return out.withColumn("z", F.when(some, z)).withColumn("cliffs_delta", 2 * F.col("auc") - 1).select(*keys, "n_pos", "n_neg", "u_stat", "z", "auc", "cliffs_delta")


def check_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    """df, after a job that raises ValueError if a key repeats (the contract of one-to-one joins)."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{name} repeats the key {twice[0].asDict()}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", *, validate: str = "one_to_one") -> DataFrame:
    """Equi-join with a cardinality contract: 'one_to_one' or 'many_to_one'."""
    if validate not in ("one_to_one", "many_to_one"):
        raise ValueError(f"unknown contract {validate}")
    if validate == "one_to_one":
        check_unique(left, keys, "left table")
    return left.join(check_unique(right, keys, "right table"), list(keys), how)
