"""Exact grouped medians that no hot group overloads, and robust scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrica.functions.keys import BROADCAST_ROWS, HOT_ROWS, hot_keys, join_counted, join_null_safe
from matrica.session import cut_lineage

#: Bins of one narrowing step over a hot group.
BINS = 4096
#: The largest finite double, which stands for infinity while a hot group is narrowed.
LARGEST = 1.7976931348623157e308
#: Scale that makes the median absolute deviation a standard deviation under normality.
MAD_TO_SD = 1.4826


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, into: str = "median", *, hot_limit: int = HOT_ROWS, hot: DataFrame | None = None) -> DataFrame:
    """Exact median of ``value`` per group: keys, ``into``, n (non-null values). NULL keys form groups of their own.

    Nulls are left out; NaN must not occur, infinite values may. Groups of up to ``hot_limit`` values use the median aggregate. Larger
    ones are narrowed by histograms: each step counts BINS bins per group with map-side partial counts and keeps the
    bin that holds the wanted rank, until at most ``hot_limit`` values remain there, which are then ranked. The
    result is the same either way (the mean of the two middle values). hot: the keys of the larger groups, where the
    caller has them.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    hot = cut_lineage(hot_keys(rows, keys, hot_limit)) if hot is None else hot
    plain = lambda d: d.groupBy(*keys).agg(F.median("v").alias(into), F.count("v").alias("n"))
    if hot.isEmpty():
        return plain(rows)
    hot = F.broadcast(hot)
    cold = join_null_safe(rows, hot, keys, "left_anti")
    return plain(cold).unionByName(_hot_medians(join_null_safe(rows, hot, keys, "left_semi"), keys, into, hot_limit))


def _hot_medians(rows: DataFrame, keys: list[str], into: str, limit: int) -> DataFrame:
    rows = rows.withColumn("v", F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.col("v"))))  # bins need finite ends
    spans = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.array_distinct(F.array(F.expr("(n + 1) div 2"), F.expr("(n + 2) div 2")))
    # One target per wanted rank: the value range that still holds it, its rank there, and how many values lie there.
    targets = cut_lineage(spans.select(*keys, "n", F.explode(ranks).alias("asked"), "lo", "hi").withColumn("rank", F.col("asked")).withColumn("within", F.col("n")))
    while not targets.where((F.col("within") > limit) & (F.col("lo") < F.col("hi"))).isEmpty():
        near = join_null_safe(rows, F.broadcast(targets), keys, "inner").where("v >= lo and v <= hi")
        place = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)  # halves: no overflow
        near = near.withColumn("bin", F.when(F.col("lo") < F.col("hi"), F.least(F.floor(place * BINS), F.lit(BINS - 1))).otherwise(0))
        bins = near.groupBy(*keys, "n", "asked", "rank", "bin").agg(F.count("v").alias("within"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        upto = F.sum("within").over(Window.partitionBy(*keys, "asked").orderBy("bin"))
        bins = bins.withColumn("upto", upto).where("upto >= rank and upto - within < rank")
        targets = cut_lineage(bins.select(*keys, "n", "asked", "lo", "hi", (F.col("rank") - F.col("upto") + F.col("within")).alias("rank"), "within"))
    near = join_null_safe(rows, F.broadcast(targets.where("lo < hi")), keys, "inner").where("v >= lo and v <= hi")
    place = F.row_number().over(Window.partitionBy(*keys, "asked").orderBy("v"))
    picked = near.withColumn("place", place).where("place = rank").select(*keys, "n", "asked", "v")
    single = targets.where("lo = hi").select(*keys, "n", "asked", F.col("lo").alias("v"))
    both = picked.unionByName(single).withColumn("v", F.when(F.abs("v") == LARGEST, F.signum("v") * float("inf")).otherwise(F.col("v")))
    return both.groupBy(*keys).agg(F.avg("v").alias(into), F.first("n").alias("n"))


def median_mad(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """keys and med_<c>, mad_<c>, n_<c> per group for several columns, all exact, nulls left out; in two passes."""
    keys = list(keys)
    if len(columns) == 1:
        long, by = df.select(*keys, F.col(columns[0]).cast("double").alias("x")).where("x is not null"), keys
    else:
        values = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])
        long, by = df.select(*keys, F.explode(values).alias("e")).select(*keys, "e.*").where("x is not null"), [*keys, "metric"]
    hot = cut_lineage(hot_keys(long, by, hot_limit))  # deviations have the groups of their values
    med = cut_lineage(grouped_median(long, by, "x", "med", hot_limit=hot_limit, hot=hot))
    near = F.broadcast(med) if med.count() <= BROADCAST_ROWS else med
    off = join_null_safe(long, near, by).withColumn("off", F.abs(F.col("x") - F.col("med")))
    both = join_null_safe(med, grouped_median(off, by, "off", "mad", hot_limit=hot_limit, hot=hot).drop("n"), by)
    if len(columns) == 1:
        return both.select(*keys, *[F.col(what).alias(f"{what}_{columns[0]}") for what in ("med", "mad", "n")])
    own = lambda what, c: F.max(F.when(F.col("metric") == c, F.col(what))).alias(f"{what}_{c}")
    return both.groupBy(*keys).agg(*[own(what, c) for c in columns for what in ("med", "mad", "n")])


def medians(df: DataFrame, keys: Sequence[str], values: dict[str, Column], *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """keys and one exact median per named column, nulls left out; groups without any value have no row.

    In place of median aggregates wherever a group may hold a large share of the rows (see grouped_median).
    """
    keys = list(keys)
    each = F.array(*[F.struct(F.lit(name).alias("metric"), value.cast("double").alias("x")) for name, value in values.items()])
    long = df.select(*keys, F.explode(each).alias("e")).select(*keys, "e.*")
    found = grouped_median(long, [*keys, "metric"], "x", "m", hot_limit=hot_limit)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == name, F.col("m"))).alias(name) for name in values])


def with_medians(stats: DataFrame, df: DataFrame, keys: Sequence[str], values: dict[str, Column], *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """stats (one row per group of df) with the medians of its groups."""
    return join_null_safe(stats, medians(df, keys, values, hot_limit=hot_limit), list(keys))


def with_median_mad(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """df with med_<c>, mad_<c> and n_<c> of each column over its group."""
    return join_counted(df, median_mad(df, keys, columns, hot_limit=hot_limit), list(keys))


def robust_z(value: Column, med: Column, mad: Column) -> Column:
    """0.6745 (x - median) / MAD; NULL where MAD is 0."""
    return F.try_divide(F.lit(0.6745) * (value - med), F.when(mad != 0, mad))


def robust_z_or_sd(value: Column, med: Column, mad: Column, sd: Column) -> Column:
    """MAD score; where MAD is 0 or NULL the score by the standard deviation; 0 where that is 0 or NULL too."""
    by_mad = robust_z(value, med, mad)
    by_sd = F.when(sd > 0, (value - med) / sd).otherwise(F.lit(0.0))
    return F.when(value.isNull(), None).when(mad > 0, by_mad).otherwise(by_sd)
