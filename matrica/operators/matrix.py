"""The feature matrix as long observations, subsets of it, and audits of its tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrica.session import cut_lineage

# Classes in display order; others follow in text order.
CLASS_ORDER = ("B", "SS", "dQC", "QC", "Dunn", "French", "LMU")


def observations(wide: DataFrame, id_column: str = "sample") -> DataFrame:
    """Long form of a wide matrix: sample, feature, intensity; NaN becomes NULL."""
    features = [c for c in wide.columns if c != id_column]
    as_double = wide.select(F.col(id_column).alias("sample"), *[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    value = F.when(~F.isnan("intensity"), F.col("intensity"))
    return as_double.unpivot("sample", [f"`{c}`" for c in features], "feature", "intensity").withColumn("intensity", value)


def wide_matrix(obs: DataFrame, features: Sequence[str], rows: str = "sample") -> DataFrame:
    """Wide form for models; the features are given, so no job is needed to find them."""
    return obs.groupBy(rows).pivot("feature", list(features)).agg(F.first("intensity"))


def class_rank(column: str = "class", order: Sequence[str] = CLASS_ORDER) -> Column:
    """Sort key of a class: its place in the display order, then all others."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.when(place > 0, place).otherwise(len(order) + 1)


def subset_samples(samples: DataFrame, *, batches: Sequence[int] | None = None, classes: Sequence[str] | None = None) -> DataFrame:
    """Samples of the given batches and classes, one row each (the first by batch and order)."""
    out = samples
    if batches is not None:
        out = out.where(F.col("batch").isin(*batches))
    if classes is not None:
        out = out.where(F.col("class").isin(*classes))
    rest = [c for c in out.columns if c != "sample"]
    first = F.min_by(F.struct(*rest), F.struct("batch", "run_order", *[c for c in rest if c not in ("batch", "run_order")]))
    return out.groupBy("sample").agg(first.alias("__f")).select("sample", *[f"__f.{c}" for c in rest])


def samples_of(samples: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The distinct samples of the given classes."""
    return samples.where(F.col("class").isin(*classes) & F.col("sample").isNotNull()).select("sample").distinct()


def subset_observations(obs: DataFrame, samples: DataFrame) -> DataFrame:
    """Observations of the given samples."""
    return obs.join(samples.select("sample").distinct(), "sample", "left_semi")


def inventory(samples: DataFrame) -> DataFrame:
    """n_samples per batch and class; rows with a null batch or class are left out."""
    return samples.where("batch is not null and class is not null").groupBy("batch", "class").agg(F.count(F.lit(1)).alias("n_samples"))


def inventory_pivot(samples: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per batch with a count column per class, 0 where there is none."""
    return samples.where("batch is not null and class is not null").groupBy("batch").pivot("class", list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def missing_orders(samples: DataFrame) -> DataFrame:
    """batch, first_missing, last_missing: gaps between the smallest and largest order of each batch.

    A gap is one row however long it is. Each order's successor comes from a window over a piece of the batch, and
    from the next piece's first order at its end.
    """
    orders = samples.where("run_order is not null").select("batch", F.col("run_order").cast("bigint").alias("pos")).distinct()
    parts = max(1, -(-orders.count() // 65_536))  # range partitions are pieces of equal counts, however sparse the orders
    orders = cut_lineage(orders.repartitionByRange(parts, "batch", "pos").withColumn("piece", F.spark_partition_id()))
    nexts = orders.groupBy("batch", "piece").agg(F.min("pos").alias("first"))
    nexts = nexts.select("batch", "piece", F.lead("first").over(Window.partitionBy("batch").orderBy("piece")).alias("next_first"))
    local = orders.withColumn("next", F.lead("pos").over(Window.partitionBy("batch", "piece").orderBy("pos")))
    on = local["batch"].eqNullSafe(nexts["batch"]) & (local["piece"] == nexts["piece"])
    after = local.join(nexts, on, "left").select(local["batch"], "pos", F.coalesce("next", "next_first").alias("next"))
    return after.where("next > pos + 1").select("batch", (F.col("pos") + 1).alias("first_missing"), (F.col("next") - 1).alias("last_missing"))


def set_differences(left: DataFrame, right: DataFrame, left_key: str, right_key: str, names: tuple[str, str]) -> DataFrame:
    """side and key of the keys that only one of two tables has."""
    a = left.select(F.col(left_key).alias("key")).where("key is not null").distinct()
    b = right.select(F.col(right_key).alias("key")).where("key is not null").distinct()
    return a.join(b, "key", "left_anti").select(F.lit(names[0]).alias("side"), "key").unionByName(b.join(a, "key", "left_anti").select(F.lit(names[1]).alias("side"), "key"))


def require_columns(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """df, or ValueError if it lacks a column."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"{name} lacks the columns {lacking}")
    return df


def audit_tables(obs: DataFrame, features: DataFrame, samples: DataFrame) -> DataFrame:
    """check and n: repeated keys and keys that only one side has, over the three input tables."""
    require_columns(obs, ["sample", "feature"], "observations")
    require_columns(features, ["feature", "mz", "rt"], "features")
    require_columns(samples, ["sample", "class", "batch", "run_order"], "samples")

    def counted(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")

    twice = lambda df, key: df.groupBy(key).count().where("count > 1")
    only = lambda a, b, key: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")
    checks = [
        ("repeated_samples", twice(samples, "sample")), ("repeated_features", twice(features, "feature")),
        ("samples_without_observations", only(samples, obs, "sample")), ("observations_without_sample", only(obs, samples, "sample")),
        ("features_without_observations", only(features, obs, "feature")), ("observations_without_feature", only(obs, features, "feature")),
    ]
    return reduce(DataFrame.unionByName, [counted(name, df) for name, df in checks])


def key_values(row: DataFrame, values: dict[str, Column]) -> DataFrame:
    """metric and value (double) rows of an aggregate over all of df."""
    names = list(values)
    wide = row.agg(*[v.cast("double").alias(k) for k, v in values.items()])
    return wide.unpivot([], names, "metric", "value")
