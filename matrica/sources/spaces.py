"""Loading of input tables and of processed manifests, from the first file that exists under its usual names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrica.sources.tables import first_existing

#: Name of each input table and of each processed one, the preferred first.
INPUTS = {name: (name,) for name in ("data_matrix", "feature_metadata", "acquisition_list", "exogenous_standards")}
PROCESSED = {
    "sample_manifest": ("retained_sample_manifest",), "main": ("retained_feature_manifest_main_annotated", "retained_feature_manifest_main"),
    "high": ("retained_feature_manifest_high_annotated", "retained_feature_manifest_high"),
}


def load_first(spark: SparkSession, folder: str, names: Sequence[str], *, required: bool = True) -> DataFrame | None:
    """The first of the named tables in a folder, as parquet or as CSV with a header; None if it may be absent and is."""
    try:
        path = first_existing(spark, [f"{folder}/{n}.{kind}" for n in names for kind in ("parquet", "csv")])
    except FileNotFoundError:
        if required:
            raise
        return None
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)


def load_inputs(spark: SparkSession, folder: str, names: dict[str, Sequence[str]] = INPUTS) -> dict[str, DataFrame]:
    """All input tables of a folder by name; FileNotFoundError if one is missing."""
    return {key: load_first(spark, folder, own) for key, own in names.items()}


def load_optional(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame | None:
    """The first of the named tables that exists, or None."""
    return load_first(spark, folder, names, required=False)


def load_spaces(spark: SparkSession, folder: str, raw: DataFrame, transformed: DataFrame) -> dict[str, DataFrame]:
    """Feature spaces from processed manifests: ``features`` (space, feature and what the main manifest says of it),
    ``samples``, and ``cells`` (space, sample, feature, raw, intensity) of the retained samples.

    Spaces are main, high and representative: the main features whose is_representative holds, or all main ones if
    the manifest has no such column or no such feature. Annotated manifests are preferred.
    """
    tables = {key: load_first(spark, folder, names) for key, names in PROCESSED.items()}
    main, samples = tables["main"], tables["sample_manifest"].dropDuplicates(["sample"])
    representative = main
    if "is_representative" in main.columns:
        chosen = main.where(F.coalesce("is_representative", F.lit(False)))
        representative = main if chosen.isEmpty() else chosen
    features = None
    for name, own in (("main", main), ("high", main.join(tables["high"].select("feature").distinct(), "feature", "left_semi")), ("representative", representative)):
        part = own.dropDuplicates(["feature"]).select(F.lit(name).alias("space"), *main.columns)
        features = part if features is None else features.unionByName(part)
    both = transformed.select("sample", "feature", "intensity").join(raw.select("sample", "feature", F.col("intensity").alias("raw")), ["sample", "feature"], "left")
    cells = both.join(samples.select("sample"), "sample", "left_semi").join(features.select("space", "feature"), "feature").select("space", "sample", "feature", "raw", "intensity")
    return {"features": features, "samples": samples, "cells": cells}
