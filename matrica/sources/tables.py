"""Table sources and sinks: parquet by default, CSV with a declared schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder (one file or a folder of parts)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv_table(spark: SparkSession, path: str, schema: str, nulls: Sequence[str] = ("", "nan", "NaN", "NA")) -> DataFrame:
    """A CSV table with a header and a declared schema; missing spellings and NaN become NULL."""
    df = spark.read.csv(path, header=True, schema=schema, nullValue="", nanValue="NaN")
    for name, kind in df.dtypes:
        if kind == "string":
            df = df.withColumn(name, F.when(~F.trim(name).isin(*nulls), F.col(name)))
        elif kind in ("double", "float"):
            df = df.withColumn(name, F.when(~F.isnan(name), F.col(name)))
    return df


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first of the candidate paths that exists on its Hadoop file system; FileNotFoundError if none does."""
    jvm = spark._jvm
    for path in candidates:
        p = jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(f"none of {list(candidates)} exists")


def resolve_column(df: DataFrame, candidates: Sequence[str], *, exact: bool = False) -> str | None:
    """The first column named by an ordered list of synonyms; None if there is none.

    exact: compare names with regard to case.
    """
    have = {c if exact else c.lower(): c for c in reversed(df.columns)}
    return next((have[k] for c in candidates if (k := c if exact else c.lower()) in have), None)


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), csv: bool = False) -> None:
    """Write parquet (or CSV with a header), replacing what was there."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path, header=True) if csv else writer.parquet(path)
