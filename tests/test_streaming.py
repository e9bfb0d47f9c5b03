"""Increments of files add up to the whole."""

import tempfile

from pyspark.sql import functions as F

from matrica.streaming.increments import run_increments


def test_partial_counts_add_up(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    data = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    step = lambda df: df.groupBy("k").agg(F.count("id").alias("n"))
    for part in (data.where("id < 60"), data.where("id >= 60")):
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        run_increments(spark, f"{root}/in", "k bigint, id bigint", step, f"{root}/out", f"{root}/state").awaitTermination()
    got = spark.read.parquet(f"{root}/out").groupBy("k").agg(F.sum("n").alias("n"))
    assert {r["k"]: r["n"] for r in got.collect()} == {0: 34, 1: 33, 2: 33}
