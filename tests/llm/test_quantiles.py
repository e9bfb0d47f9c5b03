"""Percentile sketches: exact while small, within the stated error when large, and mergeable in any split."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrica.llm.quantiles import Sketch, build_sketches, grouped_quantiles, merge_sketches, rank_check, relative_error, sketch_quantiles

QS = [0.001, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999]


@pytest.mark.parametrize("shape", ["normal", "heavy", "ties", "sorted"])
def test_error_stays_within_the_bound(shape):
    rng = np.random.default_rng(1)
    values = {"normal": rng.normal(size=300_000), "heavy": rng.pareto(0.7, 300_000), "ties": rng.integers(0, 50, 300_000).astype(float), "sorted": np.arange(300_000.0)}[shape]
    parts = []
    for piece in np.array_split(values, 37):
        s = Sketch.empty(50)
        for some in np.array_split(piece, 5):
            s.add(some)
        parts.append(s)
    whole = parts[0]
    for s in parts[1:]:
        whole.merge(s)
    assert whole.high.n == len(values) and sum(len(v) << h for h, v in enumerate(whole.high.levels)) == len(values)
    assert sum(map(len, whole.high.levels)) < len(values) / 8
    order = np.sort(values)
    for q, (value, error) in zip(QS, whole.quantiles(QS, 50)):
        low, high = np.searchsorted(order, value, "left") + 1, np.searchsorted(order, value, "right")
        rank, slack = math.ceil(q * len(order)), error * len(order) + 1
        assert low - slack <= rank <= high + slack
        assert error <= relative_error(len(order), 50) * min(q, 1 - q) + 1e-5


def test_small_groups_are_exact_and_odd_values_left_out(spark):
    data = [("a", float(i)) for i in range(1, 102)] + [("b", 7.0), ("b", None), ("c", None), (None, 1.0), (None, float("nan")), (None, float("inf")), ("a", float("-inf"))]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    got = {(r["k"], r["q"]): (r["value"], r["rank_error"], r["n"]) for r in grouped_quantiles(df, ["k"], "v", [0.0, 0.5, 1.0]).collect()}
    assert got["a", 0.5] == (51.0, 0.0, 101) and got["a", 0.0][0] == 1.0 and got["a", 1.0][0] == 101.0
    assert got["b", 0.5] == (7.0, 0.0, 1) and got[None, 0.5] == (1.0, 0.0, 1) and ("c", 0.5) not in got
    assert grouped_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


def test_days_merge_into_the_whole(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 3, i % 40, rng.lognormvariate(0, 2)) for i in range(60_000)], "k int, day int, v double").repartition(7)
    days = merge_sketches(build_sketches(df, ["k", "day"], "v", section=20), ["k", "day"], 7, section=20)
    assert days.count() == 120
    whole = sketch_quantiles(merge_sketches(days.withColumn("part", F.col("day")), ["k"], 40, section=20), ["k"], QS, section=20)
    checked = rank_check(df, whole, ["k"], "v")
    assert checked.count() == 21 and checked.where("not within").isEmpty() and {r["n"] for r in checked.collect()} == {20_000}
