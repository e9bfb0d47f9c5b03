"""Implausible readings against brute force, with small pieces and hot groups."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from matrica.functions.robust import grouped_median
from matrica.operators.spikes import flag_readings, implausible, phase_space_spikes

NAMES = {"row_id": "id", "value": "x", "series": "batch", "order": "pos", "group": "kind"}
SCHEMA = "id bigint, batch bigint, kind string, pos bigint, x double, value double"


def make(seed):
    rng, rows, i = random.Random(seed), [], 0
    for batch in (1, 2, None):
        pos, hold = 0, None
        for _ in range(150):
            pos += rng.choice([1, 1, 1, 3])
            x = rng.lognormvariate(5, 0.3)
            if hold and hold[1] > 0:
                x, hold = hold[0], (hold[0], hold[1] - 1)
            elif rng.random() < 0.08:
                hold = (x, rng.randint(2, 9))
            if rng.random() < 0.06:
                x = rng.choice([-1.0, float("nan"), float("inf"), None, x * 1e4, 0.0])
            kind = rng.choice(["a", "b", None])
            for _ in range(rng.choice([1, 1, 1, 2])):
                rows.append((i, batch, kind, pos if rng.random() > 0.03 else None, x, 0.0))
                i += 1
    return rows


def brute(rows):
    bad = lambda x: x < 0 or math.isnan(x) or math.isinf(x)
    out = {r[0] for r in rows if r[4] is not None and bad(r[4])}
    for batch in {r[1] for r in rows}:
        runs = {}
        for r in rows:
            if r[1] == batch and r[3] is not None:
                runs.setdefault(r[3], []).append(r[4])
        same = [(p, v[0] if None not in v and len({str(x) for x in v}) == 1 else None) for p, v in sorted(runs.items())]
        at = 0
        while at < len(same):
            end = at + 1
            while end < len(same) and same[at][1] is not None and str(same[end][1]) == str(same[at][1]):
                end += 1
            if end - at >= 5:
                held = {p for p, _ in same[at:end]}
                out |= {r[0] for r in rows if r[1] == batch and r[3] in held and r[4] is not None}
            at = end
        for kind in {r[2] for r in rows}:
            own = {r[0]: math.log10(r[4] + 1) for r in rows if r[1] == batch and r[2] == kind and r[4] is not None and not bad(r[4])}
            if len(own) >= 12:
                m = median(own.values())
                d = median(abs(v - m) for v in own.values())
                out |= {i for i, v in own.items() if abs(v - m) > 6 * 1.4826 * d}
    return out


@pytest.mark.parametrize(("piece", "hot"), [(65_536, 10**9), (7, 20)])
def test_found_matches_brute_force(spark, piece, hot):
    rows = make(5)
    flags = flag_readings(spark.createDataFrame(rows, SCHEMA), **NAMES, piece=piece, hot_limit=hot)
    assert {r["row_id"] for r in implausible(flags).collect()} == brute(rows)
    assert flags.count() == sum(r[4] is not None for r in rows)


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(1, 1, "a", 1, None, 0.0), (2, None, None, None, None, 0.0)], SCHEMA)
    assert flag_readings(df, **NAMES).count() == 0
    assert flag_readings(df.limit(0), **NAMES).count() == 0


def test_phase_space_iterates(spark):
    rng = random.Random(2)
    rows = [(1, p // 16, p, rng.gauss(0, 1) + (30 if p == 50 else 9 if p == 51 else 0)) for p in range(200)]
    spikes = {(r["pos"], r["iteration"]) for r in phase_space_spikes(spark.createDataFrame(rows, "series int, piece int, pos int, u double")).collect()}
    assert (50, 1) in spikes and 51 in {p for p, _ in spikes}


@pytest.mark.parametrize("limit", [10**9, 40])
def test_grouped_median_is_exact(spark, limit):
    rng = random.Random(4)
    rows = [(k, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e6), 3.0])) for k in ["a"] * 5000 + ["b"] * 301 + [None] * 60 + ["c"] * 7] + [("d", 5.0)] * 100 + [("e", None)]
    got = {r["k"]: (r["m"], r["n"]) for r in grouped_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", "m", hot_limit=limit).collect()}
    want = {}
    for k in ["a", "b", None, "c", "d"]:
        own = [v for g, v in rows if g == k]
        want[k] = (median(own), len(own))
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and math.isclose(got[k][0], want[k][0], rel_tol=1e-12) for k in want)
    inf = float("inf")
    ends = spark.createDataFrame([("x", v) for v in [-inf] * 60 + [1.0, 2.0] + [inf] * 60] + [("y", inf)] * 90, "k string, v double")
    assert {r["k"]: r["m"] for r in grouped_median(ends, ["k"], "v", "m", hot_limit=limit).collect()} == {"x": 1.5, "y": inf}
    assert grouped_median(spark.createDataFrame(rows, "k string, v double").where(F.lit(False)), ["k"], "v").count() == 0
