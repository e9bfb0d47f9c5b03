"""Phase-space rounds to the end, and rows that only their run's average hides."""

import math
import random

import pytest

from matrica.operators.spikes import flag_readings, implausible, phase_space_spikes


def test_rounds_go_on_until_none_is_found(spark):
    rng = random.Random(2)
    u = [rng.gauss(0, 0.01) for _ in range(300)]
    for k in range(9):  # a ramp up to a cliff: taking out its ends leaves the next cliff, a step lower
        u[100 + k] += 0.02 * (k + 1)
    df = spark.createDataFrame([(s, p // 16, p, v if s == 1 else 0.0) for s in (1, 2) for p, v in enumerate(u)], "series int, piece int, pos int, u double")
    every = {(r["series"], r["pos"]): r["iteration"] for r in phase_space_spikes(df).collect()}
    fixed = {(r["series"], r["pos"]): r["iteration"] for r in phase_space_spikes(df, max_iterations=40).collect()}
    three = {(r["series"], r["pos"]) for r in phase_space_spikes(df, max_iterations=3).collect()}
    assert every == fixed and max(every.values()) > 3 and three < set(every)


def test_each_row_is_held_against_the_value_axis(spark):
    rows = [(i, 1, "a", i, 100.0 * 1.02 ** (i % 7)) for i in range(40)] + [(90, 1, "a", 20, 1000.0), (91, 1, "a", 20, 10.0)]
    flags = flag_readings(spark.createDataFrame(rows, "id bigint, batch bigint, kind string, pos bigint, x double"), row_id="id", value="x", series="batch", order="pos", group="kind")
    assert {90, 91} <= {r["row_id"] for r in implausible(flags).collect()}


def brute_rounds(rows, limit=6.0):
    """Rounds of one series of (pos, u): plain loops over runs, with exact lower medians."""
    low = lambda x: sorted(map(abs, x))[(len(x) - 1) // 2] if x else None
    left, found, n_round = list(enumerate(rows)), {}, 0
    while True:
        n_round += 1
        runs = {}
        for _, (p, u) in left:
            runs.setdefault(p, []).append(u)
        places = sorted(runs)
        mean = [sum(runs[p]) / len(runs[p]) for p in places]
        d1 = {i: (mean[i + 1] - mean[i - 1]) / 2 for i in range(1, len(mean) - 1)}
        d2 = {i: mean[i + 1] - 2 * mean[i] + mean[i - 1] for i in d1}
        s1, s2 = (1.4826 * (low(list(d.values())) or 0) for d in (d1, d2))
        z1 = {i: d / s1 for i, d in d1.items() if s1}
        z2 = {i: d / s2 for i, d in d2.items() if s2}
        a, b = (low([mean[i] + s * z for i, z in z2.items()]) or 0 for s in (1, -1))
        rho = max(-0.99, min(0.99, (a * a - b * b) / (a * a + b * b))) if a or b else 0.0
        axis = min(limit, math.sqrt(2 * math.log(100 * len(places)))) if places else limit
        now = set()
        for k, (p, u) in left:
            i = places.index(p)
            plane = (u * u - 2 * rho * u * z2[i] + z2[i] ** 2) / (1 - rho * rho) if i in z2 else u * u
            if plane + z1.get(i, 0.0) ** 2 > axis**2:
                now.add(k)
        if not now:
            return found
        found |= dict.fromkeys(now, n_round)
        left = [x for x in left if x[0] not in now]


@pytest.mark.parametrize("piece", [10_000, 40])
def test_flags_match_brute_force(spark, piece):
    rng, data = random.Random(9), []
    for batch in (1, 2, None):
        pos = 0
        for k in range(220):
            ramp = 0.1 * (k - 99) if batch == 2 and 100 <= k < 109 else 0.0
            pos += rng.choice([1, 1, 5, 1000])
            for _ in range(rng.choice([1, 1, 1, 3])):
                data.append((len(data), batch, rng.choice("ab"), pos, 10 ** (2 + ramp + rng.gauss(0, 0.05) + (rng.choice([-1, 1]) * rng.uniform(0.2, 2) if rng.random() < 0.05 else 0)) - 1))
    df = spark.createDataFrame(data, "id bigint, batch bigint, kind string, pos bigint, x double")
    got = {r["row_id"]: r for r in flag_readings(df, row_id="id", value="x", series="batch", order="pos", group="kind", piece=piece, hot_limit=100).collect()}
    assert len(got) == len(data)
    rounds = []
    for batch in (1, 2, None):
        own = [r for r in data if r[1] == batch]
        want = brute_rounds([(r[3], got[r[0]]["score"]) for r in own])
        assert {k: got[r[0]]["spike_iteration"] for k, r in enumerate(own) if got[r[0]]["spike_iteration"]} == want
        rounds.append(max(want.values()))
        assert any(abs(got[own[k][0]]["score"]) < 4 for k in want)  # differences find what the value alone does not
    assert max(rounds) > 2
