"""The rows that p7_found asks for hang on no round of the phase-space ellipsoid."""

import random

import pytest

from matrica.operators import spikes


@pytest.mark.parametrize("piece", [10_000, 40])
def test_rounds_add_and_take_nothing(spark, monkeypatch, piece):
    rng = random.Random(5)
    rows = [(i, 1, rng.choice("ab"), None if i % 50 == 9 else i // 2, 10 ** (2 + rng.gauss(0, 0.05) + (rng.choice([-1, 1]) if rng.random() < 0.08 else 0)) - 1) for i in range(300)]
    rows += [(900 + i, 1, "a", 1000 + i, 55.0) for i in range(6)] + [(950, 1, "b", 2000, -3.0)]
    df = spark.createDataFrame(rows, "id bigint, batch bigint, kind string, pos bigint, x double")
    how = {"row_id": "id", "value": "x", "series": "batch", "order": "pos", "group": "kind", "piece": piece}
    found = {r["row_id"] for r in spikes.implausible(spikes.flag_readings(df, **how)).collect()}
    monkeypatch.setattr(spikes, "phase_space_spikes", None)
    flags = spikes.flag_readings(df, **how, max_iterations=0)
    assert {r["row_id"] for r in spikes.implausible(flags).collect()} == found and len(found) > 20 and {903, 950} <= found
