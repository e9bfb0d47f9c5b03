"""Orphan references against brute force, on the cold and the hot path."""

import random
from datetime import datetime, timedelta

import pytest

from matrica.operators.orphans import Reference, Relation, coverage_gaps, orphan_cascade

T0 = datetime(2024, 1, 31, 23, 0)


def day(n):
    return None if n is None else T0 + timedelta(hours=n)


@pytest.mark.parametrize("hot_limit", [10**9, 5])
def test_coverage_matches_brute_force(spark, hot_limit):
    rng = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", "c"]
    spans = [(rng.choice(keys), rng.choice([None, *range(40)]), rng.choice([None, *range(60)])) for _ in range(60)]
    refs = [(i, rng.choice([*keys, "missing"]), rng.choice([None, *range(60)])) for i in range(120)]
    spans_df = spark.createDataFrame([(k, day(a), day(b)) for k, a, b in spans], "key string, start timestamp_ntz, end timestamp_ntz")
    refs_df = spark.createDataFrame([(i, k, day(t)) for i, k, t in refs], "id int, key string, at timestamp_ntz")
    found = {r["id"] for r in coverage_gaps(refs_df, spans_df, hot_limit).collect()}
    covered = lambda k, t: t is not None and any(k == s and a is not None and a <= t and (b is None or b > t) for s, a, b in spans)
    assert found == {i for i, k, t in refs if not covered(k, t)}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cascade_inherits_down_the_graph(spark):
    root = frame(spark, [(1, "A", day(0), None), (2, "B", day(0), day(5))], "id bigint, k string, a timestamp_ntz, b timestamp_ntz")
    middle = frame(spark, [(1, " a\t", "M1", day(1)), (2, "b", "M2", day(9)), (3, None, "M3", day(9)), (4, "b", "M4", day(1)), (5, "x", "M4", day(1))], "id bigint, k string, own string, t timestamp_ntz")
    leaf = frame(spark, [(1, "m1", "L1"), (2, "M2", "L2"), (3, "none", "L3"), (4, "m4", "L4"), (5, "", "L5")], "id bigint, k string, own string")
    low = frame(spark, [(1, "l2"), (2, "l1"), (2, "l3")], "id bigint, k string")
    relations = [Relation("root", root, "id", "k", None, "a", "b"), Relation("middle", middle, "id", "own", "t"), Relation("leaf", leaf, "id", "own"), Relation("low", low, "id")]
    references = [Reference("middle", "k", "root"), Reference("leaf", "k", "middle"), Reference("low", "k", "leaf")]
    found = {(r["table_name"], r["row_id"], r["kind"], r["depth"]) for r in orphan_cascade(relations, references).collect()}
    assert found == {
        ("middle", 2, "direct", 1), ("middle", 5, "direct", 1), ("leaf", 3, "direct", 1),
        ("leaf", 2, "inherited", 2), ("low", 1, "inherited", 3), ("low", 2, "inherited", 2),
    }


def test_empty_tables_and_null_times(spark):
    root = frame(spark, [], "id bigint, k string, a timestamp_ntz, b timestamp_ntz")
    child = frame(spark, [(1, "x", None), (1, "x", None), (2, "x", day(0)), (3, " ", day(0))], "id bigint, k string, key timestamp_ntz")
    relations = [Relation("root", root, "id", "k", None, "a", "b"), Relation("child", child, "id", None, "key")]
    rows = orphan_cascade(relations, [Reference("child", "k", "root")]).collect()
    assert sorted((r["row_id"], r["ref_period"] or "") for r in rows) == [(1, ""), (1, ""), (2, "2024-01")]
    relations[1] = Relation("child", child.limit(0), "id", None, "key")
    assert orphan_cascade(relations, [Reference("child", "k", "root")]).count() == 0


def test_clashing_columns_and_nulls_everywhere(spark):
    schema = "row_id bigint, key string, at timestamp_ntz, table_name string, kind string, parent string, depth int"
    child = frame(spark, [(1, "a", day(1), "t", "k", "p", 9), (None, "b", day(1), None, None, None, None), (None, None, None, None, None, None, None)], schema)
    root = frame(spark, [(7, "A ", day(0), None), (None, None, None, None)], "key bigint, sample string, start timestamp_ntz, end timestamp_ntz")
    relations = [Relation("root", root, "key", "sample", None, "start", "end"), Relation("child", child, "row_id", "key", "at"), Relation("low", child, "row_id", None, "at")]
    rows = orphan_cascade(relations, [Reference("child", "key", "root"), Reference("low", "key", "child")]).collect()
    assert [(r["table_name"], r["row_id"], r["kind"]) for r in rows if r["kind"] == "direct"] == [("child", None, "direct")]
