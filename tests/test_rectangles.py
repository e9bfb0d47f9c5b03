"""Counts and clusters over ranges of mass and time against all pairs."""

import random

import pytest

from matrica.operators import pairs
from matrica.operators.pairs import RedundancyRules


def brute(data, r):
    """(feature_a, feature_b, isomer, adduct) over all pairs of rows."""
    full = sorted((x for x in data if None not in x), key=lambda x: (x[1], x[0]))
    for i, a in enumerate(full):
        for b in full[i + 1 :]:
            mz, rt = b[1] - a[1], abs(b[2] - a[2])
            isomer, adduct = mz <= r.isomer_mz and not rt < r.isomer_rt, rt <= r.adduct_rt and r.adduct_least_mz <= mz <= r.adduct_most_mz
            if isomer or adduct:
                yield a[0], b[0], isomer, adduct


def table(seed, n):
    rng = random.Random(seed)
    data = [(f"f{rng.random():.9f}", round(rng.choice([300, 330, 900, 2000]) + rng.uniform(0, 60), rng.choice([0, 2])), round(rng.uniform(0, 200), rng.choice([0, 2]))) for _ in range(n)]
    data += [("g1", 500.0, 1.0), ("g2", 500.015, 9.0), ("g3", 530.0, 21.0), ("n", None, 1.0), ("t", 500.0, None), ("i", 300.0, float("inf")), ("i2", 300.0, float("nan")), ("alone", 9000.0, 5.0)]
    return data


SCHEMA = "feature string, mz double, rt double"
RULES = [RedundancyRules(), RedundancyRules(isomer_mz=2.0, isomer_rt=50.0, adduct_rt=3.0, adduct_least_mz=0.0), RedundancyRules(isomer_rt=0.0, adduct_least_mz=-1.0, adduct_most_mz=1.0, adduct_rt=2.0)]


@pytest.mark.parametrize("rules", RULES)
@pytest.mark.parametrize("n", [30, 500])
def test_counts_and_clusters_match_all_pairs(spark, rules, n):
    data = table(n, n)
    df, found = spark.createDataFrame(data, SCHEMA), list(brute(data, rules))
    counts, root = {}, {x[0]: x[0] for x in data}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b, isomer, adduct in found:
        for f in (a, b):
            c = counts.setdefault(f, [0, 0])
            c[0] += isomer
            c[1] += adduct
        first, second = sorted((top(a), top(b)))
        root[second] = first
    got = pairs.range_neighbours(df, rules).collect()
    assert {r["feature"]: [r["n_isomer"], r["n_adduct"]] for r in got} == counts and all(r["n_near_duplicate"] == r["n_correlated"] == 0 for r in got)
    assert {r["feature"]: r["cluster"] for r in pairs.range_clusters(df, rules).collect()} == {f: top(f) for f in root}
    edges = pairs.redundancy_edges(df, None, rules)
    assert sorted((r["feature_a"], r["feature_b"], r["is_isomer"], r["is_adduct"]) for r in edges.collect()) == sorted(found)


def test_no_pair_is_formed(spark, monkeypatch, tmp_path):
    """Counts and clusters of many features in one place, whose pairs would be 18 million."""
    from matrica.plans import analytics

    rows = spark.range(6000).selectExpr("concat('f', lpad(id, 5, '0')) feature", "500.0 + id / 250 mz", "id % 19 + 0.5 rt", "1.0 mz_std", "1.0 rt_std")
    rows.write.parquet(f"{tmp_path}/feature_metadata.parquet")
    monkeypatch.setattr(pairs, "cell_pairs", None)
    assert {r["cluster"] for r in analytics.redundancy_clusters(spark, str(tmp_path)).collect()} == {"f00000"}
    middle = analytics.redundancy_neighbours(spark, str(tmp_path)).where("feature = 'f03000'").first()
    assert middle["n_adduct"] == 2 * 2875 + 1  # 0.5 to 12 Da on either side, where the smaller side has one more row


def test_edges_are_not_shuffled(spark):
    """Only rows of features are exchanged, below the joins that form the pairs."""
    plan = pairs.redundancy_edges(spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 1.0)], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Aggregate" not in plan


def test_representatives_and_collapse_over_slabs(spark, tmp_path):
    """A chain over three slabs is one cluster whose pairs no task holds together."""
    from matrica.plans import analytics

    rows = [(f"f{i:02d}", 100.0 + 29.0 * i, 1.0, float(9 - i), float(i)) for i in range(8)] + [("z", 900.0, 1.0, 1.0, 1.0)]
    spark.createDataFrame(rows, "feature string, mz double, rt double, mz_std double, rt_std double").write.parquet(f"{tmp_path}/feature_metadata.parquet")
    picked = {r["feature"]: (r["cluster"], r["cluster_size"], r["representative_feature"]) for r in analytics.representative_pick(spark, str(tmp_path)).collect()}
    assert picked == {f"f{i:02d}": ("f00", 8, "f07") for i in range(8)} | {"z": ("z", 1, "z")}
    assert {(r["cluster"], r["feature"], r["n_members"]) for r in analytics.cluster_collapse(spark, str(tmp_path)).collect()} == {("f00", "f00", 8), ("z", "z", 1)}


@pytest.mark.parametrize("hot_limit", [1000, 0])
def test_few_links_between_slabs_are_joined_without_rounds(spark, monkeypatch, hot_limit):
    """Chains over seventy slabs, whose names do not ascend with their masses: one task joins them, or the rounds do."""
    rounds, names = [], [f"f{i * 37 % 70:02d}" for i in range(70)]
    clusters = pairs.clusters
    monkeypatch.setattr(pairs, "clusters", lambda *a, **k: rounds.append(1) or clusters(*a, **k))
    rows = [(f, 100.0 + 29.0 * i + 1000.0 * (i > 40), 1.0) for i, f in enumerate(names)] + [("z", 9000.0, 1.0), ("t", 100.0, None), (None, 100.0, 1.0)]
    got = {r["feature"]: r["cluster"] for r in pairs.range_clusters(spark.createDataFrame(rows, SCHEMA), hot_limit=hot_limit).collect()}
    assert got == {f: min(names[:41]) if i < 41 else min(names[41:]) for i, f in enumerate(names)} | {"z": "z", "t": "t"}
    assert len(rounds) == (hot_limit == 0)


def test_representatives_without_rounds(spark, monkeypatch, tmp_path):
    """The registered query picks over clusters whose parts one task joins."""
    from matrica.plans import analytics

    rows = [(f"f{i:02d}", 100.0 + 29.0 * i, 1.0, float(30 - i)) for i in range(30)]
    spark.createDataFrame(rows, "feature string, mz double, rt double, mz_std double").write.parquet(f"{tmp_path}/feature_metadata.parquet")
    monkeypatch.setattr(pairs, "clusters", None)
    picked = {r["feature"]: (r["cluster"], r["cluster_size"], r["representative_feature"]) for r in analytics.representative_pick(spark, str(tmp_path)).collect()}
    assert picked == {f"f{i:02d}": ("f00", 30, "f29") for i in range(30)}


def test_slabs_send_few_rows_twice(spark):
    """Rows over many times the rules' reach: only those near a border go to a second slab, each into its own one once."""
    from matrica.operators.rectangles import slabs

    rows = spark.range(4100).selectExpr("concat('f', id) feature", "350.0 + id / 2 mz", "1.0 rt")
    held = slabs(rows, 30.0, (-1, 1))
    assert held.where("own").count() == 4100 and held.count() < 1.5 * 4100
    assert held.groupBy("feature", "slab").count().where("count > 1").isEmpty()


def test_edges_shuffle_few_copies_of_a_row(spark):
    """Of rows over many cells, under seven go through the shuffles of both joins for each row of the table, not ten."""
    rows = spark.range(6000).selectExpr("concat('f', id) feature", "350.0 + id * 0.34 mz", "60.0 + id * 7919 % 2040 rt")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    written = lambda: sum(s.shuffleWriteRecords() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)))
    limit, before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        pairs.redundancy_edges(rows, None).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert 6000 < written() - before < 7 * 6000
