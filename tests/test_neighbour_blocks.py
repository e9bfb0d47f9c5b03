"""Rows of neighbour counts go through the shuffles as packed blocks."""

import math

from matrica.operators import pairs, rectangles


def test_counts_shuffle_few_bytes(spark):
    """Under 20 bytes of shuffles for each row of the table, not over 30: names, masses and times are sent as compressed columns."""
    n = 20_000
    rows = spark.range(n).selectExpr("concat('FT-', lpad(id, 9, '0')) feature", "round(350 + pmod(xxhash64(id), 20500000) / 10000, 4) mz", "round(60 + pmod(xxhash64(id, 1), 204000) / 100, 2) rt")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    written = lambda: sum(s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)))
    before = written()
    pairs.range_neighbours(rows).write.format("noop").mode("overwrite").save()
    assert 0 < written() - before < 20 * n


def test_blocks_hold_the_rows_as_they_were(spark):
    inf, nan = float("inf"), float("nan")
    odd = [(1, "a", 0.1, inf), (1, None, 1 / 3, nan), (2, "", 1e300, None), (2, "b", -2.5, 0.3), (3, "c", 2399.9999, 7.25), (3, "d", 0.1 + 0.2, -1e-9)]
    rows = spark.createDataFrame([(s, f"{f}{i}" if f else f, x, y) for i in range(50) for s, f, x, y in odd], "slab bigint, feature string, mz double, rt double")
    found = rectangles.packed(rows, "slab", ["mz", "rt"], most=1).toArrow()
    assert found.num_rows > 3
    got = [(s, *row.values()) for s, b in zip(found["slab"].to_pylist(), found["block"]) for row in rectangles.unpacked([b]).to_pylist()]
    plain = lambda t: sorted(tuple("nan" if isinstance(x, float) and math.isnan(x) else str(x) for x in r) for r in t)
    assert plain(got) == plain(tuple(r) for r in rows.collect())


def test_rows_of_one_feature_in_many_slabs_and_buckets(spark, monkeypatch):
    """Counts of a name with several rows are one sum, in whatever slabs they are; a missing name is a name as well."""
    monkeypatch.setattr(rectangles, "BUCKET_ROWS", 50)
    data = [(None if i % 97 == 0 else f"f{i % 300:03d}", 400.0 + i * 0.37, float(i * 7919 % 200)) for i in range(900)]
    df = spark.createDataFrame(data, "feature string, mz double, rt double").repartition(3)
    row = lambda r: (r["feature"] or "", *[r[f"n_{k}"] for k in pairs.RELATIONS])
    want = pairs.neighbour_counts(pairs.redundancy_edges(df)).collect()
    assert sorted(map(row, pairs.range_neighbours(df).collect())) == sorted(map(row, want)) and len(want) == 301
