"""lineitem goes through no shuffle to meet its parts, as long as these are few."""

from matrica.plans import model


def test_parts_are_broadcast_up_to_their_limit(spark, monkeypatch, tmp_path):
    tables = {
        "nation": ([(0, 0)], "n_nationkey int, n_regionkey int"), "region": ([(0, "ASIA")], "r_regionkey int, r_name string"), "supplier": ([(1, 0), (2, 0)], "s_suppkey bigint, s_nationkey int"),
        "part": ([(i, f"B{i % 2}") for i in range(10)], "p_partkey bigint, p_brand string"),
        "lineitem": ([(1 + i % 2, i % 12, 997.0, 0.0) for i in range(48)], "l_suppkey bigint, l_partkey bigint, l_extendedprice double, l_discount double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plans, cut = [], model.cut_lineage
    monkeypatch.setattr(model, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (10, 9):
            monkeypatch.setattr(model, "PARTS", most)
            out = model.observations(spark, str(tmp_path))
            assert {(r["sample"], r["feature"]): r["intensity"] for r in out.collect()} == {(1, "B0"): 20.0, (2, "B1"): 20.0}
            assert ("hashpartitioning(l_partkey" in plans[-1]) == (most == 9)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
