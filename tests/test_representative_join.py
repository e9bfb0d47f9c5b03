"""Members of few clusters are not shuffled to meet their representative."""

from pyspark.sql import functions as F

from matrica.operators import pairs


def test_few_clusters_are_broadcast(spark, monkeypatch):
    members = spark.range(60).selectExpr("concat('f', lpad(id, 2, '0')) feature", "if(id < 50, 'a', concat('s', id)) cluster", "if(id = 3, null, double(60 - id)) size")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (11, 10):
            monkeypatch.setattr(pairs, "BROADCAST_ROWS", most)
            out = pairs.pick_representatives(members, [F.col("size").isNull(), F.col("size")])
            got = {r["feature"]: (r["cluster_size"], r["representative_feature"], r["redundancy_role"]) for r in out.collect()}
            assert got == {f"f{i:02d}": (50, "f49", "representative" if i == 49 else "member") if i < 50 else (1, f"f{i}", "singleton") for i in range(60)}
            assert ("hashpartitioning(cluster" in out._jdf.queryExecution().executedPlan().toString()) == (most == 10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
