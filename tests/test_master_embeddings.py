"""Sequence columns, binding tables, the canonical master, embedding suites, hand-over modes and loading."""

import numpy as np
import pytest

from matrica.operators import blocks, embeddings, filters, knn, master, sequences
from matrica.sources import spaces

SEQ = ["Neu5Ac(a2-3)Gal(b1-4)GlcNAc", "Man(a1-3)[Man(a1-6)]Man(b1-4)GlcNAc(b1-4)GlcNAc", "Fuc(a1-?)Gal", "GalNAc(b1-4)Gal"]


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_sequence_column_by_name_content_or_alone(spark):
    df = spark.createDataFrame([(1, "liver", SEQ[0]), (2, "blood", SEQ[1]), (3, "x", None)], "id int, organ string, txt string")
    assert sequences.find_sequence_column(df) == "txt"
    assert sequences.find_sequence_column(df.withColumnRenamed("organ", "IUPAC")) == "IUPAC"
    assert sequences.find_sequence_column(df.select("organ")) == "organ" and sequences.find_sequence_column(df.select("id", "organ")) is None
    out = sequences.standardise_sequences(df.selectExpr("*", "'f1' AS feature"), source_name="s", n_glycan=True)
    assert rows(out, "glycan_sequence", "feature", "is_n_glycan", "original_sequence_column") == [(SEQ[1], "f1", 1, "txt"), (SEQ[0], "f1", 1, "txt")]


def test_plausibility_and_families(spark):
    cases = {"Gal(b1-4)Glc": True, "[Homo_sapiens]": False, "[a][b]": False, "[Gal][b]": True, "abc": False, "x[y]": True, "blood(1)": False, None: False, " ": False, "WURCS=2.0": True}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r["s"]: r["p"] for r in df.withColumn("p", sequences.plausible_sequence("s")).collect()} == cases
    got = {r["s"]: r["f"] for r in spark.createDataFrame([(s,) for s in SEQ], "s string").withColumn("f", sequences.structural_families("s")).collect()}
    assert got == {SEQ[0]: ["sialylated"], SEQ[1]: ["N-glycan-like", "branched", "core-GlcNAc"], SEQ[2]: ["fucosylated", "ambiguous-linkage"], SEQ[3]: ["GalNAc-bearing"]}


def test_binding_tables_long_and_wide(spark):
    long = spark.createDataFrame([("g", "nan", 1.0), ("g", "p", 2.5), (None, "p", 1.0)], "Glycan string, lectin string, v double")
    assert rows(master.standardise_binding(long), "glycan_sequence", "protein", "binding_value") == [("g", "p", 2.5)]
    assert rows(master.standardise_binding(long.drop("v")), "binding_value") == [(1.0,)]
    wide = spark.createDataFrame([("p", 1.0, None), ("q", 3.0, 4.0)], "protein string, `a(b1-4)c` double, d double")
    assert rows(master.standardise_binding(wide), "glycan_sequence", "protein", "binding_value") == [("a(b1-4)c", "p", 1.0), ("a(b1-4)c", "q", 3.0), ("d", "q", 4.0)]
    with pytest.raises(ValueError, match="neither"):
        master.standardise_binding(long.select("Glycan"))


def canonical(spark, n=40):
    # Sequences of two kinds, whose composition and sequence tell them apart.
    data = [(f"{SEQ[1]}(a1-{i})X{i}" if i % 2 else f"{SEQ[3]}(b1-{i})Y{i}", "Hex: 5; HexNAc: 4" if i % 2 else "Gal 2 GalNAc 1", "['liver', 'blood']" if i % 2 else None, "Homo; Homo; Mus", None, i % 2, i % 3 == 0, 1) for i in range(n)]
    schema = "glycan_sequence string, composition string, tissue_sample string, tissue_species string, disease string, is_n_glycan int, in_query boolean, in_reference int"
    binding = spark.createDataFrame([(r[0], "P1" if i % 2 else "P2", float(i + 1)) for i, r in enumerate(data)], "glycan_sequence string, protein string, binding_value double")
    return master.canonical_features(spark.createDataFrame(data, schema), binding)


def test_canonical_master(spark):
    out = canonical(spark)
    first = out.where("canonical_sequence like '%Y0'").first()
    assert (first["tissue_species_norm"], first["tissue_sample_norm"], first["has_disease"], first["comp_Gal"], first["n_binding_rows"], first["discovered_flag"]) == ("Homo | Mus", None, 0, 2, 1, 1)
    summary = {r["metric"]: r["value"] for r in master.master_summary(out).collect()}
    assert summary["n_unique_sequences"] == 40 and summary["fraction_with_tissue_sample"] == 0.5 and summary["fraction_likely_n_glycan"] == 0.5
    kept = master.interpretation_set(out.unionByName(out))
    assert kept.count() == 40 and {r["metric"]: r["value"] for r in master.interpretation_summary(kept).collect()}["n_n_glycans"] == 20


def test_embedding_suite(spark):
    table = canonical(spark).selectExpr("*", "xxhash64(canonical_sequence) AS row_id")
    binding = table.selectExpr("row_id", "IF(is_n_glycan = 1, 'P1', 'P2') AS protein", "1.0D AS binding_value")
    suite = embeddings.build_suite(table, binding, "row_id", metadata_min_count=5, binding_min_rows=5)
    assert set(suite.candidates) == set(embeddings.CANDIDATES) and all(df.count() == 40 for df, _ in suite.candidates.values())
    scores = embeddings.evaluate_suite(suite, table, k=3)
    best = {r["embedding_name"]: r for r in scores.collect()}
    assert best["structure"]["n_glycan_knn_purity"] == 1.0 and best["structure"]["n_glycan_silhouette"] > 0.2 and best["structure"]["binding_jaccard"] == 1.0
    assert best["composition_only"]["species_labelled_anchors"] == 40 and best["composition_only"]["sample_labelled_anchors"] == 20
    assert embeddings.choose_embedding(scores) == "structure_metadata_binding" and embeddings.choose_embedding(scores, "none") in best
    universe = table.where("is_n_glycan = 1").select("row_id").unionByName(spark.createDataFrame([(1,)], "row_id bigint"))
    kept = embeddings.filter_suite(suite, universe)
    assert kept.candidates["structure"][0].count() == 21 and not any(kept.candidates["structure"][0].where("row_id = 1").first()["embedding"])
    baselines = embeddings.evaluate_baselines({"composition": suite.raw["composition"]}, table, "row_id", k=3).first()
    assert baselines["n_rows"] == 40 and baselines["purity_minus_prevalence"] == 0.5


def test_silhouette_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    x, label = rng.normal(size=(30, 3)), np.arange(30) % 2
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    want = []
    for i in range(30):
        a = d[i][(label == label[i]) & (np.arange(30) != i)].mean()
        b = d[i][label != label[i]].mean()
        want.append((b - a) / max(a, b))
    df = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(30)], "id int, label int, embedding array<double>")
    assert np.isclose(embeddings.sample_silhouette(df, "id", "label"), np.mean(want))
    assert embeddings.sample_silhouette(df.where("label = 1"), "id", "label") is None


def test_narrow_blocks_stay_as_they_are(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", -4.0), (3, "b", 0.0)], "id int, col string, val double")
    assert rows(blocks.reduce_block(df, "id", 5), "id", "embedding") == [(1, [0.5, 1.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])]


def test_index_finds_all_with_all_cells(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(60)] + [(100, None)], "vec_id bigint, embedding array<double>")
    exact, centres = knn.cosine_neighbours(df, df, 3), knn.fit_cells(df, 4)
    assert knn.recall(exact, knn.indexed_neighbours(df, df, 3, centres, 4, block=8)).first()["recall"] == 1.0
    assert knn.recall(exact, knn.indexed_neighbours(df, df, 3, centres, 1)).first()["recall"] < 1.0


def test_balanced_sample_is_exact(spark):
    df = spark.range(3000).selectExpr("id", "IF(id < 40, 'a', IF(id < 2990, 'b', NULL)) AS label")
    got = {r["label"]: r["count"] for r in master.balanced_sample(df, "label", key="id", n=50).groupBy("label").count().collect()}
    assert got == {"a": 40, "b": 50}


def test_handoff_modes(spark):
    query = spark.createDataFrame([("f1", "s1"), ("f2", "s2")], "feature string, glycan_sequence string")
    target = spark.createDataFrame([("f1", "s2", "high"), ("f1", "s2", "a")], "feature string, glycan_sequence string, target_tier string")
    assert master.handoff(query, None)[1] == "provisional" and master.handoff(query, target.select("target_tier"))[1] == "no_mapping"
    out, mode = master.handoff(query, target)
    assert mode == "id" and rows(out, "feature", "target_tier") == [("f1", "a"), ("f2", None)]
    out, mode = master.handoff(query, target.drop("feature"))
    assert mode == "sequence" and rows(out, "feature", "target_tier") == [("f1", None), ("f2", "a")]


def test_spaces_prefer_annotated_manifests(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("s1",), ("s2",)], "sample string").write.csv(f"{folder}/retained_sample_manifest.csv", header=True)
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "feature string, mz double").write.parquet(f"{folder}/retained_feature_manifest_main.parquet")
    spark.createDataFrame([("b",)], "feature string").write.parquet(f"{folder}/retained_feature_manifest_high.parquet")
    obs = spark.createDataFrame([(s, f, float(i)) for i, s in enumerate(("s1", "s2", "s3")) for f in "abc"], "sample string, feature string, intensity double")
    size = lambda: {r["space"]: r["count"] for r in spaces.load_spaces(spark, folder, obs, obs)["cells"].groupBy("space").count().collect()}
    assert size() == {"main": 4, "high": 2, "representative": 4}
    spark.createDataFrame([("a", 1.0, True), ("b", 2.0, False)], "feature string, mz double, is_representative boolean").write.parquet(f"{folder}/retained_feature_manifest_main_annotated.parquet")
    assert size() == {"main": 4, "high": 2, "representative": 2}
    assert spaces.load_optional(spark, folder, ["nothing"]) is None
    with pytest.raises(FileNotFoundError):
        spaces.load_inputs(spark, folder)


def test_decisions_fill_features_that_were_not_modelled(spark):
    filtered = spark.createDataFrame([("a", True), ("b", False)], "feature string, retained_main boolean")
    annotated = spark.createDataFrame([("a", "a", 2, "representative", 1)], "feature string, cluster string, cluster_size int, redundancy_role string, n_isomer int")
    got = rows(filters.decision_table(filtered, annotated), "feature", "cluster_size", "is_representative", "redundancy_role", "n_isomer")
    assert got == [("a", 2, True, "representative", 1), ("b", 1, False, "not_modeled", 0)]


def test_composition_features_of_long_texts(spark):
    text = "x" * 200_000 + " Hex: 2"
    out = sequences.composition_features(spark.createDataFrame([(1, text), (2, "Hex5HexNAc: 3"), (3, None)], "id int, c string"), "id", "c").collect()
    assert {r["id"]: (r["comp_Hex"], r["comp_total_residues"]) for r in out} == {1: (2, 2), 2: (0, 3), 3: (0, 0)}
