"""Keys of binding sequences are made once a sequence, whatever its rows."""

from pyspark.sql import functions as F

from matrica.operators import master
from matrica.operators.sequences import canonical_exact


def test_keys_are_made_after_rows_are_summed(spark):
    data = [("Gal(b1-4)Glc", "p", 1.0), (" Gal(b1-4)Glc", "p", 4.0), ("Gal(b1-4)Glc", "q", None), ("Man", "p", 2.5), (None, "p", 7.0)]
    binding = spark.createDataFrame([r for r in data for _ in range(3)], "glycan_sequence string, protein string, binding_value double")
    columns = "glycan_sequence string, composition string, tissue_sample string, tissue_species string, disease string, is_n_glycan int, in_query int, in_reference int"
    one = lambda s: (s, None, None, None, None, 0, 1, 0)
    out = master.canonical_features(spark.createDataFrame([one("Gal(b1-4)Glc"), one("Man"), one("Fuc"), one("Gal(a1-3)Glc")], columns), binding)
    got = {r["glycan_sequence"]: (r["n_binding_rows"], r["n_binding_proteins"], r["mean_binding_value"], r["max_binding_value"], r["n_binding_rows_topology"], r["n_binding_proteins_topology"]) for r in out.collect()}
    assert got == {"Gal(b1-4)Glc": (9, 2, 2.5, 4.0, 9, 2), "Man": (3, 1, 2.5, 2.5, 3, 1), "Fuc": (0, 0, 0.0, 0.0, 0, 0), "Gal(a1-3)Glc": (0, 0, 0.0, 0.0, 9, 2)}
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    keys = {"canonical_sequence": counted(canonical_exact("glycan_sequence"))}
    assert master._bound(binding, keys).count() == 5 and seen.value == 4  # four sequences, one of two proteins
