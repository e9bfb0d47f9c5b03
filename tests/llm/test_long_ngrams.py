"""n-grams of every length against brute force."""

import random
from collections import Counter

from matrica.llm.terms import ngram_counts


def test_ngrams_of_every_length(spark, tmp_path):
    rng = random.Random(6)
    data = [[rng.choice(["a", "b", None]) for _ in range(rng.randint(0, 9))] for _ in range(60)] + [["a"] * 7, None]
    occurrences, records = Counter(), Counter()
    for terms in data:
        own = Counter(tuple(terms[i:j]) for i in range(len(terms or [])) for j in range(i + 1, len(terms) + 1))
        occurrences += own
        records += Counter(own.keys())
    got = {tuple(r["ngram"]): (r["n"], r["occurrences"], r["records"]) for r in ngram_counts(spark.createDataFrame([(x,) for x in data], "t array<string>"), "t").collect()}
    assert got == {g: (len(g), occurrences[g], records[g]) for g in occurrences} and max(map(len, got)) == 9


def test_query_keeps_long_ngrams(spark, tmp_path):
    from matrica.llm import queries

    row = [(1, "Hex: 5; HexNAc: 4; Fuc: 1; Neu5Ac: 2", None)]
    spark.createDataFrame(row, "gly_id bigint, composition string, tissue_species string").write.parquet(f"{tmp_path}/glycan_list.parquet")
    assert "hex | hexnac | fuc | neu5ac" in {r["term"] for r in queries.p5_ngrams(spark, str(tmp_path)).collect()}
    assert {r["term"] for r in queries.p5_terms(spark, str(tmp_path)).collect()} == {"hex", "hexnac", "fuc", "neu5ac"}
