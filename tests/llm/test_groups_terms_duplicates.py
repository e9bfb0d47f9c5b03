"""Groups, term counts and hidden duplicates against brute force."""

import random
from collections import Counter

import pytest

from matrica.llm.duplicates import collapse_duplicates, composition_key, letters_and_digits
from matrica.llm.groups import connected_groups
from matrica.llm.terms import mark_terms, ngram_counts


@pytest.mark.parametrize("hot_limit", [10**9, 5])
def test_groups_match_union_find(spark, hot_limit):
    rng = random.Random(6)
    names = [f"F{i:04d}" for i in range(300)]
    pairs = [(rng.choice(names[:200]), rng.choice(names[:200])) for _ in range(110)] + [(names[i + 1], names[i]) for i in range(200, 280)] + [("F0299", n) for n in names[285:298]]
    pairs += [(names[0], None), (None, None), (names[284], names[284]), pairs[0], pairs[0][::-1]]
    parent = {n: n for n in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a and b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    linked = {n for a, b in pairs if a and b and a != b for n in (a, b)}
    got = connected_groups(spark.createDataFrame(pairs, "feature string, vertex string"), "feature", "vertex", hot_limit=hot_limit)
    assert {r["vertex"]: r["group"] for r in got.collect()} == {n: find(n) for n in linked}
    assert connected_groups(spark.createDataFrame([("a", "a")], "a string, b string"), "a", "b").count() == 0


@pytest.mark.parametrize("max_n", [1, 3])
def test_ngram_counts_match_brute_force(spark, max_n):
    rng = random.Random(7)
    records = [[rng.choice("aabbbcd") for _ in range(rng.randint(0, 9))] for _ in range(300)] + [["hot"]] * 400 + [None, [], ["x"] * 200]
    occurrences, holders = Counter(), Counter()
    for r in records:
        grams = [tuple(r[i : i + n]) for n in range(1, max_n + 1) for i in range(len(r) - n + 1)] if r else []
        occurrences.update(grams)
        holders.update(set(grams))
    df = spark.createDataFrame([(r, "extra") for r in records], "terms array<string>, ngram string").repartition(6)
    got = {tuple(r["ngram"]): (r["occurrences"], r["records"], r["n"]) for r in ngram_counts(df, "terms", max_n=max_n).collect()}
    assert got == {g: (occurrences[g], holders[g], len(g)) for g in occurrences}
    assert ngram_counts(df.limit(0), "terms", max_n=max_n).count() == 0


def test_marks_at_their_limits(spark):
    counts = spark.createDataFrame([("a", 2), ("b", 3), ("c", 40), ("d", 41)], "term string, records bigint")
    got = {r["term"]: r["mark"] for r in mark_terms(counts, spark.createDataFrame([(100,)], "total bigint")).collect()}
    assert got == {"a": "rare", "b": None, "c": None, "d": "common"}


SAME = ["{'Hex': 5, 'HexNAc': 4}", '{"HEXNAC":4,"hex":5}', "hex=5;hexnac=4", "Hex(5)HexNAc(4)", "HexNAc 4 Hex 5", "[('HexNAc', 4), ('Hex', 5)]", "HEX : 5 | HEXNAC : 4.", "Hex:5, HexNAc:04", "Hex:2, HexNAc:4, Hex:3"]


def test_composition_notations(spark):
    texts = [*SAME, "Hex:5", None, " \t", "", "Neu5Ac(1)Xem297(2)", "unknown", "UN-KNOWN"]
    keys = [r["k"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").select("i", composition_key("c").alias("k")).orderBy("i").collect()]
    assert set(keys[: len(SAME)]) == {"hex=5;hexnac=4"}
    assert keys[len(SAME) :] == ["hex=5", "", "", "", "neu5ac=1;xem297=2", "?unknown", "?unknown"]


@pytest.mark.parametrize("hot_limit", [10**9, 3])
def test_duplicates_collapse(spark, hot_limit):
    glycans = ["Gal(b1-4)Glc", "GAL b1−4 glc", "gal（b1-4）glc.", "Gal(b1-3)Glc", None, "", "..."]
    rng = random.Random(8)
    data = [(i, rng.choice(glycans), rng.choice([*SAME[:3], None, " ", "Hex:1"])) for i in range(200, 0, -1)] + [(1, "Gal(b1-4)Glc", SAME[0])]
    canonical = {"Gal(b1-3)Glc": "galb13glc", None: None, "": "", "...": ""}
    comp = lambda c: "" if c is None or not c.strip() else "h1" if c == "Hex:1" else "same"
    groups = {}
    for i, g, c in data:
        groups.setdefault((canonical.get(g, "galb14glc"), comp(c)), []).append(i)
    df = spark.createDataFrame([(*r, 0) for r in data], "gly_id bigint, glycan string, composition string, key int")
    got, members = collapse_duplicates(df, "gly_id", [letters_and_digits("glycan"), composition_key("composition")], hot_limit=hot_limit)
    assert sorted((r["first_id"], r["copies"]) for r in got.collect()) == sorted((min(x), len(x)) for x in groups.values())
    assert sorted((r["row_id"], r["first_id"]) for r in members.collect()) == sorted((i, min(x)) for x in groups.values() for i in x)
    assert collapse_duplicates(df.limit(0), "gly_id", [letters_and_digits("glycan")])[0].count() == 0
