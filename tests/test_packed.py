"""Packed fields: every notation, and a round trip of written values."""

import random

import pytest

from matrica.operators.packed import explode_packed, split_packed

CASES = [
    ("['a', 'b']", ["a", "b"]), ("('a',)", ["a"]), ("{'a', 'b'}", ["a", "b"]), ('["bird\'s nest", \'b\']', ["bird's nest", "b"]),
    ("a; b; ; c;", ["a", "b", "c"]), ("a|b | c", ["a", "b", "c"]), ("a / b / ", ["a", "b"]), ("lung (upper/lower)", ["lung (upper/lower)"]),
    ("calf's skin, bird's nest", ["calf's skin", "bird's nest"]), ("['a' 'b'\n 'c']", ["a", "b", "c"]), ('"gut ""mid"" part" | "x"', ['gut "mid" part', "x"]),
    (r'["gut \"mid\" part"]', ['gut "mid" part']), ("['serum, pooled', 'x; y']", ["serum, pooled", "x; y"]), ("a\tb\nc", ["a", "b", "c"]), ("a，b；c", ["a", "b", "c"]),
    ("a, a", ["a", "a"]), ("['', 'a', '']", ["a"]), ("", []), (None, []), ("  ", []), ("[]", []), ("nan", []), ("None", []), ("  x ", ["x"]),
    ("\ue0000\ue001, 'q, r'", ["\ue0000\ue001", "q, r"]), ("\ue0021; 'x'", ["\ue0021", "x"]), ("say \"hi, all\" now, b", ['say "hi, all" now', "b"]),
]


def test_cases(spark):
    rows = split_packed(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id int, text string"), "text").collect()
    assert {r["id"]: r["items"] for r in rows} == {i: want for i, (_, want) in enumerate(CASES)}


@pytest.mark.parametrize("style", ["python", "csv"])
def test_round_trip(spark, style):
    rng = random.Random(1)
    words = ["a b", "x, y", "p; q | r", "it's", 'the "k" one', "u / v", "plain", "(z)/w"]
    rows = [(i, [rng.choice(words) for _ in range(rng.randint(2, 9))]) for i in range(200)]
    write = repr if style == "python" else lambda values: rng.choice([", ", ";", " | "]).join('"' + v.replace('"', '""') + '"' for v in values)
    df = spark.createDataFrame([(i, write(v)) for i, v in rows], "id int, text string")
    got = {}
    for r in explode_packed(df, "id", ["text"]).orderBy("id", "pos").collect():
        got.setdefault(r["id"], []).append(r["item"])
    assert got == dict(rows)


def test_positions_limits_and_long_texts(spark):
    df = spark.createDataFrame([(1, "a, , b", "x"), (1, "a, , b", None), (2, ",".join(["v"] * 50_000), "p|q")], "id bigint, f string, pos string")
    rows = explode_packed(df, "id", ["f", "pos"], at_least=2)
    assert rows.columns == ["id", "field", "pos", "item"]
    assert sorted((r["pos"], r["item"]) for r in rows.where("id = 1").collect()) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]
    assert rows.where("id = 2 and field = 'f'").count() == 50_000
    assert explode_packed(df.limit(0), "id", ["f"]).count() == 0


def test_escaped_quotes_in_long_texts(spark):
    text = '"' + 'a ""b"" ' * 400 + '", "c"'
    items = split_packed(spark.createDataFrame([(text, "kept")], "text string, spans string"), "text").first()
    assert items["items"] == [('a "b" ' * 400).strip(), "c"] and items["spans"] == "kept"
