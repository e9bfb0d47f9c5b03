"""Nulls in every column, clashing extra columns, repeated rows and empty tables through the dealt operators."""

import pytest

from matrica.llm.duplicates import collapse_duplicates, composition_key, letters_and_digits
from matrica.llm.encoding import encode_texts
from matrica.llm.groups import connected_groups
from matrica.llm.languages import document_languages, fit_languages, language_segments
from matrica.llm.mixing import Target, mix_sources
from matrica.llm.quantiles import grouped_quantiles
from matrica.llm.terms import ngram_counts

EXTRA = "key string, n bigint, part int, v double, lang2 string, hook string, degree int, row_id bigint, s string, e string, turn double, base int, n_tokens bigint"


@pytest.fixture(scope="module")
def odd(spark):
    extra = ("x", 1, 2, 3.0, "y", "z", 4, 5, "s", "e", 0.5, 6, 7)
    rows = [
        (1, "Ein Satz über Ventile und Kanäle der Vorrichtung.", "de", "a", ["p", None], *extra), (1, "Ein Satz über Ventile und Kanäle der Vorrichtung.", "de", "a", ["p", None], *extra),
        (2, None, None, None, None, *extra), (3, "", "", "", [], *extra), (None, "Words of a text without any number.", "en", "b", ["q"], *[None] * len(extra)), (5, "\x00\t ﻿", "xx", "c", [""], *extra),
    ]
    return spark.createDataFrame(rows, f"id bigint, text string, lang string, source string, terms array<string>, {EXTRA}")


def test_encoding_and_terms(odd):
    rows = encode_texts(odd, "id", "text").collect()
    assert len(rows) == 6 and sum(not r["ids"] for r in rows) == 2
    got = {tuple(r["ngram"]): (r["occurrences"], r["records"]) for r in ngram_counts(odd, "terms", max_n=2).collect()}
    assert got == {("p",): (2, 2), ("p", None): (2, 2), (None,): (2, 2), ("q",): (1, 1), ("",): (1, 1)}


def test_groups_and_duplicates(odd):
    assert {r["vertex"]: r["group"] for r in connected_groups(odd, "source", "lang").collect()} == {"a": "a", "de": "a", "b": "b", "en": "b", "c": "c", "xx": "c"}
    groups, members = collapse_duplicates(odd, "id", [letters_and_digits("text"), composition_key("lang")])
    assert sorted(r["copies"] for r in groups.collect()) == [1, 1, 1, 1, 2] and members.count() == 6


def test_quantiles_of_odd_keys(odd):
    got = {r["source"]: (r["value"], r["n"]) for r in grouped_quantiles(odd, ["source"], "v", [0.5]).collect()}
    assert got == {"a": (3.0, 2), None: (3.0, 1), "": (3.0, 1), "c": (3.0, 1)}


def test_languages_and_mixtures(odd):
    segments = language_segments(odd, "id", "text", fit_languages(odd, "text", "lang", key="id", min_documents=1))
    assert {(r["id"], r["lang"]) for r in segments.collect()} == {(1, "de"), (None, "en")}
    assert document_languages(segments, "id").count() == 2
    unlabelled = fit_languages(odd.where("false"), "text", "lang", key="id")
    assert language_segments(odd, "id", "text", unlabelled).count() == 0
    mixture = mix_sources(odd, "id", "text", "source", [Target("a", 0.7, 2), Target("b", 0.3, 1), Target("c", 0.0, 1)]).collect()
    assert {r["source"] for r in mixture} <= {"a", "b"} and all(r["copies"] <= 2 for r in mixture)
