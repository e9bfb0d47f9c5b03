"""Several values packed in one field: quote-aware splitting with positions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import once

# What may stand around a quoted span, what parts values, and texts that hold none.
_AROUND = r"\[\](){},;|/\s\x{FF0C}\x{FF1B}\x{3001}\x{A0}\x{3000}"
_SPAN = (
    rf"(?<![^{_AROUND}])"
    r"""(?:"[^"\\]*+(?:(?:\\.|"")[^"\\]*+)*+"|'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+')"""
    rf"(?![^{_AROUND}])"
)
_DELIMITER = r"[,;|\t\r\n\x{FF0C}\x{FF1B}\x{3001}]|(?<=[\s\x{A0}\x{3000}])/(?=[\s\x{A0}\x{3000}]|$)"
_OUTER = r"^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$"
_NOTHING = ("", "[]", "()", "{}", "nan", "None")
# Placeholder marks; an escape keeps them apart from the same characters in a text.
_OPEN, _CLOSE, _ESCAPE = "\ue000", "\ue001", "\ue002"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, _OUTER, "")


def _unwrap(c: Column) -> Column:
    """c without enclosing brackets; c is used twice, so it should be a plain column or lambda variable."""
    inner = c
    for a, b in ("[]", "()", "{}"):
        inner = F.regexp_replace(inner, rf"(?s)^\{a}([^\{a}\{b}]*)\{b}$", "$1")
    return F.when(F.substring(c, 1, 1).isin("[", "(", "{"), _strip(inner)).otherwise(c)


def _hide(c: Column) -> Column:
    for i, mark in enumerate((_ESCAPE, _OPEN, _CLOSE)):
        c = F.replace(c, F.lit(mark), F.lit(f"{_ESCAPE}{i}"))
    return c


def _show(c: Column) -> Column:
    shown = c
    for i, mark in ((2, _CLOSE), (1, _OPEN), (0, _ESCAPE)):
        shown = F.replace(shown, F.lit(f"{_ESCAPE}{i}"), F.lit(mark))
    return F.when(c.contains(_ESCAPE), shown).otherwise(c)


def _unquote(span: Column) -> Column:
    quote = F.substring(span, 1, 1)
    inner = F.substr(span, F.lit(2), F.length(span) - 2)
    return F.regexp_replace(F.replace(inner, F.concat(quote, quote), quote), r"""\\(["'\\])""", "$1")


def _mark(i: Column) -> Column:
    return F.concat(F.lit(_OPEN), i.cast("string"), F.lit(_CLOSE))


def split_packed(df: DataFrame, column: str, into: str = "items") -> DataFrame:
    """Add ``into``: the values of a packed text in order, as array<string>; an empty array where it holds none.

    Quoted spans are put aside under indexed placeholders that no text can contain (the marks are escaped first), the
    rest is split at any of the delimiters (comma, semicolon, bar, their wide forms, tab, line end, a slash between
    blanks, the blank between two quoted spans), and the spans are put back by array lookup. An apostrophe within a
    word opens no span. Values lose outer white space, enclosing brackets and quotes; escaped and doubled quotes are
    restored; empty values are dropped. Null, blank, ``[]``, ``nan`` and ``None`` texts hold no value.
    Each step is evaluated once per text; texts without quotes or brackets skip theirs.
    """
    text, spans, flat = f"__{into}_text", f"__{into}_spans", f"__{into}_flat"
    none = F.array().cast("array<string>")
    out = once(df, **{text: _strip(F.col(f"`{column}`"))})
    marked = F.when(F.col(text).rlike(f"[{_OPEN}{_CLOSE}{_ESCAPE}]"), _hide(F.col(text))).otherwise(F.col(text))
    out = once(out, **{text: F.when(~F.col(text).isin(*_NOTHING), marked)})
    out = once(out, **{spans: F.when(F.col(text).rlike("[\"']"), F.regexp_extract_all(F.col(text), F.lit(_SPAN), F.lit(0))).otherwise(none)})
    pieces = F.transform(F.split(F.col(text), _SPAN, -1), lambda x, i: F.when(i < F.size(spans), F.concat(x, _mark(i))).otherwise(x))
    out = once(out, **{flat: F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(F.col(text))})
    out = once(out, **{flat: _unwrap(F.col(flat))})
    parted = F.when(F.size(spans) > 0, F.regexp_replace(F.col(flat), rf"{_CLOSE}\s+{_OPEN}", f"{_CLOSE},{_OPEN}")).otherwise(F.col(flat))

    def restore(item: Column) -> Column:
        alone = F.regexp_extract(item, rf"^{_OPEN}(\d+){_CLOSE}$", 1)
        numbers = F.regexp_extract_all(item, F.lit(rf"{_OPEN}(\d+){_CLOSE}"), F.lit(1))
        inside = F.aggregate(numbers, item, lambda acc, i: F.replace(acc, _mark(i), F.get(F.col(spans), i.cast("int"))))
        whole = F.when(alone != "", _strip(_unquote(F.get(F.col(spans), alone.cast("int"))))).otherwise(inside)
        return F.when(item.contains(_OPEN), whole).otherwise(item)

    items = F.split(parted, _DELIMITER, -1)
    for step in (_strip, _unwrap, restore, _show):  # one transform each, so that a step's result is a variable of the next
        items = F.transform(items, step)
    items = F.filter(items, lambda x: x != "")
    return once(out, **{into: F.coalesce(items, none)}).drop(text, spans, flat)


def explode_packed(df: DataFrame, row_id: str, fields: Sequence[str], *, at_least: int = 1) -> DataFrame:
    """One row per value of the packed fields: row_id, field, pos (from 1), item.

    Values repeat as often as they are written. Only texts with ``at_least`` values are kept. Rows keep their own
    row_id, repeated or not.
    """
    texts = df.select(row_id, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("f")).select(row_id, "f.field", "f.text")
    rows = split_packed(texts.where(F.col("text").isNotNull()), "text").where(F.size("items") >= at_least)
    return rows.select(row_id, "field", F.posexplode("items").alias("pos", "item")).withColumn("pos", F.col("pos") + 1)
