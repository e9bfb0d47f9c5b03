"""Duplicates hidden by formatting: canonical keys, and two-level aggregation of the hot ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import HOT_ROWS, let
from matrica.operators.sequences import COMPOSITION_ITEM
from matrica.session import cut_lineage

#: Parts into which the rows of a hot key are salted.
SALTS = 64


def letters_and_digits(column: str) -> Column:
    """A text's letters and digits in lower case; NULL stays NULL, a text without any is ''."""
    return F.regexp_replace(F.lower(F.col(column)), r"[^\p{L}\p{N}]+", "")


def composition_key(column: str) -> Column:
    """The names (in lower case) of a composition text with their summed counts, sorted; '' for null and blank texts.

    A text without any counted name is represented by its letters and digits. Counts lose leading zeros; repeated
    names whose counts have over 36 digits are joined by '+' instead of summed. Each part is evaluated once.
    """
    plain = F.concat(F.lit("?"), letters_and_digits(column))
    number = lambda n: F.regexp_replace(n, r"^0+(?=\d)", "")

    def summed(pairs: Column, names: Column) -> Column:
        def item(name: Column) -> Column:
            own = F.filter(pairs, lambda p: p["name"] == name)
            total = F.aggregate(own, F.lit(0).cast("decimal(38,0)"), lambda acc, p: (acc + p["n"].try_cast("decimal(36,0)")).cast("decimal(38,0)"))
            digits = F.array_join(F.array_sort(F.transform(own, lambda p: p["n"])), "+")
            return F.concat(name, F.lit("="), F.coalesce(total.cast("string"), digits))

        return F.transform(F.array_sort(names), item)

    def of_pairs(pairs: Column) -> Column:
        each = F.transform(F.array_sort(pairs), lambda p: F.concat(p["name"], F.lit("="), p["n"]))
        items = let(F.array_distinct(pairs["name"]), lambda names: F.when(F.size(names) == F.size(pairs), each).otherwise(summed(pairs, names)))
        return F.when(F.size(pairs) > 0, F.array_join(items, ";")).otherwise(plain)

    def of_text(text: Column) -> Column:
        part = lambda i: F.regexp_extract_all(text, F.lit(COMPOSITION_ITEM), F.lit(i))
        return let(F.arrays_zip(part(1).alias("name"), F.transform(part(2), number).alias("n")), of_pairs)

    blank = F.col(column).isNull() | ~F.col(column).rlike(r"\S")
    return F.when(blank, "").otherwise(let(F.lower(F.col(column)), of_text))


def collapse_duplicates(df: DataFrame, row_id: str, key_columns: Sequence[Column], *, hot_limit: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of rows with equal canonical keys.

    groups: key, first_id (the smallest row_id) and copies. members: row_id and first_id of every row. The key is
    the SHA-256 of the key columns, NULL told apart from ''. Partial counts find the keys with more than
    ``hot_limit`` rows exactly, at most rows/hot_limit of them, so they may be broadcast; their rows are aggregated
    by key and salt first and joined to their group without a shuffle. The others take one shuffle by key.
    Repeated rows count as copies; an empty table gives no groups.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.sha2(c, 256)), F.lit("n"))
    rows = df.select(F.col(row_id).alias("row_id"), F.unhex(F.sha2(F.concat_ws("|", *map(part, key_columns)), 256)).alias("key"))
    rows = cut_lineage(rows)  # the keys are read several times, and computed once
    hot = cut_lineage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_limit).select("key"))
    first = [F.min("first_id").alias("first_id"), F.sum("copies").alias("copies")]
    start = [F.min("row_id").alias("first_id"), F.count(F.lit(1)).alias("copies")]
    if hot.isEmpty():
        groups = rows.groupBy("key").agg(*start)
        members = rows.join(groups.where("copies > 1").select("key", "first_id"), "key", "left")
        return groups, members.select("row_id", F.coalesce("first_id", "row_id").alias("first_id"))
    cold_rows = rows.join(F.broadcast(hot), "key", "left_anti")
    hot_rows = rows.join(F.broadcast(hot), "key", "left_semi")
    cold = cold_rows.groupBy("key").agg(*start)
    salted = hot_rows.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)))
    warm = salted.groupBy("key", "salt").agg(*start).groupBy("key").agg(*first)
    members = cold_rows.join(cold.where("copies > 1").select("key", "first_id"), "key", "left").unionByName(hot_rows.join(F.broadcast(warm.select("key", "first_id")), "key"))
    return cold.unionByName(warm), members.select("row_id", F.coalesce("first_id", "row_id").alias("first_id"))
