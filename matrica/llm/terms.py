"""Frequency of every distinct term and n-gram, from sorted suffixes and common-prefix intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import let, once


def sorted_suffixes(records: DataFrame, tokens: str, max_n: int | None = None) -> DataFrame:
    """suffix (whole, or at most max_n tokens), shared, weight: all suffixes of all records.

    Within each record the suffixes are sorted; ``shared`` is the length of the prefix that a suffix has in common
    with its predecessor of the same record, so every prefix up to that length is a repetition within the record.
    Equal rows are counted together before any sorting, so a hot term is one row.
    """
    cut = F.transform(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.slice(F.col(tokens), i, F.size(tokens) if max_n is None else F.lit(max_n)))
    rows = once(records.select(F.col(tokens).alias(tokens)), **{tokens: F.col(tokens)}).where(F.size(tokens) > 0)
    rows = once(rows, s=F.array_sort(cut))

    def common(x, i):  # noqa: ANN001, ANN202
        def with_before(before):  # noqa: ANN001, ANN202
            length = F.least(F.size(x), F.size(before))
            differs = F.array_position(F.zip_with(x, before, lambda a, b: a.eqNullSafe(b)), False)
            return let(differs, lambda d: F.when((d > 0) & (d <= length), d - 1).otherwise(length))

        return F.when(i > 0, let(F.get(F.col("s"), i - 1), with_before)).otherwise(0).cast("int")

    each = F.transform("s", lambda x, i: F.struct(x.alias("suffix"), common(x, i).alias("shared")))
    return rows.select(F.explode(each).alias("e")).groupBy("e.suffix", "e.shared").agg(F.count(F.lit(1)).alias("weight"))


def ngram_counts(records: DataFrame, tokens: str, *, max_n: int | None = None) -> DataFrame:
    """ngram (array), n, occurrences, records of every n-gram of an array column, of any length or
    of up to max_n tokens.

    The distinct suffixes are range-partitioned and sorted. Each task walks them once; where the common prefix with
    the predecessor falls below k, the interval of one k-gram ends and its occurrences and within-record
    repetitions are summed. Intervals that cross a border are joined by a sum over equal n-grams. records =
    occurrences less within-record repetitions. Null arrays and empty arrays hold nothing; null tokens count as a
    token of their own.
    """
    suffixes = sorted_suffixes(records, tokens, max_n)

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple = ()
        occurrences: list[int] = []
        repeats: list[int] = []
        for pdf in batches:
            done = []
            for suffix, shared, weight in zip(pdf["suffix"], pdf["shared"], pdf["weight"]):
                suffix = tuple(suffix)
                common = 0
                while common < min(len(last), len(suffix)) and last[common] == suffix[common]:
                    common += 1
                for k in range(common, len(last)):
                    done.append((list(last[: k + 1]), k + 1, occurrences[k], repeats[k]))
                    occurrences[k] = repeats[k] = 0
                deeper = [0] * (len(suffix) - len(occurrences))
                occurrences += deeper
                repeats += deeper
                for k in range(len(suffix)):
                    occurrences[k] += weight
                    repeats[k] += weight if k < shared else 0
                last = suffix
            yield pd.DataFrame(done, columns=["ngram", "n", "occurrences", "repeats"])
        yield pd.DataFrame([(list(last[: k + 1]), k + 1, occurrences[k], repeats[k]) for k in range(len(last))], columns=["ngram", "n", "occurrences", "repeats"])

    walked = suffixes.repartitionByRange("suffix").sortWithinPartitions("suffix", "shared").mapInPandas(intervals, "ngram array<string>, n int, occurrences bigint, repeats bigint")
    return walked.groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), (F.sum("occurrences") - F.sum("repeats")).alias("records"))


def mark_terms(counts: DataFrame, total_records: DataFrame, *, rare_below: int = 3, common_above: float = 0.4) -> DataFrame:
    """Add mark: 'rare' under ``rare_below`` records, 'common' over ``common_above`` of all, else NULL.

    total_records: one row with the number of all records in ``total``.
    """
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("total") * common_above, "common")
    return counts.crossJoin(F.broadcast(total_records)).withColumn("mark", mark).drop("total")
