"""References to records that do not exist: direct orphans and their inherited followers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.functions.keys import HOT_ROWS, hot_keys, join_skewed, tidy_key
from matrica.operators.spikes import cut_pieces
from matrica.session import cut_lineage

@dataclass(frozen=True)
class Relation:
    """A table of the foreign-key graph. key: the column by which others refer to it. at: its reference time."""

    name: str
    df: DataFrame
    row_id: str
    key: str | None = None
    at: str | None = None
    valid_from: str | None = None
    valid_to: str | None = None


@dataclass(frozen=True)
class Reference:
    """``child.column`` names rows of ``parent`` by parent's key, at child's reference time if parent has validity."""

    child: str
    column: str
    parent: str


def coverage_gaps(refs: DataFrame, spans: DataFrame, hot_limit: int = HOT_ROWS) -> DataFrame:
    """The references whose key no span covers at the reference time.

    refs: key, at and further columns; spans: key, start, end (null: open). A span covers start <= at < end; spans
    without start, or that end before they start, cover nothing; a null ``at`` is covered by nothing.
    Starts count +1 and ends -1, so a running balance in time order tells whether any span is open, without a join
    of the many spans of a key with its many references. For keys with more than ``hot_limit`` rows the changes are
    first summed per time, so a bulk load of one time is one row; the times are cut into pieces of equal counts, which
    get the balance in two levels, and the references take it by a join that splits hot times.
    """
    keep = [c for c in refs.columns if c not in ("key", "at")]
    events = (
        spans.where(F.col("start").isNotNull() & F.col("key").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
        .select("key", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("delta")))).alias("e"))
        .select("key", "e.*")
        .where("t is not null")
        .groupBy("key", "t")
        .agg(F.sum("delta").alias("delta"))
    )
    payload = F.struct(*keep) if keep else F.struct(F.lit(1).alias("one"))
    asked = refs.where("at is not null and key is not null").select("key", F.col("at").alias("t"), payload.alias("row"))
    both = asked.withColumn("delta", F.lit(0).cast("bigint")).unionByName(
        events.select("key", "t", F.col("delta").cast("bigint").alias("delta")), allowMissingColumns=True
    )
    in_time = [F.col("t"), F.col("row").isNotNull()]
    upto = (Window.unboundedPreceding, Window.currentRow)

    hot = cut_lineage(hot_keys(both.select("key"), ["key"], hot_limit))
    any_hot = not hot.isEmpty()
    cold = both.join(F.broadcast(hot), "key", "left_anti") if any_hot else both
    balance = F.sum("delta").over(Window.partitionBy("key").orderBy(*in_time).rowsBetween(*upto))
    missing = cold.withColumn("open", balance).where("row is not null and open <= 0").select("key", F.col("t").alias("at"), "row")
    if any_hot:
        warm = cut_lineage(both.join(F.broadcast(hot), "key", "left_semi"))
        times = warm.groupBy("key", "t").agg(F.sum("delta").alias("net"))
        times = cut_pieces(times, "t", hot_limit, series="key")
        pieces = times.groupBy("key", "piece").agg(F.sum("net").alias("sum"))
        before = F.sum("sum").over(Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
        within = F.sum("net").over(Window.partitionBy("key", "piece").orderBy("t").rowsBetween(*upto))
        opening = pieces.select("key", "piece", F.coalesce(before, F.lit(0)).alias("opening"))
        shut = times.withColumn("open", within).join(opening, ["key", "piece"]).where("open + opening <= 0").select("key", "t")
        missing = missing.unionByName(join_skewed(warm.where("row is not null"), shut, ["key", "t"], limit=hot_limit).select("key", F.col("t").alias("at"), "row"))
    out = missing.select("key", "at", *([f"row.{c}" for c in keep] if keep else []))
    return out.unionByName(refs.where("at is null and key is not null").select("key", "at", *keep))


def orphan_cascade(relations: Sequence[Relation], references: Sequence[Reference], *, hot_limit: int = HOT_ROWS) -> DataFrame:
    """Rows that refer to missing records: table_name, ref_period ('YYYY-MM'), row_id, kind, depth, parent.

    Direct orphans (depth 1) name a key that the parent table lacks, or lacks at the reference time. Then the orphan
    set is carried down the foreign-key graph: a row whose key is held by the parent only in orphaned rows is an
    inherited orphan, one level deeper than its parent; rounds go on until one finds nothing new.
    Defined cases: null and blank keys refer to nothing and are never orphans; a null reference time is covered by no
    validity span, so the row is a direct orphan with a null period; repeated rows are each reported; a row that
    several references make an orphan is reported once with the smallest depth; an empty parent orphans every row.
    """
    tables = {r.name: r for r in relations}
    no_time = F.lit(None).cast("timestamp_ntz")

    def child_rows(ref: Reference) -> DataFrame:
        child = tables[ref.child]
        at = F.col(child.at).cast("timestamp_ntz") if child.at else no_time
        return child.df.select(tidy_key(ref.column).alias("key"), at.alias("at"), F.lit(child.name).alias("table_name"), F.col(child.row_id).cast("bigint").alias("row_id"), F.lit(ref.parent).alias("parent")).where("key is not null")

    by_parent: dict[str, list[Reference]] = defaultdict(list)
    for ref in references:
        by_parent[ref.parent].append(ref)
    found = []
    for name, refs in by_parent.items():
        parent = tables[name]
        rows = reduce(DataFrame.unionByName, map(child_rows, refs))
        if parent.valid_from:
            spans = parent.df.select(tidy_key(parent.key).alias("key"), F.col(parent.valid_from).cast("timestamp_ntz").alias("start"), F.col(parent.valid_to).cast("timestamp_ntz").alias("end"))
            found.append(coverage_gaps(rows, spans, hot_limit))
        else:
            known = parent.df.select(tidy_key(parent.key).alias("key")).where("key is not null").distinct()
            found.append(rows.join(known, "key", "left_anti").select("key", "at", *rows.columns[2:]))
    columns = ["table_name", "row_id", "at", "parent"]
    orphans = reduce(DataFrame.unionByName, found).select(*columns, F.lit("direct").alias("kind"), F.lit(1).alias("depth"))

    inner = [r for r in references if any(x.child == r.parent for x in references)]
    if inner:  # only tables that are parent and child can hand a missing parent on
        orphans = new = cut_lineage(orphans)
        # Of every such parent: its rows' keys, and how many of a key's rows are no orphans yet.
        owned, alive = {}, {}
        for name in {r.parent for r in inner}:
            parent = tables[name]
            owned[name] = cut_lineage(parent.df.select(tidy_key(parent.key).alias("key"), F.col(parent.row_id).cast("bigint").alias("row_id")).where("key is not null"))
            alive[name] = owned[name].groupBy("key").agg(F.count(F.lit(1)).alias("left"))
        depth = 1
        while True:
            depth += 1
            gone = {}
            for name, own in owned.items():
                fresh = new.where(F.col("table_name") == name).select("row_id").distinct()
                lost = own.join(fresh, "row_id", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("lost"))
                alive[name] = cut_lineage(alive[name].join(lost, "key", "left").select("key", (F.col("left") - F.coalesce("lost", F.lit(0))).alias("left"), F.col("lost").isNotNull().alias("touched")))
                gone[name] = alive[name].where("touched and left <= 0").select("key")
                alive[name] = alive[name].select("key", "left")
            further = [child_rows(ref).join(gone[ref.parent], "key", "left_semi").select(*columns) for ref in inner]
            step = reduce(DataFrame.unionByName, further).dropDuplicates(["table_name", "row_id"])
            step = step.join(orphans.select("table_name", "row_id"), ["table_name", "row_id"], "left_anti")
            new = cut_lineage(step.select(*columns, F.lit("inherited").alias("kind"), F.lit(depth).alias("depth")))
            if new.isEmpty():
                break
            orphans = orphans.unionByName(new)
    children = [r.child for r in references]
    if len(children) != len(set(children)):  # a table with several references may be found by more than one
        first = F.min_by(F.struct("at", "kind", "parent"), "depth")
        orphans = orphans.groupBy("table_name", "row_id").agg(first.alias("f"), F.min("depth").alias("depth")).select("table_name", "row_id", "f.*", "depth")
    return orphans.select("table_name", F.date_format("at", "yyyy-MM").alias("ref_period"), "row_id", "kind", "depth", "parent")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Counts of orphans per table, period and kind."""
    return orphans.groupBy("table_name", "ref_period", "kind").agg(F.count(F.lit(1)).alias("n_rows"))
