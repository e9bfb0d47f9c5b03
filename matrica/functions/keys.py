"""Key normalisation, hot keys and null-safe joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.session import cut_lineage

#: Rows of one key that one task may hold; keys with more are split.
HOT_ROWS = 200_000


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the given columns, each evaluated once per row however often it is used later.

    Catalyst copies the expression of a column into every use of it, and lambdas evaluate each copy per element; it
    does not look into the rows of a one-element array. Columns of df with such a name are replaced.
    """
    rest = [f"`{c}`" for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once however often ``use`` names it: the variable of a lambda over one element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tidy_key(name: str | Column, *, upper: bool = False) -> Column:
    """A key without outer blanks and tabs and without regard to case; blank becomes NULL."""
    column = F.col(name) if isinstance(name, str) else name
    key = F.trim(column, F.lit(" \t"))
    key = F.upper(key) if upper else F.lower(key)
    return F.when(key != "", key)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL equals NULL, keeping the left side's key columns."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(renamed, on, how).drop(*[f"__r_{k}" for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``limit`` rows.

    Counted exactly with map-side partial counts. At most rows/limit keys come out, which is the size bound
    under which callers broadcast them. Without keys all rows are one group, for which a row with ``__all`` stands.
    """
    if not keys:
        return df.agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(F.lit(1).alias("__all"))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit).select(*keys)


#: Rows (of under 100 bytes) up to which a counted table is broadcast.
BROADCAST_ROWS = 200_000


def join_counted(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Null-safe join with a table that is written and counted first, and broadcast up to BROADCAST_ROWS rows.

    Spares a shuffle of a large left side; a larger right side takes the shuffled join.
    """
    right = cut_lineage(right)
    return join_null_safe(left, F.broadcast(right) if right.count() <= BROADCAST_ROWS else right, keys, how)


def join_skewed(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner", *, limit: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """left joined with right, which has one row per key, where a few keys may hold much of left. NULL matches nothing.

    rows: the number of left's rows, where known; up to ``limit`` no key can be hot and none is looked for.

    Keys with more than ``limit`` rows of left, at most rows/limit of them, are joined by broadcast, so no task gets
    such a key; the others by a shuffled join.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if rows is not None and rows <= limit:
        return left.join(right, keys, how)
    hot = cut_lineage(hot_keys(left, keys, limit))
    if hot.isEmpty():
        return left.join(right, keys, how)
    few = F.broadcast(right.join(F.broadcast(hot), keys, "left_semi"))
    warm = left.join(F.broadcast(hot), keys, "left_semi").join(few, keys, how)
    return warm.unionByName(left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how))
