"""Consolidating pairwise matches into groups by random graph contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import HOT_ROWS, join_skewed
from matrica.session import cut_lineage, release


#: Edges that one partition takes: rounds of fewer need no shuffle.
SMALL = 50_000
#: Joins of mappings that one plan holds at most.
CHAIN = 3


def _relabel(rows: DataFrame, column: str, mapping: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with ``column`` replaced by its representative. Vertices with many edges (``hot``) meet a broadcast mapping.

    At most edges/hot_limit vertices are hot, so that mapping has a bounded size.
    """
    new = [F.col("hook").alias(column) if c == column else F.col(c) for c in rows.columns]
    own = mapping.select(F.col("vertex").alias(column), "hook")
    if hot is None:
        return rows.join(own, column).select(*new)
    split = rows.join(F.broadcast(hot.select(F.col("vertex").alias(column), "hook")), column, "left")
    done = split.where(F.col("hook").isNotNull()).select(*new)
    return done.unionByName(split.where(F.col("hook").isNull()).drop("hook").join(own, column).select(*new))


def _numbered(edges: DataFrame, n: int, hot_limit: int) -> tuple[DataFrame, DataFrame, int]:
    """(vertex and id, edges over ids, bits that an id takes): dense numbers in place of names.

    Rows are numbered within their partition; only the partitions' sizes come to the driver.
    """
    vertices = edges.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
    placed = cut_lineage(vertices.select("vertex", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")))
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row per partition
    starts, total = [], 0
    for part, size in sizes:
        starts.append((part, total - (part << 33)))  # a place counts within its partition, from part * 2**33
        total += size
    start = F.broadcast(edges.sparkSession.createDataFrame(starts, "part int, start bigint"))
    ids = placed.join(start, "part").select("vertex", (F.col("place") + F.col("start")).alias("id"))
    for end in ("a", "b"):
        named = ids.select(F.col("vertex").alias(end), F.col("id").alias(f"{end}_id"))
        edges = join_skewed(edges, named, end, limit=hot_limit, rows=n)
    edges = edges.select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    return ids, cut_lineage(edges), max(1, (total - 1).bit_length())


def connected_groups(pairs: DataFrame, left: str, right: str, *, seed: int = 7, hot_limit: int = HOT_ROWS) -> DataFrame:
    """vertex, group: every linked vertex with the smallest vertex (in text order) of its group.

    Vertices are numbered first. Each round draws a fresh hash order, lets every vertex hook to the neighbour (or
    itself) that comes first in it, and follows the hook of that neighbour; then it relabels the edges by the hooks and
    drops loops and repeats. A round removes a constant share of the vertices on average, so the rounds grow with the
    logarithm of the longest chain's size. Then the mappings of all rounds are expanded from the smallest back to the
    first. Edges and mappings are written to the shared folder between rounds; hooks and roots that many vertices
    share are joined by broadcast.
    Pairs with a null end link nothing; a pair of equal ends only makes its vertex known if another pair links it;
    repeated and reversed pairs count once; no pairs give no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = pairs.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = cut_lineage(edges)
    turn, n = 0, edges.count()
    if not n:
        return pairs.select(a.alias("vertex"), a.alias("group")).limit(0)
    ids, edges, bits = _numbered(edges, n, hot_limit)
    mappings: list[tuple[DataFrame, int]] = []
    while n:
        turn += 1
        packed = (lambda df: df.coalesce(1)) if n <= SMALL else (lambda df: df)
        edges, last = packed(edges), edges
        # A vertex' turn: a fresh hash in the upper bits, its number in the lower ones. The seed is a text, as texts are no
        # part of the code that Spark generates, which so stays the same over the rounds and is compiled once.
        order = lambda c: F.shiftleft(F.xxhash64(F.lit(f"{seed}:{turn}"), c).bitwiseAND(F.lit((1 << (62 - bits)) - 1)), bits).bitwiseOR(F.col(c))  # noqa: B023, E731
        ends = edges.select(F.col("a").alias("vertex"), order("b").alias("o")).unionByName(edges.select(F.col("b").alias("vertex"), order("a").alias("o")))
        hooks = ends.groupBy("vertex").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("degree"))
        hooks = hooks.select("vertex", F.least(F.col("o"), order("vertex")).bitwiseAND(F.lit((1 << bits) - 1)).alias("hook"), "degree")
        if 2 * n > hot_limit:
            hooks = cut_lineage(hooks)
        next_hook = hooks.select(F.col("vertex").alias("hook"), F.col("hook").alias("next"))
        hooks = cut_lineage(join_skewed(hooks, next_hook, "hook", "left", limit=hot_limit, rows=2 * n).select("vertex", F.coalesce("next", "hook").alias("hook"), "degree"))
        mappings.append((hooks.select("vertex", "hook"), 2 * n))
        hooks = packed(hooks)
        hot = hooks.where(F.col("degree") > hot_limit) if n > hot_limit else None
        edges = _relabel(_relabel(edges, "a", hooks, hot), "b", hooks, hot)
        edges = cut_lineage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        release(last)
        n = edges.count()
    root = mappings[-1][0].withColumnRenamed("hook", "root")
    for step, (hooks, size) in enumerate(reversed(mappings[:-1]), 1):
        root = join_skewed(hooks, root.withColumnRenamed("vertex", "hook"), "hook", "left", limit=hot_limit, rows=size).select("vertex", F.coalesce("root", "hook").alias("root"))
        root = cut_lineage(root) if step % CHAIN == 0 else root
    named = cut_lineage(ids.join(root.withColumnRenamed("vertex", "id"), "id").select("vertex", "root"))
    names = named.groupBy("root").agg(F.min("vertex").alias("group"))
    return join_skewed(named, names, "root", "left", limit=hot_limit, rows=mappings[0][1]).select("vertex", "group")
