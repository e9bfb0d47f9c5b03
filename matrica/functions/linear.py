"""Singular vectors of a matrix in long form (row, column, value), from sums over its rows."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.session import cut_lineage

#: Columns up to which the table of cross products is summed; wider matrices are iterated without it.
MOST_COLUMNS = 4096
#: Passes of the iteration at most, and the change of the singular values at which it ends.
PASSES, CLOSE = 60, 1e-12
#: Vectors iterated beside those asked for, which makes the asked ones settle sooner.
SPARE = 8


def column_stats(entries: DataFrame, row: str) -> tuple[DataFrame, int]:
    """(col, m, s; number of rows): each column's mean and population deviation over all rows, where a missing cell
    is 0. entries: row, col, val, each cell once."""
    n = entries.select(row).distinct().count()
    sums = entries.groupBy("col").agg(F.sum("val").alias("t"), F.sum(F.col("val") * F.col("val")).alias("q"), F.min("val").alias("lo"), F.max("val").alias("hi"), F.count(F.lit(1)).alias("cells"))
    mean = F.col("t") / n
    constant = (F.col("lo") == F.col("hi")) & ((F.col("cells") == n) | (F.col("lo") == 0))
    spread = F.when(constant, 0.0).otherwise(F.sqrt(F.greatest(F.col("q") / n - mean * mean, F.lit(0.0))))
    return cut_lineage(sums.select("col", mean.alias("m"), spread.alias("s"))), n


def _cross_products(cells: DataFrame, row: str, width: int) -> np.ndarray:
    """Sum of the rows' outer products: dense blocks of rows multiplied in the tasks, their tables summed by line."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, width))
        for pdf in batches:
            sizes = pdf["js"].str.len().to_numpy()
            for part in np.array_split(np.arange(len(pdf)), max(1, len(pdf) * width // 2_000_000)):
                if len(part):
                    block = np.zeros((len(part), width))
                    block[np.repeat(np.arange(len(part)), sizes[part]), np.concatenate(pdf["js"].iloc[part].to_list())] = np.concatenate(pdf["xs"].iloc[part].to_list())
                    total += block.T @ block
        if total.any():
            yield pd.DataFrame({"j": np.arange(width), "line": list(total)})

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for pdf in batches:
            for j, line in zip(pdf["j"], pdf["line"]):
                held[j] = held[j] + line if j in held else line
        yield pd.DataFrame({"j": list(held), "line": list(held.values())})

    rows = cells.groupBy(row).agg(F.collect_list(F.struct("j", "x")).alias("e")).select(F.col("e.j").alias("js"), F.col("e.x").alias("xs"))
    lines = rows.mapInPandas(partial, "j int, line array<double>").repartition("j").mapInPandas(summed, "j int, line array<double>").collect()
    out = np.zeros((width, width))
    for r in lines:
        out[r["j"]] = r["line"]
    return out


def _times(cells: DataFrame, by: str, other: str, factors: DataFrame, k: int) -> DataFrame:
    """by and k sums y0.. of the cells' values times the factors v0.. of their other index."""
    return cells.join(factors, other).groupBy(by).agg(*[F.sum(F.col("x") * F.col(f"v{i}")).alias(f"y{i}") for i in range(k)])


def _gram(table: DataFrame, k: int) -> np.ndarray:
    sums = table.agg(*[F.sum(F.col(f"y{i}") * F.col(f"y{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i + 1):
            out[i, j] = out[j, i] = sums[f"g{i}_{j}"] or 0.0
    return out


def _iterated(cells: DataFrame, stats: DataFrame, row: str, k: int, n: int, centred: bool) -> tuple[DataFrame, np.ndarray]:
    """(col and v0.., squared singular values) by subspace iteration; only k by k tables come to the driver.

    Centring takes the means' part out of each product, so the matrix stays as sparse as it is.
    """
    spun = F.xxhash64("col", F.lit(1)) / float(1 << 62)
    factors = stats.select("col", *[F.sin(spun * (i + 1) * 1000).alias(f"v{i}") for i in range(k)])
    shift = stats.select("col", F.col("shift")) if centred else None
    last = np.zeros(k)
    for _ in range(PASSES):
        scores = _times(cells, row, "col", factors, k)
        if centred:
            means = factors.join(shift, "col").agg(*[F.sum(F.col(f"v{i}") * F.col("shift")).alias(f"c{i}") for i in range(k)]).first()
            scores = scores.select(row, *[(F.col(f"y{i}") - F.lit(means[f"c{i}"])).alias(f"y{i}") for i in range(k)])
        scores = cut_lineage(scores)
        back = _times(cells, "col", row, scores.select(row, *[F.col(f"y{i}").alias(f"v{i}") for i in range(k)]), k)
        if centred:
            sums = scores.agg(*[F.sum(f"y{i}").alias(f"t{i}") for i in range(k)]).first()
            back = back.join(shift, "col").select("col", *[(F.col(f"y{i}") - F.col("shift") * F.lit(sums[f"t{i}"])).alias(f"y{i}") for i in range(k)])
        back = cut_lineage(back)
        values, turn = np.linalg.eigh(_gram(back, k))
        order = np.argsort(-values)
        size = np.sqrt(np.maximum(values[order], 0))
        turn = turn[:, order] / np.where(size > 0, size, 1)
        factors = back.select("col", *[sum((F.col(f"y{j}") * float(turn[j, i]) for j in range(k)), F.lit(0.0)).alias(f"v{i}") for i in range(k)])
        if np.max(np.abs(size - last)) <= CLOSE * max(size[0], 1e-300):
            break
        last = size
    return cut_lineage(factors), size


def singular_vectors(entries: DataFrame, row: str, k: int, *, centre: bool = False, scale: str | None = None, most_columns: int = MOST_COLUMNS) -> tuple[DataFrame, np.ndarray, float]:
    """(row with y0.., squared singular values, total square sum): the rows' products with the first right singular vectors.

    entries: row, col (text), val, each cell once; missing cells are 0. centre: columns less their means. scale: 'sd'
    divides columns by their population deviation, 'max' by their largest absolute value. Constant columns (centred)
    and zero columns add nothing. k is at most the number of columns that vary. Signs are set so that each
    vector's largest entry, the first by name among equal ones, is positive.
    """
    stats, n = column_stats(entries, row)
    used = stats.where("s > 0") if centre else stats.join(entries.where("val <> 0").select("col").distinct(), "col", "left_semi")
    if scale == "sd":
        size = used.withColumn("size", F.col("s"))
    elif scale == "max":
        size = used.join(entries.groupBy("col").agg(F.max(F.abs("val")).alias("size")), "col")
    else:
        size = used.withColumn("size", F.lit(1.0))
    stats = cut_lineage(size.select("col", "s", "size", (F.col("m") / F.col("size")).alias("shift")))
    width = stats.count()
    k = min(k, width)
    if not k:
        return entries.select(row).distinct(), np.zeros(0), 0.0
    cells = cut_lineage(entries.where("val <> 0").join(stats.select("col", "size"), "col").select(row, "col", (F.col("val") / F.col("size")).alias("x")))
    if width <= most_columns:
        place = stats.orderBy("col").select("col", "shift").collect()
        index = stats.sparkSession.createDataFrame([(r["col"], i) for i, r in enumerate(place)], "col string, j int")
        g = _cross_products(cells.join(F.broadcast(index), "col").select(row, "j", "x"), row, width)
        if centre:
            m = np.array([r["shift"] for r in place])
            g -= n * np.outer(m, m)
        total = float(np.trace(g))
        values, vectors = np.linalg.eigh(g)
        order = np.argsort(-values)[:k]
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        table = [(r["col"], *map(float, vectors[i])) for i, r in enumerate(place)]
        factors = stats.sparkSession.createDataFrame(table, "col string, " + ", ".join(f"v{i} double" for i in range(k)))
    else:
        squares = cells.groupBy("col").agg(F.sum(F.col("x") * F.col("x")).alias("q")).join(stats, "col")
        total = float(squares.agg(F.sum(F.col("q") - (n * F.pow("shift", 2) if centre else F.lit(0.0)))).first()[0])
        factors, values = _iterated(cells, stats, row, min(k + SPARE, width), n, centre)
        factors, values = factors.select("col", *[f"v{i}" for i in range(k)]), values[:k]
    peak = factors.agg(*[F.max_by(f"v{i}", F.struct(F.round(F.abs(f"v{i}"), 9), F.lit(0))).alias(f"p{i}") for i in range(k)]).first()
    signs = [-1.0 if peak[f"p{i}"] < 0 else 1.0 for i in range(k)]
    factors = factors.select("col", *[(F.col(f"v{i}") * signs[i]).alias(f"v{i}") for i in range(k)])
    off = factors.join(stats, "col").agg(*[F.sum(F.col(f"v{i}") * F.col("shift")).alias(f"c{i}") for i in range(k)]).first() if centre else None
    products = _times(cells, row, "col", F.broadcast(factors) if width <= most_columns else factors, k)
    every = entries.select(row).distinct().join(products, row, "left")
    scores = every.select(row, *[(F.coalesce(f"y{i}", F.lit(0.0)) - (off[f"c{i}"] if centre else 0.0)).alias(f"y{i}") for i in range(k)])
    return scores, values, total


#: Columns of one block of correlations, and cells that one task multiplies at a time.
BLOCK, CELLS = 1024, 4_000_000


def pairwise_correlations(cells: DataFrame, row: str, col: str, value: str, *, by: Sequence[str] = (), block: int = BLOCK) -> DataFrame:
    """by, a < b, n, rho: Pearson correlations of all pairs of columns over the rows that both have, in blocks.

    cells: by, row, col, value, each cell once; nulls are left out. Columns fall into blocks and rows into chunks by
    hash; each pair of blocks of a chunk is a few matrix products in one task, whose sums are added up per pair of
    columns, so no row per pair and row of the matrix is ever formed. rho is NULL where a side is constant.
    """
    by = list(by)
    rows = cells.where(F.col(value).isNotNull() & F.col(col).isNotNull()).select(*by, F.col(row).alias("r"), F.col(col).alias("c"), F.col(value).cast("double").alias("x"))
    size = rows.agg(F.approx_count_distinct("r").alias("r"), F.approx_count_distinct("c").alias("c")).first()
    blocks, chunks = max(1, math.ceil(size["c"] / block)), max(1, math.ceil(size["r"] * min(size["c"], 2 * block) / CELLS))
    own = rows.withColumn("k", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int")).withColumn("chunk", F.pmod(F.xxhash64("r"), F.lit(chunks)).cast("int"))
    left = own.withColumn("j", F.explode(F.sequence(F.col("k"), F.lit(blocks - 1)))).withColumnRenamed("k", "i").withColumn("first", F.lit(True))
    right = own.where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumnRenamed("k", "j").withColumn("first", F.lit(False))
    kind = dict(rows.dtypes)["c"]
    names = ["a", "b", "n", "sa", "sb", "saa", "sbb", "sab"]

    def products(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, _ = pd.factorize(pdf["r"])

        def side(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            where, labels = pd.factorize(pdf["c"][part], sort=True)
            x, has = np.zeros((at.max() + 1, len(labels))), np.zeros((at.max() + 1, len(labels)))
            x[at[part], where], has[at[part], where] = pdf["x"][part], 1.0
            return labels, x, has

        first, one = pdf["first"].to_numpy(), key[-3] == key[-2]  # a block with itself, or two
        a_names, a, ha = side(first)
        b_names, b, hb = (a_names, a, ha) if one else side(~first)
        n = ha.T @ hb
        sums = (n, a.T @ hb, ha.T @ b, (a * a).T @ hb, ha.T @ (b * b), a.T @ b)
        i, j = np.nonzero(np.triu(n, 1) if one else n)
        out = pd.DataFrame({"a": a_names[i], "b": b_names[j], **{m: s[i, j] for m, s in zip(names[2:], sums)}})
        turn = out["a"] > out["b"]
        out.loc[turn, ["a", "b", "sa", "sb", "saa", "sbb"]] = out.loc[turn, ["b", "a", "sb", "sa", "sbb", "saa"]].to_numpy()
        return out.assign(**dict(zip(by, key)))[[*by, *names]]

    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in by], f"a {kind}, b {kind}", *[f"{m} double" for m in names[2:]]])
    sums = left.unionByName(right.select(left.columns)).groupBy(*by, "i", "j", "chunk").applyInPandas(products, schema)
    sums = sums.groupBy(*by, "a", "b").agg(*[F.sum(m).alias(m) for m in names[2:]])
    n = F.col("n")
    va, vb = F.col("saa") - F.col("sa") * F.col("sa") / n, F.col("sbb") - F.col("sb") * F.col("sb") / n
    varies = lambda v, q: v > 1e-12 * F.greatest(F.col(q), F.lit(1e-300))
    rho = F.when(varies(va, "saa") & varies(vb, "sbb"), (F.col("sab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb))
    return sums.select(*by, "a", "b", n.cast("bigint").alias("n"), F.when(rho.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), rho))).alias("rho"))
