"""Counts and components of the pairs that lie within ranges of mass and time, without forming the pairs.

The table is cut into slabs of mass that are at least as wide as the rules reach; a task holds a slab and its
neighbours as arrays. All limits are tested on the differences themselves, as the rules of ``pairs`` are.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partners that each feature is joined with at first; only features outside the largest component meet all of theirs.
FIRST = 8
#: Pairs that are formed at a time.
PAIRS = 2_000_000


#: Rows of a slab, as long as it stays wider than the rules reach.
SLAB_ROWS = 250_000
#: Bytes of rows that a task holds until it packs them.
BLOCK_BYTES = 64 << 20
#: Rows with counts in a bucket of features.
BUCKET_ROWS = 100_000


def _decimals(values: np.ndarray) -> tuple[np.ndarray, int | None]:
    """The values as whole numbers of 32 bits and the decimals that they have, if they are these numbers exactly; else as they are."""
    if len(values) and np.isfinite(values).all():
        for d in range(7):
            whole = np.rint(values * 10**d)
            if np.abs(whole).max() >= 2**31:
                break
            if (whole / 10**d == values).all():
                return whole.astype(np.int32), d
    return values, None


def _block(table: pa.Table) -> bytes:
    """The table as compressed columns, its doubles as decimals where they are some; for ``unpacked``."""
    names, columns, split = [], [], {}
    for name, column in zip(table.column_names, table.columns):
        if pa.types.is_float64(column.type) and not column.null_count:
            values, d = _decimals(column.to_numpy())
            name, column = name if d is None else f"{name}:{d}", pa.array(values)
            split[name] = "BYTE_STREAM_SPLIT"
        names.append(name)
        columns.append(column)
    whole = [n for n, c in zip(names, columns) if n not in split and pa.types.is_integer(c.type)]
    out = io.BytesIO()
    pq.write_table(pa.table(columns, names=names), out, compression="zstd", use_dictionary=whole, column_encoding=split or None, write_statistics=False)
    return out.getvalue()


def blocks(table: pa.Table, by: str, order: Sequence[str]) -> pa.Table:
    """``by`` and block: the other columns of the rows of each value of ``by``, in this order."""
    table = table.sort_by([(c, "ascending") for c in (by, *order)])
    keys = table[by].to_numpy()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    rest = table.drop_columns([by])
    packed = [_block(rest.slice(a, b - a)) for a, b in zip(starts, np.r_[starts[1:], len(keys)])]
    return pa.table({by: pa.array(keys[starts], table.schema.field(by).type), "block": pa.array(packed, pa.binary())})


def packed(rows: DataFrame, by: str, order: Sequence[str], *, most: int = BLOCK_BYTES) -> DataFrame:
    """``by`` and block: the rows of each task as ``blocks``, so that a shuffle by ``by`` takes less than a table of them does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield from blocks(pa.Table.from_batches(held), by, order).to_batches()
                held, size = [], 0
        if held:
            yield from blocks(pa.Table.from_batches(held), by, order).to_batches()

    return rows.mapInArrow(run, f"{by} {dict(rows.dtypes)[by]}, block binary")


def unpacked(packed: pa.ChunkedArray) -> pa.Table:
    """The rows of blocks, as they were."""

    def table(block: pa.Scalar) -> pa.Table:
        held = pq.read_table(pa.BufferReader(block.as_buffer()))
        parts = [(n.partition(":"), c) for n, c in zip(held.column_names, held.columns)]
        return pa.table({n: pa.array(c.to_numpy() / 10 ** int(d)) if d else c for (n, _, d), c in parts})

    return pa.concat_tables([table(b) for b in packed])


def slab_rows(rows: DataFrame, reach: float, beside: Sequence[int]) -> tuple[DataFrame, int]:
    """Rows (feature, mz, rt) with finite mass and any time in their own slab (``own``) and in those ``beside`` that lie
    within ``reach`` of them, and the number of rows without copies. Rows without mass or time are left out.

    A slab is wider than ``reach``, as far as two slabs a core and SLAB_ROWS allow, so that few rows are sent twice.
    """
    rows = rows.select("feature", F.col("mz").cast("double").alias("mz"), F.col("rt").cast("double").alias("rt"))
    held = rows.where(F.col("mz").isNotNull() & F.col("rt").isNotNull() & ~F.isnan("mz") & (F.abs("mz") < float("inf")))
    low, high, n = held.agg(F.min("mz"), F.max("mz"), F.count(F.lit(1))).first()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    width = max(reach * 1.00001, (high - low) / max(2 * cores, n / SLAB_ROWS)) if n else reach
    slab = lambda shift: F.floor((F.col("mz") + F.lit(shift * reach * 1.000001)) / width)
    # a slab gets from the one after it (-1) what its own rows reach upwards, and from the one before it (1) downwards
    held = held.select("feature", "mz", "rt", slab(0).alias("s"), F.explode(F.array_distinct(F.array(*map(slab, (0, *beside))))).alias("slab"))
    return held.select("feature", "mz", "rt", "slab", (F.col("slab") == F.col("s")).alias("own")), n


def slabs(rows: DataFrame, reach: float, beside: Sequence[int]) -> DataFrame:
    """``slab_rows``, one task or more apart by slab."""
    return slab_rows(rows, reach, beside)[0].repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "slab")


def first_true(lo: np.ndarray, hi: np.ndarray, holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each i the first index in [lo, hi) from which on ``holds(i, index)`` is true; hi where it never is."""
    lo, hi = lo.copy(), hi.copy()
    going = np.flatnonzero(lo < hi)
    while len(going):
        mid = (lo[going] + hi[going]) // 2
        yes = holds(going, mid)
        hi[going[yes]] = mid[yes]
        lo[going[~yes]] = mid[~yes] + 1
        going = going[lo[going] < hi[going]]
    return lo


def count_less(ranks: np.ndarray, left: np.ndarray, right: np.ndarray, below: np.ndarray) -> np.ndarray:
    """For each query the number of ranks[left:right] smaller than ``below``: a wavelet matrix, built and asked level by level.

    ranks: 0 to n - 1 in any order; below: 0 to n."""
    out = np.zeros(len(left), dtype=np.int64)
    for bit in reversed(range(len(ranks).bit_length())):
        one = (ranks >> bit) & 1 == 1
        zeros = np.r_[0, np.cumsum(~one)]
        total, zl, zr, up = zeros[-1], zeros[left], zeros[right], (below >> bit) & 1 == 1
        out += np.where(up, zr - zl, 0)
        left, right = np.where(up, total + left - zl, zl), np.where(up, total + right - zr, zr)
        ranks = np.r_[ranks[~one], ranks[one]]
    return out


def _counts(mz: np.ndarray, rt: np.ndarray, asked: np.ndarray, rules) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of isomers and adducts of the rows ``asked`` among all rows, which ascend in mass."""
    n, m, t = len(mz), mz[asked], rt[asked]
    finite = np.isfinite(t)
    order = np.argsort(np.where(np.isfinite(rt), rt, np.inf), kind="stable")
    ranks, times = np.empty(n, dtype=np.int64), rt[order][: int(np.isfinite(rt).sum())]
    ranks[order] = np.arange(n)
    none, full, ends = np.zeros(len(m), dtype=np.int64), np.full(len(m), n), np.where(finite, len(times), 0)

    def mass(limit: float, *, strict: bool) -> tuple[np.ndarray, np.ndarray]:
        """Indices between which masses differ by at most ``limit`` (strict: by less)."""
        near = (lambda d: d < limit) if strict else (lambda d: d <= limit)
        first = first_true(none, full, lambda i, j: near(m[i] - mz[j]))
        return first, np.maximum(first, first_true(none, full, lambda i, j: ~near(mz[j] - m[i])))

    def time(limit: float, *, strict: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ranks between which times differ by at most ``limit`` (strict: by less); an infinite time is near none."""
        near = (lambda d: d < limit) if strict else (lambda d: d <= limit)
        first = first_true(none, ends, lambda i, j: near(t[i] - times[j]))
        return first, np.maximum(first, first_true(none, ends, lambda i, j: ~near(times[j] - t[i])))

    (l0, r0), (t0, t1) = mass(rules.isomer_mz, strict=False), time(rules.isomer_rt, strict=True)
    (l1, r1), (u0, u1) = mass(rules.adduct_most_mz, strict=False), time(rules.adduct_rt, strict=False)
    l2, r2 = mass(rules.adduct_least_mz, strict=True) if rules.adduct_least_mz > 0 else (r1, r1)
    asks = [(l0, r0, t1, -1), (l0, r0, t0, 1), (l1, l2, u1, 1), (l1, l2, u0, -1), (r2, r1, u1, 1), (r2, r1, u0, -1)]
    less = count_less(ranks, *[np.concatenate([np.maximum(q[i], q[0]) if i == 1 else q[i] for q in asks]) for i in range(3)]).reshape(len(asks), -1)
    less = less * np.array([s for *_, s in asks])[:, None]
    isomers = np.maximum(r0 - l0, 0) + less[0] + less[1] - ((r0 > l0) & ~(finite & (0 < rules.isomer_rt)))
    adducts = less[2:].sum(0)
    if rules.adduct_least_mz <= 0:  # one range around the row, which holds the row itself
        adducts = adducts - ((r1 > l1) & (u1 > u0))
    return isomers, adducts


def range_counts(features: DataFrame, rules) -> DataFrame:
    """feature, n_isomer and n_adduct of every feature (feature, mz, rt) that has one: sums over its rectangles of mass and time.

    Rows go to their slabs, and counts to the other rows of their feature, as packed blocks."""
    kind, tasks = dict(features.dtypes)["feature"], 4 * features.sparkSession.sparkContext.defaultParallelism

    def run(table: pa.Table) -> pa.Table:
        table = unpacked(table["block"]).sort_by("mz")
        own = table["own"].to_numpy()
        isomers, adducts = _counts(table["mz"].to_numpy(), table["rt"].to_numpy(), np.flatnonzero(own), rules)
        named = table.select(["bucket", "feature"]).filter(pa.array(own))
        out = named.append_column("n_isomer", pa.array(isomers.astype(np.int64))).append_column("n_adduct", pa.array(adducts.astype(np.int64)))
        return blocks(out.filter(pa.array(isomers + adducts > 0)), "bucket", ["feature"])

    def total(table: pa.Table) -> pa.Table:
        out = unpacked(table["block"]).group_by("feature").aggregate([("n_isomer", "sum"), ("n_adduct", "sum")])
        return out.select(["feature", "n_isomer_sum", "n_adduct_sum"]).rename_columns(["feature", "n_isomer", "n_adduct"])

    held, n = slab_rows(features, max(rules.isomer_mz, rules.adduct_most_mz, 1e-9), (-1, 1))
    own = lambda c: F.when(F.col("own"), c)
    bucket = F.pmod(F.xxhash64("feature"), F.lit(n // BUCKET_ROWS + 1)).cast("int")
    held = held.withColumns({"bucket": own(bucket), "feature": own(F.col("feature"))})
    found = packed(held, "slab", ["own", "mz", "rt"]).repartition(tasks, "slab").groupBy("slab").applyInArrow(run, "bucket int, block binary")
    return found.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(total, f"feature {kind}, n_isomer bigint, n_adduct bigint")


def _join(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Put the pairs (u, v) into one component each; root holds the smallest index of each row's component."""
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)
        while not np.array_equal(up := root[root], root):
            root[:] = up


def _components(mz: np.ndarray, rt: np.ndarray, rules) -> np.ndarray:
    """The component of each row (smallest index in it) by isomer and adduct rules; rows ascend in mass.

    Each row is first joined with a few partners. What then lies in the largest component needs no further pair among
    itself, so all pairs are formed only of the other rows, with whatever partner.
    """
    n = len(mz)
    root, every = np.arange(n), np.arange(n)
    least = max(rules.adduct_least_mz, 0.0)
    kept = np.flatnonzero(np.isfinite(rt))
    strip = np.floor(rt[kept] / (max(rules.adduct_rt, 1e-9) * 1.000001))
    order = kept[np.lexsort((mz[kept], strip[: len(kept)]))]
    strip, m = np.floor(rt[order] / (max(rules.adduct_rt, 1e-9) * 1.000001)), mz[order]

    def adducts(at: np.ndarray, d: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
        own = mz[at]
        s = np.floor(rt[at] / (max(rules.adduct_rt, 1e-9) * 1.000001)) + d
        lo, hi = np.searchsorted(strip, s, "left"), np.searchsorted(strip, s, "right")
        if later:
            first = first_true(lo, hi, lambda i, j: m[j] - own[i] >= least)
            return first, first_true(first, hi, lambda i, j: m[j] - own[i] > rules.adduct_most_mz)
        first = first_true(lo, hi, lambda i, j: own[i] - m[j] <= rules.adduct_most_mz)
        return first, first_true(first, hi, lambda i, j: own[i] - m[j] < least)

    def isomers(at: np.ndarray, later: bool) -> tuple[np.ndarray, np.ndarray]:
        if later:
            return at + 1, first_true(at + 1, np.full(len(at), n), lambda i, j: mz[j] - mz[at[i]] > rules.isomer_mz)
        return first_true(np.zeros(len(at), dtype=np.int64), at, lambda i, j: mz[at[i]] - mz[j] <= rules.isomer_mz), at

    def join(at: np.ndarray, place: np.ndarray, adduct: bool) -> None:
        to = order[place] if adduct else place
        with np.errstate(invalid="ignore"):
            far = np.abs(rt[at] - rt[to])
            ok = far <= rules.adduct_rt if adduct else ~(far < rules.isomer_rt)
        _join(root, at[ok], to[ok])

    def ways(finite: np.ndarray, at: np.ndarray, later: bool):
        yield from ((finite, *adducts(finite, d, later), True) for d in (-1, 0, 1))
        yield at, *isomers(at, later), False

    with np.errstate(invalid="ignore"):
        for at, lo, hi, adduct in ways(kept, every, True):
            for k in range(FIRST):
                some = lo + k < hi
                if not some.any():
                    break
                join(at[some], (lo + k)[some], adduct)
        rest = np.flatnonzero(root != np.bincount(root).argmax())
        for later in (True, False):
            for at, lo, hi, adduct in ways(rest[np.isfinite(rt[rest])], rest, later):
                size = np.maximum(hi - lo, 0)
                ends = np.cumsum(size)
                done = 0
                while done < (ends[-1] if len(ends) else 0):
                    place = np.arange(done, min(done + PAIRS, ends[-1]))
                    i = np.searchsorted(ends, place, "right")
                    join(at[i], lo[i] + place - (ends - size)[i], adduct)
                    done += len(place)
    return root


def range_groups(features: DataFrame, rules) -> DataFrame:
    """feature and root: the smallest feature of the component that it is in within its slab and what the next one has in
    reach, and the same for the slab before, if that reaches it. Components that share a feature belong together; no pair
    is left out by that."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("mz")
        root = _components(table["mz"].to_numpy(), table["rt"].to_numpy(), rules)
        by_name = pc.sort_indices(table["feature"]).to_numpy()
        smallest = np.empty(len(root), dtype=np.int64)
        smallest[root[by_name[::-1]]] = by_name[::-1]  # the last one written is the first by name
        return pa.table({"feature": table["feature"], "root": table["feature"].take(pa.array(smallest[root]))})

    kind = dict(features.dtypes)["feature"]
    held = slabs(features.where("feature is not null"), max(rules.isomer_mz, rules.adduct_most_mz, 1e-9), (-1,))
    return held.groupBy("slab").applyInArrow(run, f"feature {kind}, root {kind}")


def joined_roots(links: DataFrame) -> DataFrame:
    """root and cluster (the smallest root reachable) of all ends of links (a, b), by one task; for counted links."""

    def run(table: pa.Table) -> pa.Table:
        names = pc.unique(pa.chunked_array([*table["a"].chunks, *table["b"].chunks]))
        names = names.take(pc.sort_indices(names))
        root = np.arange(len(names))
        _join(root, *[pc.index_in(table[c], names).to_numpy() for c in ("a", "b")])
        return pa.table({"root": names, "cluster": names.take(pa.array(root))})

    kind = dict(links.dtypes)["a"]
    return links.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(run, f"root {kind}, cluster {kind}")
