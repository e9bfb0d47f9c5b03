"""Exact nearest neighbours by cosine in blocks, and what neighbourhoods say about labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matrica.session import cut_lineage

#: Anchors in one block, which is what a task holds of the anchor side.
BLOCK = 2048


def cosine_neighbours(vectors: DataFrame, anchors: DataFrame, k: int, *, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """anchor, neighbor, cosine_distance, neighbor_rank: the k nearest other rows of each anchor, exactly.

    Anchors and rows fall into groups by hash, however sparse their keys; each group of rows meets each group of anchors
    in a task of its own, block by block as matrix products, and hands on only its k best per anchor, so the pairs are
    never formed as rows. The partial lists then merge by anchor. A row is no neighbour of itself; ties go to the
    smaller key. Null and zero vectors have distance 1 to all others; null keys are left out.
    """
    asked, rows = (_vectors(df, key, vector).withColumn("cell", F.lit(0)) for df in (anchors, vectors))
    return _merged(rows, asked, k, block)


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def _unit_rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, unit vectors) of rows (id, v) in the order of their ids; null vectors, and those of another length than the longest, are 0."""
    table = table.sort_by("id").combine_chunks()
    v = table["v"].combine_chunks()
    size = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    width = max(1, int(size.max(initial=0)))
    m, full = np.zeros((len(size), width)), size == width
    flat = pc.list_flatten(v.filter(pa.array(full)))
    m[full] = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False).reshape(-1, width)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return table["id"].to_numpy(), m / np.where(length > 0, length, 1)


def _nearest(rows: pa.Table, anchors: pa.Table, k: int, block: int) -> pa.Table:
    """The k nearest rows of each anchor among ``rows``.

    Products in single precision tell which rows of a block may be among the k best, by a margin over their largest
    error; the distances of those are then taken in double precision.
    """
    (ids, m), (a_ids, a) = _unit_rows(rows), _unit_rows(anchors)
    width = max(m.shape[1], a.shape[1])
    m, a = (x if x.shape[1] == width else np.zeros((len(x), width)) for x in (m, a))
    a32, none = a.astype(np.float32), ~a.any(1)
    margin = (width + 8) * 1.2e-7
    at, far, near = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)  # anchor, distance and place of the best
    worst = np.full(len(a), np.inf)
    for start in range(0, len(ids), block):
        part = m[start : start + block].astype(np.float32)
        found = []
        for lo in range(0, len(a), block):
            x = a32[lo : lo + block] @ part.T
            least = (1 - worst[lo : lo + block] - margin).astype(np.float32)
            if np.isinf(least).any() and len(part) > k + 1:
                own = np.partition(x, len(part) - k - 1, axis=1)[:, len(part) - k - 1] - np.float32(2 * margin)
                least = np.maximum(least, own)  # k + 1 rows, as one may be the anchor itself
            least[none[lo : lo + block] & np.isfinite(worst[lo : lo + block])] = np.inf  # all ties, of which the first ones are held
            i, j = np.nonzero(~(x < least[:, None]))
            found.append((i + lo, j + start))
        i, j = (np.concatenate(x) for x in zip(*found))
        keep = a_ids[i] != ids[j]
        i, j = i[keep], j[keep]
        d = np.concatenate([np.round(1 - np.einsum("ij,ij->i", a[i[p : p + 500_000]], m[j[p : p + 500_000]]), 12) for p in range(0, max(1, len(i)), 500_000)])
        finite = np.isfinite(d)
        at, far, near = np.r_[at, i[finite]], np.r_[far, d[finite]], np.r_[near, j[finite]]
        order = np.lexsort((near, far, at))
        at, far, near = at[order], far[order], near[order]
        first = np.searchsorted(at, np.arange(len(a)))
        best = np.arange(len(at)) - first[at] < k
        at, far, near = at[best], far[best], near[best]
        size = np.bincount(at, minlength=len(a))
        last = np.cumsum(size) - 1
        worst = np.where(size == k, far[np.maximum(last, 0)], np.inf) if len(far) else worst
    return pa.table({"anchor": a_ids[at], "neighbor": ids[near], "cosine_distance": far})


#: Blocks of anchors and of rows in one group, which is what a task holds of each.
ANCHOR_BLOCKS, ROW_BLOCKS = 8, 32


def _merged(rows: DataFrame, anchors: DataFrame, k: int, block: int) -> DataFrame:
    """The k nearest rows of each anchor among the rows (cell, id, v) that share a cell with it."""
    rows, anchors = rows.select("cell", "id", "v"), anchors.select("cell", "id", "v")
    parts = rows.sparkSession.sparkContext.defaultParallelism
    n = F.count(F.lit(1))
    wanted = F.greatest(F.ceil(n / (ROW_BLOCKS * block)), F.least(F.lit(parts), F.ceil(n / block))).cast("int")
    sizes = rows.groupBy("cell").agg(wanted.alias("r")).join(anchors.groupBy("cell").agg(F.ceil(n / (ANCHOR_BLOCKS * block)).cast("int").alias("a")), "cell")
    sizes = cut_lineage(sizes)  # one row per cell
    turn = lambda c, seed: F.pmod(F.xxhash64("id", F.monotonically_increasing_id(), F.lit(seed)), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = rows.join(F.broadcast(sizes), "cell").select("cell", turn("r", 1).alias("g"), "a", "id", "v").select("cell", "g", every("a").alias("h"), "id", "v")
    right = anchors.join(F.broadcast(sizes), "cell").select("cell", turn("a", 2).alias("h"), "r", "id", "v").select("cell", every("r").alias("g"), "h", "id", "v")

    def nearest(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        if not rows.num_rows or not anchors.num_rows:
            return pa.table({"anchor": np.zeros(0, dtype=np.int64), "neighbor": np.zeros(0, dtype=np.int64), "cosine_distance": np.zeros(0)})
        return _nearest(rows, anchors, k, block)

    pairs = left.groupBy("cell", "g", "h").cogroup(right.groupBy("cell", "g", "h"))
    found = pairs.applyInArrow(nearest, "anchor bigint, neighbor bigint, cosine_distance double")
    order = Window.partitionBy("anchor").orderBy("cosine_distance", "neighbor")
    return found.withColumn("neighbor_rank", F.row_number().over(order)).where(F.col("neighbor_rank") <= k)


#: Rows that the cells of an index are fitted on, at most in expectation.
INDEX_SAMPLE = 50_000


def fit_cells(vectors: DataFrame, cells: int, *, key: str = "vec_id", vector: str = "embedding", sample: int = INDEX_SAMPLE, seed: int = 5) -> np.ndarray:
    """Centres (unit rows) of ``cells`` cells by k-means over unit vectors, fitted on a bounded sample drawn by a hash of
    the key. Null and zero vectors take no part."""
    rows = _vectors(vectors, key, vector).where("v is not null")
    share = min(1.0, sample / max(rows.count(), 1))
    chosen = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000)).select(array_to_vector("v").alias("features"))
    unit = Normalizer(inputCol="features", outputCol="unit").transform(chosen)
    centres = np.array(KMeans(k=cells, featuresCol="unit", seed=seed, maxIter=20).fit(unit).clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)


def indexed_neighbours(vectors: DataFrame, anchors: DataFrame, k: int, centres: np.ndarray, probes: int, *, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """As cosine_neighbours, but each anchor meets only the rows of the ``probes`` cells nearest to it.

    Every row is in the cell of its nearest centre, so all are indexed; a cell that holds much of the table is cut into
    blocks like any other. Neighbours in other cells are missed: measure the share found with ``recall``.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def placed(df: DataFrame, n: int) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                near = shared.value
                m = np.array([v if v is not None and len(v) == near.shape[1] else np.zeros(near.shape[1]) for v in pdf["v"]], dtype=float).reshape(len(pdf), near.shape[1])
                cells = np.argsort(-(m @ near.T), axis=1, kind="stable")[:, :n]
                yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cells": list(cells.astype(np.int32))})

        return _vectors(df, key, vector).mapInPandas(run, "id bigint, v array<double>, cells array<int>").select("id", "v", F.explode("cells").alias("cell"))

    return _merged(cut_lineage(placed(vectors, 1)), cut_lineage(placed(anchors, min(probes, len(centres)))), k, block)


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row, recall: the share of the exact neighbours that were found, over all anchors."""
    hit = found.select("anchor", "neighbor", F.lit(1).alias("hit"))
    return exact.join(hit, ["anchor", "neighbor"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def label_purity(neighbours: DataFrame, labels: DataFrame, *, key: str = "vec_id", label: str = "label") -> DataFrame:
    """label, purity, n: the mean share of neighbours with the anchor's label. Rows without label take no part."""
    own = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("anchor"), F.col(label).alias("label"))
    other = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("neighbor"), F.col(label).alias("other"))
    per = neighbours.join(own, "anchor").join(other, "neighbor").groupBy("anchor", "label").agg(F.avg((F.col("label") == F.col("other")).cast("int")).alias("p"))
    return per.groupBy("label").agg(F.avg("p").alias("purity"), F.count(F.lit(1)).alias("n"))


def label_set_purity(neighbours: DataFrame, sets: DataFrame, *, key: str = "id", members: str = "members") -> DataFrame:
    """One row, purity and n: over anchors with labels, the mean share of neighbours that have a label in common."""
    own = sets.where(F.size(members) > 0).select(F.col(key).alias("anchor"), F.col(members).alias("a"))
    other = sets.select(F.col(key).alias("neighbor"), F.col(members).alias("b"))
    rows = neighbours.join(own, "anchor").join(other, "neighbor", "left")
    per = rows.groupBy("anchor").agg(F.avg(F.coalesce(F.arrays_overlap("a", "b"), F.lit(False)).cast("int")).alias("p"))
    return per.agg(F.avg("p").alias("purity"), F.count(F.lit(1)).alias("n"))


def neighbour_overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """anchor, n_shared, jaccard of two neighbour tables, over the anchors that either has."""
    a = first.groupBy("anchor").agg(F.collect_set("neighbor").alias("a"))
    b = second.groupBy("anchor").agg(F.collect_set("neighbor").alias("b"))
    both = a.join(b, "anchor", "full").select("anchor", *[F.coalesce(c, F.array().cast("array<bigint>")).alias(c) for c in "ab"])
    return both.select("anchor", F.size(F.array_intersect("a", "b")).alias("n_shared"), (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"))


def set_relevance(neighbours: DataFrame, sets: DataFrame, *, key: str = "id", members: str = "members") -> DataFrame:
    """anchor and mean Jaccard of its member set with its neighbours' sets; anchors without members are left out."""
    own = sets.where(F.size(members) > 0).select(F.col(key).alias("anchor"), F.array_distinct(members).alias("a"))
    other = sets.select(F.col(key).alias("neighbor"), F.array_distinct(members).alias("b"))
    rows = neighbours.join(own, "anchor").join(other, "neighbor")
    jaccard = F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))  # a is never empty
    return rows.groupBy("anchor").agg(F.avg(jaccard).alias("mean_jaccard"), F.count(F.lit(1)).alias("n_neighbors"))


def similarity_edges(neighbours: DataFrame, top_k: int) -> DataFrame:
    """Undirected edges a < b with weight 1 - distance of the first neighbours; a pair found twice is one edge."""
    rows = neighbours.where(F.col("neighbor_rank") <= top_k).select(F.least("anchor", "neighbor").alias("a"), F.greatest("anchor", "neighbor").alias("b"), (1 - F.col("cosine_distance")).alias("weight"))
    return rows.groupBy("a", "b").agg(F.max("weight").alias("weight"))


def centroid_silhouette(vectors: DataFrame, *, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, silhouette, n: the simplified silhouette, from distances to the label centroids instead of all pairs.

    a is the distance to the own centroid, b to the nearest other; (b - a) / max(a, b). It needs one pass over
    the rows and a table of centroids, so it stays linear; the pairwise form is quadratic and is not used.
    """
    rows = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    parts = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    centres = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    all_centres = centres.agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("cs"))  # one row per label
    far = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    held = rows.crossJoin(F.broadcast(all_centres))
    d = F.transform(F.map_entries("cs"), lambda e: F.struct((e["key"] == F.col("label")).alias("own"), far(e["value"], F.col("v")).alias("d")))
    held = held.select("label", d.alias("d"))
    a, b = F.array_min(F.transform(F.filter("d", lambda s: s["own"]), lambda s: s["d"])), F.array_min(F.transform(F.filter("d", lambda s: ~s["own"]), lambda s: s["d"]))
    held = held.select("label", a.alias("a"), b.alias("b"))
    return held.groupBy("label").agg(F.avg(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("silhouette"), F.count(F.lit(1)).alias("n"))
