"""Feature blocks in long form, their reduction and fusion into embeddings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import once
from matrica.functions.linear import MOST_COLUMNS, singular_vectors
from matrica.operators.sequences import COMPOSITION_PARTS, interpretable_tokens, joined_labels, token_counts
from matrica.session import cut_lineage


def composition_block(master: DataFrame, row_id: str) -> DataFrame:
    """row_id, col, val: the 22 numeric columns of composition and statistics of a canonical master; NULL counts 0."""
    parts = [f"comp_{p}" for p in COMPOSITION_PARTS if p not in ("GalNAc", "GlcNAc")]
    totals = ["comp_total_residues", "comp_fucose_total", "comp_sialic_total", "comp_fucose_ratio", "comp_sialic_ratio", "comp_hexnac_to_hex_ratio"]
    columns = [*parts, *totals, "branch_count", "unknown_count", "residue_count", "fucose_count", "sialic_count"]
    wide = master.select(row_id, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns])
    return wide.unpivot(row_id, columns, "col", "val")


def token_block(master: DataFrame, row_id: str, sequence: str = "canonical_sequence", *, max_n: int = 2, min_df: int = 1) -> DataFrame:
    """row_id, col, val: counts of the sequence tokens and of runs of up to ``max_n`` of them, as ``tok__<token>``."""
    counts = token_counts(once(master.select(row_id, sequence), tokens=interpretable_tokens(sequence)), row_id, "tokens", max_n=max_n, min_df=min_df)
    return counts.select(row_id, F.concat(F.lit("tok__"), "token").alias("col"), F.col("n").cast("double").alias("val"))


def metadata_block(master: DataFrame, row_id: str, columns: Sequence[str] = ("tissue_sample_norm", "tissue_species_norm", "disease_norm"), *, min_count: int = 25) -> DataFrame:
    """row_id, col, val: one column per label of joined metadata with at least ``min_count`` rows."""
    return onehot_block(master.select(row_id, *[joined_labels(c).alias(c) for c in columns]), row_id, columns, min_count=min_count)


def onehot_block(df: DataFrame, row_id: str, columns: Sequence[str], *, min_count: int = 25) -> DataFrame:
    """row_id, col, val: one column ``name::label`` per label of array columns with at least ``min_count`` rows."""
    named = lambda c: F.transform(F.array_distinct(c), lambda v: F.concat(F.lit(f"{c}::"), v))
    parts = F.flatten(F.array(*map(named, columns)))
    rows = df.select(row_id, F.explode(parts).alias("col"))
    often = rows.groupBy("col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count).select("col")
    return rows.join(often, "col", "left_semi").select(row_id, "col", F.lit(1.0).alias("val"))


def binding_block(binding: DataFrame, row_id: str, *, min_rows: int = 20, top: int = 256) -> DataFrame:
    """row_id, col, val: mean binding value by protein, for the ``top`` proteins of at least ``min_rows`` sequences."""
    known = binding.groupBy("protein").agg(F.count_distinct(row_id).alias("n")).where(F.col("n") >= min_rows).orderBy(F.desc("n"), "protein").limit(top)
    return binding.join(F.broadcast(known.select("protein")), "protein").groupBy(row_id, F.col("protein").alias("col")).agg(F.avg("binding_value").alias("val"))


def block_summary(block: DataFrame, row_id: str) -> DataFrame:
    """n_rows, n_columns, n_entries, density and mean entries per row of a long block."""
    sums = block.where("val <> 0").agg(F.count_distinct(row_id).alias("n_rows"), F.count_distinct("col").alias("n_columns"), F.count(F.lit(1)).alias("n_entries"))
    return sums.withColumn("density", F.try_divide(F.col("n_entries"), F.col("n_rows") * F.col("n_columns"))).withColumn("mean_active", F.try_divide(F.col("n_entries"), F.col("n_rows")))


def reduce_block(block: DataFrame, row_id: str, k: int) -> DataFrame:
    """row_id and embedding (array): each column over its largest absolute value, then a truncated SVD.

    k is at most one less than rows and columns; where that leaves fewer than two, the scaled columns themselves, in
    name order. A row's embedding is its product with the right singular vectors. Rows are distributed, and blocks of
    many columns are iterated (see functions.linear).
    """
    block = cut_lineage(block.groupBy(row_id, "col").agg(F.sum("val").alias("val")))
    sizes = block.groupBy("col").agg(F.max(F.abs("val")).alias("m"))
    width, n = sizes.count(), block.select(row_id).distinct().count()
    most = min(k, n - 1, width - 1)
    if most < 2:  # at most two columns, or two rows
        names = [r["col"] for r in sizes.select("col").orderBy("col").collect()] if width <= 2 else [r["col"] for r in sizes.orderBy("col").take(MOST_COLUMNS)]
        scaled = block.join(F.broadcast(sizes), "col").withColumn("val", F.coalesce(F.try_divide("val", F.when(F.col("m") > 0, F.col("m"))), F.lit(0.0)))
        own = [F.coalesce(F.sum(F.when(F.col("col") == c, F.col("val"))), F.lit(0.0)) for c in names]
        return scaled.groupBy(row_id).agg(F.array(*own).alias("embedding"))
    scores, values, _ = singular_vectors(block, row_id, most, scale="max")
    return scores.select(row_id, F.array(*[f"y{i}" for i in range(len(values))]).alias("embedding"))


def fuse_embeddings(parts: Sequence[tuple[DataFrame, int]], row_id: str) -> DataFrame:
    """row_id and embedding: the parts' embeddings side by side; a row that a part lacks has zeros there."""
    out = None
    for i, (part, width) in enumerate(parts):
        own = part.select(row_id, F.col("embedding").alias(f"e{i}"))
        out = own if out is None else out.join(own, row_id, "full")
    zero = lambda w: F.array_repeat(F.lit(0.0), w)
    return out.select(row_id, F.concat(*[F.coalesce(f"e{i}", zero(w)) for i, (_, w) in enumerate(parts)]).alias("embedding"))


def linear_layout(vectors: DataFrame, row_id: str, vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(row_id with x and y, explained variance ratios): two principal components of centred vectors."""
    rows = vectors.select(row_id, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    model = PCA(k=2, inputCol="v", outputCol="p").fit(rows)
    scores = model.transform(rows).select(row_id, vector_to_array("p").alias("p"))
    centre = scores.agg(F.avg(F.col("p")[0]).alias("cx"), F.avg(F.col("p")[1]).alias("cy"))
    placed = scores.crossJoin(F.broadcast(centre)).select(row_id, (F.col("p")[0] - F.col("cx")).alias("x"), (F.col("p")[1] - F.col("cy")).alias("y"))
    return placed, model.explainedVariance.toArray()
