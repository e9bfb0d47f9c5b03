"""Sequence texts: standardising, canonical keys, statistics, plausibility, tokens and families."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrica.functions.keys import let, once
from matrica.operators.packed import split_packed
from matrica.session import cut_lineage
from matrica.sources.tables import resolve_column

# Column synonyms, null spellings, identifier columns that stay, and signs of a sequence text.
SYNONYMS = {
    "sequence": ("glycan_sequence", "glycan", "sequence", "iupac", "iupac_condensed", "glycan_iupac", "structure", "glycan_structure"),
    "composition": ("composition", "glycan_composition", "comp"),
    "tissue_species": ("tissue_species", "species", "organism", "taxonomy", "host"),
    "tissue_sample": ("tissue_sample", "tissue", "sample_type", "sample_origin", "sample"),
    "disease": ("disease", "disease_association", "condition", "phenotype"),
}
NULL_TEXTS = ("", "nan", "None", "NA")
KEPT = (
    "feature", "feature_id", "candidate_id", "target_tier", "biomarker_tier", "priority_tier", "tier",
    "redundancy_cluster", "redundancy_cluster_id", "cluster_id", "clinical_profile", "profile", "feature_profile",
)
SEQUENCE_SIGNS = ("GlcNAc", "Gal", "Man", "Fuc", "Neu5Ac", "Neu5Gc", r"\(", r"\)", r"\[", r"\]", ";N", "WURCS", "RES", "GlyTouCan")
# Residue names in order of precedence, sialic acids, the N-glycan core.
RESIDUES = ("Neu5Ac", "Neu5Gc", "Kdn", "GalNAc", "GlcNAc", "ManNAc", "Gal", "Glc", "Man", "Fuc", "Xyl")
SIALIC_ACIDS = ("Neu5Ac", "Neu5Gc", "Kdn")
N_GLYCAN_CORE = ("GlcNAc(b1-4)GlcNAc", "Man(b1-4)GlcNAc", "Man(a1-3)", "Man(a1-6)")
# Parts that no sequence holds, and parts that make a text a sequence.
IMPLAUSIBLE = ("Homo_sapiens", "Mus_musculus", "Bos_taurus", "Arabidopsis", "virus", "cell_line", "blood", "plasma", "mucosa", "seminal_fluid")
PLAUSIBLE = ("GlcNAc", "GalNAc", "Neu5Ac", "Neu5Gc", "Kdn", "Gal", "Glc", "Man", "Fuc", "Xyl", "WURCS=", "RES", ";N")
# Words of a cancer context.
CANCER_WORDS = (
    "cancer", "carcinoma", "adenocarcinoma", "tumor", "tumour", "leukemia", "leukaemia", "lymphoma", "myeloma", "sarcoma",
    "cholangiocarcinoma", "melanoma", "glioma",
)


def normalise_text(column: str) -> Column:
    """Trimmed text; the null spellings become NULL."""
    text = F.trim(F.col(column).cast("string"))
    return F.when(~text.isin(*NULL_TEXTS), text)


def find_sequence_column(df: DataFrame, *, min_share: float = 0.3) -> str | None:
    """The column that holds sequences: by synonym, else the first text column of whose values at least ``min_share``
    show a sign of a sequence (one pass over all rows), else the only column, if it is text; None if there is none."""
    named = resolve_column(df, SYNONYMS["sequence"])
    texts = [c for c, kind in df.dtypes if kind == "string"]
    if named or not texts:
        return named
    sign = lambda c: F.avg(normalise_text(f"`{c}`").rlike("|".join(SEQUENCE_SIGNS)).cast("int"))
    shares = df.agg(*[sign(c).alias(str(i)) for i, c in enumerate(texts)]).first()
    like = [c for c, share in zip(texts, shares) if share is not None and share >= min_share]
    return like[0] if like else df.columns[0] if len(df.columns) == 1 else None


def standardise_sequences(df: DataFrame, *, source_name: str, keep: Sequence[str] = (), require_sequence: bool = True, n_glycan: bool = False) -> DataFrame:
    """glycan_sequence, composition, tissue_species, tissue_sample, disease, source_name, is_n_glycan,
    original_sequence_column and kept columns (those asked for, and identifiers by their usual names).

    Columns are found by synonym whatever their case, the sequence also by its content; a missing one is NULL. Rows
    without a sequence are dropped; KeyError if the sequence column is required and absent.
    """
    found = {k: resolve_column(df, names) for k, names in SYNONYMS.items()} | {"sequence": find_sequence_column(df)}
    if require_sequence and not found["sequence"]:
        raise KeyError("no sequence column")
    text = lambda k: (normalise_text(f"`{found[k]}`") if found[k] else F.lit(None).cast("string"))
    columns = [text("sequence").alias("glycan_sequence"), *[text(k).alias(k) for k in SYNONYMS if k != "sequence"]]
    kept = [*keep, *[c for c in KEPT if c in df.columns and c not in keep]]
    added = [F.lit(source_name).alias("source_name"), F.lit(int(n_glycan)).alias("is_n_glycan"), F.lit(found["sequence"] or "missing").alias("original_sequence_column")]
    return df.select(*kept, *columns, *added).where("glycan_sequence is not null")


def canonical_exact(column: str) -> Column:
    """The text without any white space; NULL if nothing is left."""
    text = F.regexp_replace(F.col(column), r"(?U)\s+", "")
    return F.when(text != "", text)


def canonical_topology(column: str) -> Column:
    """Linkages in parentheses dropped, lower case, only letters, digits and square brackets; NULL if nothing is left."""
    text = F.regexp_replace(F.lower(F.regexp_replace(F.col(column), r"\([^)]*\)", "")), r"[^a-z0-9\[\]]", "")
    return F.when(text != "", text)


def likely_n_glycan(column: str) -> Column:
    """All parts of the N-glycan core occur."""
    out = F.lit(True)
    for part in N_GLYCAN_CORE:
        out = out & F.col(column).contains(part)
    return out


def sequence_statistics(column: str) -> dict[str, Column]:
    """Length, branches, unknown linkages, and counts of residues, fucose and sialic acids of a canonical sequence."""
    text = F.col(column)
    count = lambda p: F.regexp_count(text, F.lit(p))
    return {
        "seq_length": F.length(text), "branch_count": count(r"\["), "unknown_count": count(r"\?"),
        "residue_count": count("|".join(RESIDUES)), "fucose_count": count("Fuc"), "sialic_count": count("|".join(SIALIC_ACIDS)),
    }


def _holds_any(text: Column, parts: Sequence[str]) -> Column:
    return reduce(Column.__or__, [text.contains(p) for p in parts])


def plausible_sequence(column: str) -> Column:
    """No part of a description and no list of other things, and a part of a sequence, or its brackets; NULL is not."""
    text = F.col(column)
    listed = text.startswith("[") & text.contains("][") & ~_holds_any(text, ("GlcNAc", "Gal", "Man"))
    bad = _holds_any(F.lower(text), [p.lower() for p in IMPLAUSIBLE]) | listed
    brackets = (text.contains("(") & text.contains(")")) | (text.contains("[") & text.contains("]"))
    return F.coalesce((F.trim(text) != "") & ~bad & (_holds_any(text, PLAUSIBLE) | brackets), F.lit(False))


def structural_families(column: str) -> Column:
    """Array of the families of a canonical sequence, in a fixed order; empty if there is none."""
    text = F.col(column)
    rules = (
        ("N-glycan-like", likely_n_glycan(column)), ("sialylated", _holds_any(text, SIALIC_ACIDS)), ("fucosylated", _holds_any(text, ("Fuc", "dHex"))),
        ("GalNAc-bearing", text.contains("GalNAc")), ("ambiguous-linkage", text.contains("?")), ("branched", text.contains("[")),
        ("core-GlcNAc", text.contains("GlcNAc(b1-4)GlcNAc")),
    )
    return F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))


def mentions_cancer(column: str) -> Column:
    """Whether a text holds one of the cancer words, whatever its case; NULL does not."""
    return F.coalesce(_holds_any(F.lower(F.col(column)), CANCER_WORDS), F.lit(False))


def shorten_label(column: str, width: int = 55) -> Column:
    """The text cut to ``width`` with an ellipsis; 'NA' for NULL."""
    text = F.col(column)
    return F.when(text.isNull(), "NA").when(F.length(text) > width, F.concat(F.substring(text, 1, width - 3), F.lit("..."))).otherwise(text)


def interpretable_tokens(column: str) -> Column:
    """RES_ residues, LNK_ linkages, brackets and PAIR_ neighbours of residues of a canonical sequence, in this order; NULL
    has none."""
    text = F.coalesce(F.col(column), F.lit(""))
    linkages = F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), F.lit(1))
    bracket = lambda sign, name: F.array_repeat(F.lit(name), F.regexp_count(text, F.lit(sign)))

    def tokens(residues: Column) -> Column:
        n = F.greatest(F.size(residues) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(residues, F.lit(1), n), F.slice(residues, F.lit(2), n), lambda a, b: F.concat(F.lit("PAIR_"), a, F.lit("__"), b))
        return F.concat(
            F.transform(residues, lambda r: F.concat(F.lit("RES_"), r)), F.transform(linkages, lambda x: F.concat(F.lit("LNK_"), x)),
            bracket(r"\[", "BRANCH_OPEN"), bracket(r"\]", "BRANCH_CLOSE"), pairs,
        )

    return let(F.regexp_extract_all(text, F.lit("|".join(RESIDUES)), F.lit(0)), tokens)


def token_counts(df: DataFrame, row_id: str, tokens: str, *, max_n: int = 1, min_df: int = 1) -> DataFrame:
    """row_id, token, n: n-gram counts of an array column in long form, for n-grams in at least ``min_df`` rows.

    Of each token the part up to its last word character counts, as a word pattern would take it.
    """
    words = F.filter(F.transform(tokens, lambda t: F.when(t.rlike(r"(?U)\W$"), F.regexp_replace(t, r"(?U)\W+$", "")).otherwise(t)), lambda t: t != "")
    rows = once(df.select(row_id, tokens), __t=words)
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.size("__t") - (n - 1)), lambda i: F.array_join(F.slice("__t", i, F.lit(n)), " "))
    none = F.array().cast("array<string>")
    every = F.col("__t") if max_n == 1 else F.concat("__t", *[F.when(F.size("__t") >= n, grams(n)).otherwise(none) for n in range(2, max_n + 1)])
    counts = rows.select(row_id, F.explode(every).alias("token")).groupBy(row_id, "token").agg(F.count(F.lit(1)).alias("n"))
    if min_df > 1:
        counts = cut_lineage(counts)
        counts = counts.join(counts.groupBy("token").count().where(F.col("count") >= min_df).select("token"), "token", "left_semi")
    return counts.select(row_id, "token", "n")


#: Names with their counts in any notation: 'Hex': 5, Hex=5, Hex(5), Hex 5, ('Hex', 5). A word is tried once, from its
#: start or from the end of the count before it, so that long words cost no more than short ones.
COMPOSITION_ITEM = r"""(?:\G|(?<![\p{L}\p{N}_-]))[\p{N}_-]*+([\p{L}][\p{L}\p{N}_-]*+)["']?\s*(?:[:=,(]|\s)\s*(\d+)"""
# Composition parts with a column of their own.
COMPOSITION_PARTS = ("Hex", "HexNAc", "dHex", "Neu5Ac", "Neu5Gc", "Kdn", "Fuc", "Xyl", "Gal", "Glc", "Man", "GalNAc", "GlcNAc")


def with_composition(df: DataFrame, column: str, into: str = "parts") -> DataFrame:
    """Add ``into``: array<struct<name, n>> of a composition text, names in lower case with summed counts, in name order.

    Null, blank and unreadable texts give an empty array; a count that fits no bigint counts 0.
    """
    out = once(df, __lower=F.lower(F.coalesce(F.col(column), F.lit(""))))
    item = lambda i: F.regexp_extract_all("__lower", F.lit(COMPOSITION_ITEM), F.lit(i))
    numbers = F.transform(item(2), lambda n: F.coalesce(n.try_cast("bigint"), F.lit(0).cast("bigint")))
    out = once(out, __pairs=F.arrays_zip(item(1).alias("name"), numbers.alias("n")))
    out = once(out, __names=F.array_sort(F.array_distinct(F.col("__pairs.name"))))
    total = lambda name: F.aggregate(F.filter("__pairs", lambda p: p["name"] == name), F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])
    return once(out, **{into: F.transform("__names", lambda name: F.struct(name.alias("name"), total(name).alias("n")))}).drop("__lower", "__pairs", "__names")


def with_composition_features(df: DataFrame, column: str, parts: Sequence[str] = COMPOSITION_PARTS) -> DataFrame:
    """Add comp_<part> counts (0 where absent), totals of residues, fucose and sialic acids, and the shares of fucose and
    sialic acids in all residues and of HexNAc to Hex (0 where the divisor is)."""
    out = with_composition(df, column, "__parts")
    own = {f"comp_{part}": F.coalesce(F.get(F.filter("__parts", lambda p: p["name"] == part.lower()), F.lit(0))["n"], F.lit(0)) for part in parts}  # noqa: B023
    total = F.aggregate("__parts", F.lit(0).cast("bigint"), lambda acc, p: acc + p["n"])
    out = out.withColumns(own | {"comp_total_residues": total}).drop("__parts")
    some = lambda *names: sum((F.col(f"comp_{n}") for n in names if n in parts), F.lit(0).cast("bigint"))
    out = out.withColumn("comp_fucose_total", some("dHex", "Fuc")).withColumn("comp_sialic_total", some("Neu5Ac", "Neu5Gc", "Kdn"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return out.withColumns({
        "comp_fucose_ratio": share(F.col("comp_fucose_total"), F.col("comp_total_residues")), "comp_sialic_ratio": share(F.col("comp_sialic_total"), F.col("comp_total_residues")),
        "comp_hexnac_to_hex_ratio": share(some("HexNAc"), some("Hex")),
    })


def composition_features(df: DataFrame, row_id: str, column: str, parts: Sequence[str] = COMPOSITION_PARTS) -> DataFrame:
    """row_id and the composition's counts, totals and shares."""
    return with_composition_features(df.select(row_id, F.col(column).alias("__c")), "__c", parts).drop("__c")


def split_plausible(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a plausible sequence, the others)."""
    return df.where(plausible_sequence(column)), df.where(~plausible_sequence(column))


def joined_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add <column>_norm, the sorted distinct values of a packed text joined by ' | ' (NULL if there is none), and
    has_<column> (0 or 1)."""
    out = df
    for c in columns:
        out = split_packed(out, c, "__items")
        out = once(out, **{f"{c}_norm": F.array_join(F.array_sort(F.array_distinct("__items")), " | "), f"has_{c}": (F.size("__items") > 0).cast("int")}).drop("__items")
        out = out.withColumn(f"{c}_norm", F.when(F.col(f"has_{c}") == 1, F.col(f"{c}_norm")))
    return out


def joined_labels(column: str) -> Column:
    """The labels of a text joined by ' | ', as an array; empty for NULL, blank and null-like texts."""
    text = F.trim(F.coalesce(F.col(column), F.lit("")))
    labels = F.filter(F.transform(F.split(text, r" \| "), F.trim), lambda x: x != "")
    return F.when(F.lower(text).isin("", "nan", "none", "na"), F.array().cast("array<string>")).otherwise(labels)


def sequence_qc(df: DataFrame, column: str) -> DataFrame:
    """plausible and n_rows, n_distinct of each kind."""
    return df.groupBy(plausible_sequence(column).alias("plausible")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(column).alias("n_distinct"))
