"""Canonical master of sequence tables: union, full join with a query table, bindings, coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matrica.functions.keys import join_null_safe, once
from matrica.operators.matrix import key_values
from matrica.operators.sequences import SYNONYMS, canonical_exact, canonical_topology, joined_values, likely_n_glycan, normalise_text, plausible_sequence, sequence_statistics, with_composition_features
from matrica.session import cut_lineage
from matrica.sources.tables import resolve_column

# Synonyms of the protein column, and numeric types.
PROTEIN = ("protein", "lectin", "target", "gene", "name", "protein_name")
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def grouped_reference(tables: Sequence[DataFrame], columns: Sequence[str], *, key: str = "glycan_sequence") -> DataFrame:
    """One row per sequence over tables in order of precedence: first non-null value of each column, the largest
    is_n_glycan, and the sorted distinct source names joined by bars. Equal ranks give the smallest value."""
    rows = reduce(DataFrame.unionByName, [t.select(key, *columns, "source_name", "is_n_glycan", F.lit(i).alias("__rank")) for i, t in enumerate(tables)])
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct("__rank", c)))[c].alias(c) for c in columns]
    return rows.groupBy(key).agg(*first, F.max("is_n_glycan").alias("is_n_glycan"), F.array_join(F.array_sort(F.collect_set("source_name")), "|").alias("source_names"))


def canonical_master(reference: DataFrame, query: DataFrame, columns: Sequence[str], *, key: str = "glycan_sequence") -> DataFrame:
    """Full outer join of both on the sequence: the query's values first, then the reference's, with in_reference and
    in_query flags (0 or 1). Both sides must have one row per sequence."""
    a = query.select(key, *[F.col(c).alias(f"q_{c}") for c in columns], F.lit(1).alias("in_query"))
    b = reference.select(key, *[F.col(c).alias(f"r_{c}") for c in columns], "is_n_glycan", "source_names", F.lit(1).alias("in_reference"))
    out = a.join(b, key, "full")
    return out.select(key, *[F.coalesce(f"q_{c}", f"r_{c}").alias(c) for c in columns], "source_names", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("is_n_glycan", "in_query", "in_reference")])


def standardise_binding(df: DataFrame) -> DataFrame:
    """glycan_sequence, protein, binding_value of a binding table in long or wide form.

    Long: columns for sequence and protein (by synonym) and values in the first numeric column, 1 where there is none.
    Wide: a protein column and one numeric column per sequence, NULL cells left out. ValueError for any other form.
    Null-like names are left out.
    """
    protein = resolve_column(df, PROTEIN)
    sequence = resolve_column(df, SYNONYMS["sequence"])
    numeric = [c for c, kind in df.dtypes if kind in NUMERIC or kind.startswith("decimal")]
    if sequence and protein:
        values = [c for c in numeric if c not in (sequence, protein)]
        value = F.col(f"`{values[0]}`").cast("double") if values else F.lit(1.0)
        out = df.select(normalise_text(f"`{sequence}`").alias("glycan_sequence"), normalise_text(f"`{protein}`").alias("protein"), value.alias("binding_value"))
    elif protein and numeric:
        rows = df.select(normalise_text(f"`{protein}`").alias("protein"), *[F.col(f"`{c}`").cast("double").alias(c) for c in numeric])
        out = rows.unpivot("protein", [f"`{c}`" for c in numeric], "glycan_sequence", "binding_value").where("binding_value is not null and not isnan(binding_value)")
        out = out.select(normalise_text("glycan_sequence").alias("glycan_sequence"), "protein", "binding_value")
    else:
        raise ValueError("neither a long binding table nor a wide numeric one")
    return out.where("glycan_sequence is not null and protein is not null")


def _bound(binding: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The keys, protein and sums (n, n_values, total, most) of every sequence and protein; each sequence's keys are made
    once, not once a row of binding."""
    value = F.col("binding_value")
    per = binding.groupBy("glycan_sequence", "protein").agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), F.sum(value).alias("total"), F.max(value).alias("most"))
    held = per.groupBy("glycan_sequence").agg(F.collect_list(F.struct("protein", "n", "n_values", "total", "most")).alias("p"))  # one entry a protein
    return cut_lineage(once(held, **keys).select(*keys, F.inline("p")))


def canonical_features(master: DataFrame, binding: DataFrame) -> DataFrame:
    """The canonical master: keys, joined metadata, statistics, composition features and binding of every sequence.

    master: glycan_sequence (one row each), composition, tissue_sample, tissue_species, disease, is_n_glycan, in_query,
    in_reference; binding: glycan_sequence, protein, binding_value. Binding is summed by canonical sequence and by
    topology; sequences without any have zeros; a NULL key meets the NULL key.
    """
    keys = {"canonical_sequence": canonical_exact("glycan_sequence"), "topology_key": canonical_topology("glycan_sequence")}
    out = joined_values(once(master, **keys), ["tissue_sample", "tissue_species", "disease"])
    out = out.withColumn("likely_n_glycan", F.coalesce(likely_n_glycan("canonical_sequence"), F.lit(False)).cast("int")).withColumns(sequence_statistics("canonical_sequence"))
    out = with_composition_features(out, "composition")
    bound = _bound(binding, keys)
    rows, proteins = F.sum("n"), F.count_distinct("protein")
    mean = F.try_divide(F.sum("total").cast("double"), F.sum("n_values"))
    exact = bound.groupBy("canonical_sequence").agg(rows.alias("n_binding_rows"), proteins.alias("n_binding_proteins"), mean.alias("mean_binding_value"), F.max("most").alias("max_binding_value"))
    topology = bound.groupBy("topology_key").agg(rows.alias("n_binding_rows_topology"), proteins.alias("n_binding_proteins_topology"))
    out = join_null_safe(join_null_safe(out, exact, ["canonical_sequence"]), topology, ["topology_key"])
    out = out.na.fill(0, ["n_binding_rows", "n_binding_proteins", "n_binding_rows_topology", "n_binding_proteins_topology"]).na.fill(0.0, ["mean_binding_value", "max_binding_value"])
    flags = {"has_binding_exact": F.col("n_binding_rows") > 0, "has_binding_topology": F.col("n_binding_rows_topology") > 0}
    out = out.withColumns({name: flag.cast("int") for name, flag in flags.items()})
    return out.withColumn("discovered_flag", F.col("in_query").cast("int")).withColumn("reference_flag", F.col("in_reference").cast("int"))


def master_summary(master: DataFrame) -> DataFrame:
    """metric and value: sequences, found and bound ones, and the shares with metadata, over a canonical master."""
    share = {f"fraction_with_{c}": F.avg(f"has_{c}") for c in ("tissue_sample", "tissue_species", "disease")}
    return key_values(master, {
        "n_unique_sequences": F.count_distinct("canonical_sequence"), "n_discovered": F.sum("discovered_flag"), "n_exact_binding": F.sum("has_binding_exact"),
        **share, "fraction_likely_n_glycan": F.avg("likely_n_glycan"),
    })


def interpretation_set(master: DataFrame, *, supported: bool = True, plausible: bool = True) -> DataFrame:
    """One row per canonical sequence that is plausible and, if asked, in the reference or the query table.

    Of repeated canonical sequences the one with the smallest original text stays.
    """
    out = master
    if plausible:
        out = out.where(plausible_sequence("canonical_sequence"))
    if supported:
        out = out.where("reference_flag = 1 or discovered_flag = 1")
    rest = [c for c in out.columns if c != "canonical_sequence"]
    first = F.min_by(F.struct(*rest), "glycan_sequence")
    return out.groupBy("canonical_sequence").agg(first.alias("f")).select("canonical_sequence", *[f"f.{c}" for c in rest])


def interpretation_summary(rows: DataFrame) -> DataFrame:
    """metric and value of an interpretation set: all rows and those of each kind."""
    flags = {
        "n_discovered": "discovered_flag", "n_reference": "reference_flag", "n_n_glycans": "is_n_glycan", "n_likely_n_glycans": "likely_n_glycan", "n_binding_exact": "has_binding_exact",
        "n_species_labelled": "has_tissue_species", "n_sample_labelled": "has_tissue_sample", "n_disease_labelled": "has_disease",
    }
    return key_values(rows, {"n_total": F.count(F.lit(1))} | {name: F.coalesce(F.sum(c), F.lit(0)) for name, c in flags.items()})


def audit_sources(sources: dict[str, DataFrame], columns: Sequence[str], *, key: str = "glycan_sequence") -> DataFrame:
    """source, metric, value: rows, distinct keys and the share of rows with each column, of every source table.

    Beside the sources, ``union`` counts the distinct keys of all, and ``<a> & <b>`` those that two share.
    """
    keys = {name: df.select(key).where(F.col(key).isNotNull()).distinct() for name, df in sources.items()}
    parts = []
    for name, df in sources.items():
        share = {f"fraction_with_{c}": F.avg(F.col(c).isNotNull().cast("int")) for c in columns if c in df.columns}
        parts.append(key_values(df, {"n_rows": F.count(F.lit(1)), "n_unique": F.count_distinct(key), **share}).select(F.lit(name).alias("source"), "metric", "value"))
    held = reduce(DataFrame.unionByName, [k.withColumn("s", F.lit(i)) for i, k in enumerate(keys.values())]).groupBy(key).agg(F.collect_set("s").alias("s"))
    names = list(sources)
    both = {f"{a} & {b}": F.count_if(F.array_contains("s", i) & F.array_contains("s", j)) for i, a in enumerate(names) for j, b in enumerate(names) if i < j}
    shared = key_values(held, {"union": F.count(F.lit(1)), **both}).select(F.col("metric").alias("source"), F.lit("n_unique").alias("metric"), "value")
    return reduce(DataFrame.unionByName, [*parts, shared])


def binding_aggregates(master: DataFrame, binding: DataFrame, key: str, prefix: str) -> DataFrame:
    """master with the number of proteins and the mean and largest binding value of its key; NULL keys match NULL."""
    sums = binding.groupBy(F.col(key).alias("__key")).agg(F.count_distinct("protein").alias(f"{prefix}_n_proteins"), F.avg("binding_value").alias(f"{prefix}_mean"), F.max("binding_value").alias(f"{prefix}_max"))
    out = master.join(sums, master[key].eqNullSafe(sums["__key"]), "left").drop("__key")
    return out.na.fill(0, [f"{prefix}_n_proteins"]).withColumn(f"has_binding_{prefix}", (F.col(f"{prefix}_n_proteins") > 0).cast("int"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, n_rows, n_present, share_present, n_distinct of each column."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    rows = df.select(F.explode(parts).alias("p")).select("p.*")
    return rows.groupBy("column").agg(F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_present"), (F.count("v") / F.count(F.lit(1))).alias("share_present"), F.count_distinct("v").alias("n_distinct"))


def overlap_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """metric and n: distinct keys of either table, shared ones, and those of one only."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct().withColumn("a", F.lit(1))
    b = right.select(key).where(F.col(key).isNotNull()).distinct().withColumn("b", F.lit(1))
    sums = a.join(b, key, "full").agg(F.count("a").alias("left"), F.count("b").alias("right"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))
    return sums.unpivot([], sums.columns, "metric", "n")


def modelling_subset(master: DataFrame, chosen: str, labelled: str, n_background: int, *, key: str, seed: int = 42) -> DataFrame:
    """Chosen and labelled rows and ``n_background`` others that come first in a hash order; kind says which."""
    kind = F.when(F.col(chosen), "chosen").when(F.col(labelled), "labelled").otherwise("background")
    rows = master.withColumn("kind", kind)
    background = rows.where("kind = 'background'").orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n_background)
    return rows.where("kind <> 'background'").unionByName(background)


def handoff(query: DataFrame, targets: DataFrame | None, *, sequence: str = "glycan_sequence", keys: Sequence[str] = ("feature", "sample"), tier: str = "target_tier") -> tuple[DataFrame, str]:
    """(query with the targets' tier, mode). The mode follows from the columns at hand, when the plan is built.

    'provisional' without targets, 'id' over the first shared key column, 'sequence' over the sequence, else
    'no_mapping'; rows without a target keep a NULL tier. Targets must not repeat the key; a repeated one gives its
    smallest tier.
    """
    if targets is None:
        return query.withColumn(tier, F.lit(None).cast("string")), "provisional"
    shared = [k for k in keys if k in query.columns and k in targets.columns]
    on, mode = (shared[0], "id") if shared else (sequence, "sequence") if sequence in targets.columns else (None, "no_mapping")
    if on is None:
        return query.withColumn(tier, F.lit(None).cast("string")), mode
    return query.join(targets.groupBy(on).agg(F.min(tier).alias(tier)), on, "left"), mode


def validation_feasibility(df: DataFrame, tasks: dict[str, Column]) -> DataFrame:
    """task, n_eligible, fraction: the rows on which each validation task can be run, in one scan."""
    parts = F.array(*[F.struct(F.lit(k).alias("task"), F.count_if(F.coalesce(c, F.lit(False))).alias("n_eligible")) for k, c in tasks.items()])
    sums = df.agg(parts.alias("t"), F.count(F.lit(1)).alias("n"))
    return sums.select(F.explode("t").alias("t"), "n").select("t.*", F.coalesce(F.try_divide(F.col("t.n_eligible"), F.col("n")), F.lit(0.0)).alias("fraction"))


def balanced_sample(df: DataFrame, label: str, *, key: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each label, those that come first in a hash order of the key; all rows of smaller labels.

    A row's place is found in two steps: an approximate cut of the hash leaves a little over ``n`` rows of each label,
    and only those are ranked, so no task orders a whole label. Rows without label take no part.
    """
    turn = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    sizes = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    # With a margin of six standard deviations the cut leaves n rows; ranked() below makes it n exactly.
    share = F.least(F.lit(1.0), (n + 6 * F.sqrt(F.lit(float(n))) + 20) / F.col("__n"))
    near = df.withColumn("__turn", turn).join(sizes, F.col(label) == F.col("__l")).where(F.col("__turn") < share * float(1 << 40))
    place = F.row_number().over(Window.partitionBy("__l").orderBy("__turn", key))
    return near.withColumn("__place", place).where(F.col("__place") <= n).drop("__l", "__n", "__turn", "__place")
