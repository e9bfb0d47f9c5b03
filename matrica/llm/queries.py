"""Queries of the problems 2, 4, 5, 6, 8, 9 and 10 over the project's tables, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrica.functions.keys import tidy_key
from matrica.llm.duplicates import collapse_duplicates, composition_key, letters_and_digits
from matrica.llm.encoding import decode_ids, encode_texts
from matrica.llm.groups import connected_groups
from matrica.llm.languages import document_languages, fit_languages, language_of, language_segments
from matrica.llm.mixing import Target, holdout_accuracy, mix_sources, mixture_shares
from matrica.llm.quantiles import grouped_quantiles, merge_sketches, merged_sketches, rank_check, sketch_quantiles
from matrica.llm.terms import mark_terms, ngram_counts
from matrica.operators.packed import split_packed
from matrica.operators.sequences import COMPOSITION_ITEM
from matrica.sources import read_table

PERCENTILES = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p2_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of total_signal per class and batch and, merged from those sketches, per class; of median per class."""
    metrics = read_table(spark, sf, "sample_metrics")
    per_batch = merged_sketches(metrics, ["class", "batch"], "total_signal")
    per_batch = per_batch.withColumn("measure", F.lit("total_signal"))
    keys = ["measure", "class", "batch"]
    # A batch is one more level of the merge tree: groups of batches first, then the whole class.
    level = per_batch.withColumn("part", F.pmod(F.xxhash64("batch"), F.lit(32**3)).cast("int"))
    per_class = merge_sketches(level, ["measure", "class"], 32**3).withColumn("batch", F.lit(None).cast("bigint"))
    medians = read_table(spark, sf, "threshold_table")
    table = merged_sketches(medians, ["class"], "median")
    table = table.withColumn("measure", F.lit("threshold_median")).withColumn("batch", F.lit(None).cast("bigint"))
    return sketch_quantiles(per_batch.unionByName(per_class).unionByName(table), keys, PERCENTILES)


def p2_months(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles of total_signal per class over all months, merged from sketches of the months."""
    metrics = read_table(spark, sf, "sample_metrics").withColumn("month", F.date_format("computed_at", "yyyy-MM"))
    months = merged_sketches(metrics, ["class", "month"], "total_signal")
    level = months.withColumn("part", F.pmod(F.xxhash64("month"), F.lit(32**3)).cast("int"))
    return sketch_quantiles(merge_sketches(level, ["class"], 32**3), ["class"], PERCENTILES)


def p2_error_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the percentiles per class keep their stated rank error against the exact ranks."""
    metrics = read_table(spark, sf, "sample_metrics")
    estimates = grouped_quantiles(metrics, ["class"], "total_signal", PERCENTILES)
    return rank_check(metrics, estimates, ["class"], "total_signal")


def _groups(spark: SparkSession, sf: str) -> DataFrame:
    pairs = read_table(spark, sf, "feature_redundancy").select(tidy_key("feature", upper=True).alias("a"), tidy_key("representative_feature", upper=True).alias("b"))
    return connected_groups(pairs, "a", "b")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf).where("vertex <> group").select(F.col("group").alias("group_feature"), F.col("vertex").alias("feature"))


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every feature of feature_metadata with its group; a feature without links is a group of its own."""
    features = read_table(spark, sf, "feature_metadata").select(tidy_key("feature", upper=True).alias("feature")).where("feature is not null")
    groups = _groups(spark, sf).select(F.col("vertex").alias("feature"), F.col("group").alias("g"))
    return features.join(groups, "feature", "left").select("feature", F.coalesce("g", "feature").alias("group_feature"))


def _terms(spark: SparkSession, sf: str) -> DataFrame:
    records = read_table(spark, sf, "glycan_list")
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    species = split_packed(records.select("tissue_species"), "tissue_species").select(F.lit("tissue_species").alias("field"), lower("items").alias("terms"))
    names = records.select(F.lit("composition").alias("field"), lower(F.regexp_extract_all("composition", F.lit(COMPOSITION_ITEM), F.lit(1))).alias("terms"))
    counted = [ngram_counts(rows, "terms").withColumn("field", F.lit(field)) for field, rows in (("tissue_species", species), ("composition", names))]
    return mark_terms(counted[0].unionByName(counted[1]), records.agg(F.count(F.lit(1)).alias("total")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _terms(spark, sf).where("n = 1 and mark is not null").select("field", F.col("ngram")[0].alias("term"), "mark")


def p5_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and records of every term."""
    return _terms(spark, sf).where("n = 1").select("field", F.col("ngram")[0].alias("term"), "occurrences", "records", "mark")


def p5_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and records of all runs of terms, of every length."""
    return _terms(spark, sf).select("field", F.array_join("ngram", " | ").alias("term"), "n", "occurrences", "records", "mark")


def _collapsed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return collapse_duplicates(read_table(spark, sf, "glycan_list"), "gly_id", [letters_and_digits("glycan"), composition_key("composition")])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _collapsed(spark, sf)[1].where("row_id <> first_id").select("first_id", F.col("row_id").alias("copy_id"))


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record of each group with its number of copies."""
    return _collapsed(spark, sf)[0].select(F.col("first_id").alias("gly_id"), "copies")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(read_table(spark, sf, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts decoded from their ids: their lengths and hashes are those of the texts."""
    texts = decode_ids(p8_ids(spark, sf), "doc_id", "ids")
    return texts.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("md5"))


def _mixture(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "mix_targets").orderBy("source").collect()  # a short list that does not grow
    targets = [Target(r["source"], r["target_share"], r["max_repeats"]) for r in rows]
    return mix_sources(read_table(spark, sf, "documents"), "doc_id", "text", "source", targets)


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf)


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of tokens of each source."""
    return mixture_shares(_mixture(spark, sf), read_table(spark, sf, "mix_targets"))


def p9_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out accuracy of the classifier that the mixture's posteriors come from."""
    names = [r["source"] for r in read_table(spark, sf, "mix_targets").orderBy("source").collect()]  # a short list that does not grow
    return holdout_accuracy(read_table(spark, sf, "documents"), "doc_id", "text", "source", names).withColumn("accuracy", F.round("accuracy", 4))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    documents = read_table(spark, sf, "documents")
    return language_segments(documents, "doc_id", "text", fit_languages(documents, "text", "lang", key="doc_id"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    present = _segments(spark, sf).where("n_sentences >= 2").select("doc_id", "lang").distinct()
    named = read_table(spark, sf, "documents").select("doc_id", language_of("lang").alias("named"))
    return present.join(named, "doc_id").where(~F.col("lang").eqNullSafe(F.col("named"))).select("doc_id", "lang")


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment of every document with its language and confidence."""
    return _segments(spark, sf).withColumn("confidence", F.round("confidence", 6))


def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Main language of every document with text."""
    out = document_languages(_segments(spark, sf), "doc_id")
    return out.withColumn("confidence", F.round("confidence", 6)).withColumn("share", F.round("share", 6))


QUERIES = {
    f.__name__: f
    for f in (
        p2_percentiles, p2_months, p2_error_check, p4_found, p4_groups, p5_found, p5_terms, p5_ngrams, p6_found, p6_records,
        p8_ids, p8_round_trip, p9_mixture, p9_shares, p9_classifier, p10_found, p10_segments, p10_documents,
    )
}

_GROUPS = """
WITH RECURSIVE links AS (
  SELECT upper(trim(feature, ' ' || chr(9))) AS a, upper(trim(representative_feature, ' ' || chr(9))) AS b FROM feature_redundancy
  WHERE trim(feature, ' ' || chr(9)) <> '' AND trim(representative_feature, ' ' || chr(9)) <> ''),
both_ways AS (SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b),
reach AS (SELECT a AS v, a AS w FROM both_ways UNION SELECT reach.v, b FROM reach JOIN both_ways ON reach.w = both_ways.a),
groups AS (SELECT v, min(w) AS g FROM reach GROUP BY v)
"""
_KEYS = r"""
WITH parts AS (
  SELECT gly_id, regexp_replace(lower(glycan), '[^\p{L}\p{N}]+', '', 'g') AS g,
    CASE WHEN composition IS NULL OR regexp_replace(composition, '\s+', '', 'g') = '' THEN '' ELSE lower(composition) END AS c FROM glycan_list),
items AS (
  SELECT gly_id, unnest(regexp_extract_all(c, '([\p{L}][\p{L}\p{N}_-]*)["'']?\s*(?:[:=,(]|\s)\s*(\d+)', 1)) AS name,
    unnest(regexp_extract_all(c, '([\p{L}][\p{L}\p{N}_-]*)["'']?\s*(?:[:=,(]|\s)\s*(\d+)', 2))::BIGINT AS k FROM parts),
summed AS (SELECT gly_id, name, sum(k) AS k FROM items GROUP BY 1, 2),
joined AS (SELECT gly_id, string_agg(name || '=' || k, ';' ORDER BY name) AS c FROM summed GROUP BY 1),
keyed AS (SELECT gly_id, g, coalesce(joined.c, CASE WHEN parts.c = '' THEN '' ELSE '?' || regexp_replace(parts.c, '[^\p{L}\p{N}]+', '', 'g') END) AS c FROM parts LEFT JOIN joined USING (gly_id)),
firsts AS (SELECT gly_id, min(gly_id) OVER (PARTITION BY g, c) AS first_id FROM keyed)
"""

ORACLE = {
    "p2_error_check": f"""
SELECT class, q, count(*) FILTER (WHERE isfinite(total_signal)) AS n, TRUE AS within
FROM sample_metrics CROSS JOIN (SELECT unnest({PERCENTILES}) AS q) GROUP BY 1, 2
""",
    "p4_found": _GROUPS + "SELECT g AS group_feature, v AS feature FROM groups WHERE v <> g",
    "p4_groups": _GROUPS + "SELECT upper(trim(feature, ' ' || chr(9))) AS feature, coalesce(g, upper(trim(feature, ' ' || chr(9)))) AS group_feature FROM feature_metadata LEFT JOIN groups ON v = upper(trim(feature, ' ' || chr(9)))",
    "p6_found": _KEYS + "SELECT first_id, gly_id AS copy_id FROM firsts WHERE gly_id <> first_id",
    "p6_records": _KEYS + "SELECT first_id AS gly_id, count(*) AS copies FROM firsts GROUP BY 1",
    "p8_round_trip": "SELECT doc_id, coalesce(length(text), 0) AS n_chars, md5(coalesce(text, '')) AS md5 FROM documents",
}
