"""How the star-schema tables play the parts of the feature-matrix model in the registered queries.

sample: supplier; class: its region; batch: odd or even supplier; run_order: its key; feature: part brand; intensity:
revenue in UNITs. sequence-like and vector tables are glycan_list and embeddings. Every table is read whole.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrica.operators import master, sequences
from matrica.operators.pairs import RedundancyRules
from matrica.session import cut_lineage
from matrica.sources import read_table

BLANK, QC, DQC, BIO = ["AFRICA"], ["AMERICA"], ["ASIA"], ["EUROPE", "MIDDLE EAST"]
CLASSES = [*BLANK, *QC, *DQC, *BIO]
#: Intensity above which a feature counts as detected.
THRESHOLD = 700.0
#: No round decimal divisor, so that no sum lies on the border of two rounded values and hangs on the order of adding.
UNIT = 997.0
TASKS = [("EUROPE", "MIDDLE EAST"), ("ASIA", "EUROPE"), ("AMERICA", "ASIA")]
#: Limits at which every relation occurs among the brands, whose masses and correlations are close to each other.
BRAND_RULES = RedundancyRules(isomer_mz=0.8, isomer_rt=2.0, adduct_rt=1.0, adduct_least_mz=1.0, adduct_most_mz=4.0, duplicate_mz=6.0, duplicate_rt=3.0, report_rho=0.05, join_rho=0.08)
GROUPS = {"biological": BIO, "qc_like": [*QC, *DQC], "blank": BLANK}


#: Parts (key and brand) up to which they are broadcast to lineitem.
PARTS = 2_000_000

#: Tables that the parts of one query have in common, while it is planned; None outside of queries.
_SHARED: ContextVar[dict | None] = ContextVar("shared", default=None)

Plan = Callable[[SparkSession, str], DataFrame]


def sharing(query: Plan) -> Plan:
    """query, in whose course every ``shared`` table is made once; queries that it asks in turn belong to it."""

    @wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        if _SHARED.get() is not None:
            return query(spark, sf)
        token = _SHARED.set({})
        try:
            return query(spark, sf)
        finally:
            _SHARED.reset(token)

    return run


def shared(table: Plan) -> Plan:
    """table, made once in a query (see sharing) and read again by its further parts; afresh for the next query."""

    @wraps(table)
    def made(spark: SparkSession, sf: str) -> DataFrame:
        held = _SHARED.get()
        if held is None:
            return table(spark, sf)
        key = (table.__name__, sf)
        if key not in held:
            held[key] = table(spark, sf)
        return held[key]

    return made


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """sample, class, batch, run_order of every supplier."""
    nation = read_table(spark, sf, "nation").join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    supplier = read_table(spark, sf, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 nations
    return supplier.select(F.col("s_suppkey").alias("sample"), F.col("r_name").alias("class"), (1 + F.col("s_suppkey") % 2).alias("batch"), F.col("s_suppkey").alias("run_order"))


@shared
def observations(spark: SparkSession, sf: str) -> DataFrame:
    """sample, feature, intensity with the sample's class, batch and run_order; written once, as operators read it in
    several branches."""
    brand = read_table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("feature"))
    revenue = read_table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_extendedprice") * (1 - F.col("l_discount")) / UNIT).alias("x"))
    brand = cut_lineage(brand)
    if brand.count() <= PARTS:  # spares a shuffle of lineitem
        brand = F.broadcast(brand)
    sums = revenue.join(brand, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("sample"), "feature").agg(F.sum("x").alias("intensity"))
    return cut_lineage(sums.join(samples(spark, sf), "sample"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    """feature, mz, rt of every brand."""
    return read_table(spark, sf, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("mz"), F.avg("p_size").alias("rt"))


def standards(spark: SparkSession, sf: str) -> DataFrame:
    """compound_id, mz, rt of every part type."""
    return read_table(spark, sf, "part").groupBy(F.col("p_type").alias("compound_id")).agg(F.avg("p_retailprice").alias("mz"), F.avg("p_size").alias("rt"))


def binding(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, protein, binding_value: ship quantities by part and supplier group."""
    return read_table(spark, sf, "lineitem").select(F.col("l_partkey").alias("vec_id"), F.concat(F.lit("P"), F.col("l_suppkey") % 10).alias("protein"), F.col("l_quantity").alias("binding_value"))


#: Sources of glycan_list that play the reference tables, with whether they hold N-glycans; all others are the query table.
REFERENCES = {"df_glycan": False, "n_glycans": True}


def sequence_master(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical master of glycan_list: reference sources united, the others full-joined to them."""
    rows, columns = read_table(spark, sf, "glycan_list"), ["composition", "tissue_species", "tissue_sample", "disease"]
    own = lambda d, name, flag: sequences.standardise_sequences(d, source_name=name, n_glycan=flag)
    reference = master.grouped_reference([own(rows.where(F.col("source_name") == name), name, flag) for name, flag in REFERENCES.items()], columns)
    query = rows.where(~F.coalesce(F.col("source_name").isin(*REFERENCES), F.lit(False)))
    return master.canonical_master(reference, master.grouped_reference([own(query, "glycan_list", False)], columns), columns)


def sequence_binding(spark: SparkSession, sf: str) -> DataFrame:
    """glycan_sequence, protein, binding_value: the bindings of the vector with a sequence's number."""
    rows = read_table(spark, sf, "glycan_list").select(F.col("gly_id").alias("vec_id"), F.col("glycan").alias("glycan_sequence"))
    return master.standardise_binding(binding(spark, sf).join(rows, "vec_id").select("glycan_sequence", "protein", "binding_value"))


_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
SQL_BLANK, SQL_QC, SQL_DQC, SQL_BIO = map(_LIST, (BLANK, QC, DQC, BIO))

SAMPLES_SQL = """samples AS (
  SELECT s_suppkey AS sample, r_name AS class, 1 + s_suppkey % 2 AS batch, s_suppkey AS run_order
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
OBS_SQL = f"""WITH {SAMPLES_SQL},
sums AS (SELECT l_suppkey AS sample, p_brand AS feature, sum(l_extendedprice * (1 - l_discount) / {UNIT}) AS intensity
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
obs AS (SELECT * FROM sums JOIN samples USING (sample)),
feats AS (SELECT p_brand AS feature, avg(p_retailprice) AS mz, avg(p_size) AS rt FROM part GROUP BY 1)
"""
