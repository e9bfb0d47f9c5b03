"""Queries of the general data problems (1, 3, 7) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrica.operators.orphans import Reference, Relation, orphan_cascade, orphan_report
from matrica.operators.packed import explode_packed
from matrica.operators.spikes import flag_readings, implausible
from matrica.sources import read_table

PACKED_FIELDS = ["tissue_species", "tissue_sample"]


def _relations(spark: SparkSession, sf: str) -> list[Relation]:
    return [
        Relation("acquisition_list", read_table(spark, sf, "acquisition_list"), "acq_id", "sample", None, "registered_at", "deleted_at"),
        Relation("sample_metrics", read_table(spark, sf, "sample_metrics"), "row_id", "sample", "computed_at"),
        Relation("sample_manifest", read_table(spark, sf, "sample_manifest"), "manifest_id", "sample", "listed_at"),
    ]


_TO_ACQUISITION = [Reference("sample_metrics", "sample", "acquisition_list"), Reference("sample_manifest", "sample", "acquisition_list")]
_CHAIN = [Reference("sample_metrics", "sample", "acquisition_list"), Reference("sample_manifest", "sample", "sample_metrics")]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_cascade(_relations(spark, sf), _TO_ACQUISITION).select("table_name", "ref_period", "row_id")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(orphan_cascade(_relations(spark, sf), _TO_ACQUISITION))


def p1_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """Direct and inherited orphans where manifest rows refer to metrics rows and those to acquisitions."""
    return orphan_report(orphan_cascade(_relations(spark, sf), _CHAIN))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return explode_packed(read_table(spark, sf, "glycan_list"), "gly_id", PACKED_FIELDS, at_least=2)


def p3_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every value of the packed fields, single ones too."""
    return explode_packed(read_table(spark, sf, "glycan_list"), "gly_id", PACKED_FIELDS)


def _flags(spark: SparkSession, sf: str, rounds: int | None = None) -> DataFrame:
    return flag_readings(read_table(spark, sf, "sample_metrics"), row_id="row_id", value="total_signal", series="batch", order="run_order", group="class", max_iterations=rounds)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Impossible, stuck and far readings. The ellipsoid leaves out none of the far ones, so its rounds are p7_flags' alone."""
    return implausible(_flags(spark, sf, rounds=0)).select("row_id")


def p7_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Every flag of every reading that has one, phase-space spikes of all rounds included."""
    flags = _flags(spark, sf).where(F.col("impossible") | F.col("stuck") | F.col("spike_iteration").isNotNull())
    return flags.select("row_id", F.col("series").alias("batch"), F.col("group").alias("class"), "impossible", "stuck", "spike_iteration", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_cascade, p3_found, p3_values, p7_found, p7_flags)}

_ORPHANS = """
WITH acq AS (SELECT lower(trim(sample, ' ' || chr(9))) AS k, registered_at AS a, deleted_at AS b FROM acquisition_list),
refs AS (
  SELECT 'sample_metrics' AS table_name, lower(trim(sample, ' ' || chr(9))) AS k, computed_at AS t, row_id FROM sample_metrics
  UNION ALL SELECT 'sample_manifest', lower(trim(sample, ' ' || chr(9))), listed_at, manifest_id FROM sample_manifest),
orphans AS (
  SELECT table_name, strftime(t, '%Y-%m') AS ref_period, row_id FROM refs
  WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM acq WHERE acq.k = refs.k AND a <= refs.t AND (b IS NULL OR b > refs.t)))
"""

ORACLE = {
    "p1_found": _ORPHANS + "SELECT * FROM orphans",
    "p1_report": _ORPHANS + "SELECT table_name, ref_period, 'direct' AS kind, count(*) AS n_rows FROM orphans GROUP BY 1, 2",
    "p1_cascade": """
WITH acq AS (SELECT lower(trim(sample, ' ' || chr(9))) AS k, registered_at AS a, deleted_at AS b FROM acquisition_list),
met AS (SELECT lower(trim(sample, ' ' || chr(9))) AS k, computed_at AS t FROM sample_metrics WHERE trim(sample, ' ' || chr(9)) <> ''),
judged AS (SELECT k, t, NOT EXISTS (SELECT 1 FROM acq WHERE acq.k = met.k AND a <= met.t AND (b IS NULL OR b > met.t)) AS orphan FROM met),
held AS (SELECT k, bool_and(orphan) AS dead FROM judged GROUP BY k),
man AS (SELECT lower(trim(sample, ' ' || chr(9))) AS k, listed_at AS t FROM sample_manifest WHERE trim(sample, ' ' || chr(9)) <> ''),
every AS (
  SELECT 'sample_metrics' AS table_name, t, 'direct' AS kind FROM judged WHERE orphan
  UNION ALL SELECT 'sample_manifest', man.t, CASE WHEN held.k IS NULL THEN 'direct' ELSE 'inherited' END
  FROM man LEFT JOIN held ON man.k = held.k WHERE held.k IS NULL OR held.dead)
SELECT table_name, strftime(t, '%Y-%m') AS ref_period, kind, count(*) AS n_rows FROM every GROUP BY 1, 2, 3
""",
    "p7_found": """
WITH r AS (SELECT row_id, batch, class, run_order, total_signal AS x,
  total_signal < 0 OR isnan(total_signal) OR isinf(total_signal) AS bad FROM sample_metrics),
med AS (SELECT batch, class, median(log10(x + 1)) AS m, count(*) AS n FROM r WHERE NOT bad GROUP BY 1, 2),
dev AS (SELECT r.batch, r.class, median(abs(log10(x + 1) - m)) AS d FROM r JOIN med ON r.batch IS NOT DISTINCT FROM med.batch AND r.class IS NOT DISTINCT FROM med.class WHERE NOT bad GROUP BY 1, 2),
runs AS (SELECT batch, run_order, CASE WHEN count(x) = count(*) AND min(x) = max(x) THEN min(x) END AS v FROM r WHERE run_order IS NOT NULL GROUP BY 1, 2),
marked AS (SELECT *, CASE WHEN v IS NOT NULL AND v = lag(v) OVER (PARTITION BY batch ORDER BY run_order) THEN 0 ELSE 1 END AS s FROM runs),
segs AS (SELECT *, sum(s) OVER (PARTITION BY batch ORDER BY run_order) AS seg FROM marked),
stuck AS (SELECT batch, run_order FROM segs WHERE v IS NOT NULL QUALIFY count(*) OVER (PARTITION BY batch, seg) >= 5)
SELECT row_id FROM r
LEFT JOIN med ON r.batch IS NOT DISTINCT FROM med.batch AND r.class IS NOT DISTINCT FROM med.class
LEFT JOIN dev ON r.batch IS NOT DISTINCT FROM dev.batch AND r.class IS NOT DISTINCT FROM dev.class
LEFT JOIN stuck ON r.batch IS NOT DISTINCT FROM stuck.batch AND r.run_order = stuck.run_order
WHERE x IS NOT NULL AND (bad OR stuck.run_order IS NOT NULL OR (n >= 12 AND abs(log10(x + 1) - m) > 6 * 1.4826 * d))
""",
}
