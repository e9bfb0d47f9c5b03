"""The SQL of the analytics queries, for DuckDB on the same tables."""

from __future__ import annotations

from matrica.operators.pairs import RELATIONS, RedundancyRules
from matrica.plans.model import BRAND_RULES, CLASSES, OBS_SQL, SQL_BIO, SQL_BLANK, SQL_DQC, SQL_QC, THRESHOLD

_T = THRESHOLD
_METRICS = f"""m AS (SELECT sample, class, batch, sum(intensity) AS total_signal, log10(sum(intensity) + 1) AS log10_total_signal_plus1,
  count(*) FILTER (WHERE intensity > {_T}) AS detected_features, count(*) FILTER (WHERE intensity > {_T}) / count(*) AS detection_rate,
  count(*) FILTER (WHERE intensity <= {_T}) / count(*) AS zero_fraction, avg(intensity) FILTER (WHERE intensity <> 0) AS mean_feature_intensity_nonzero
  FROM obs GROUP BY ALL)"""


def _rank(by: str, x: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_samp({x}) > 0 AND stddev_samp({y}) > 0 THEN covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END"


def _outliers(table: str, keep: str, columns: list[str], digits: int, rounded: str) -> str:
    med = ", ".join(f"median({c}) AS m_{c}" for c in columns)
    mad = ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in columns)
    z = {c: f"0.6745 * ({c} - m_{c}) / nullif(d_{c}, 0)" for c in columns}
    flag = {c: f"coalesce(abs({z[c]}) > 3.5, false)" for c in columns}
    out = ", ".join(f"round({z[c]}, {digits}) AS {c}_robust_z, {flag[c]} AS outlier_{c}" for c in columns)
    return f", med AS (SELECT {med} FROM {table}), mad AS (SELECT {mad} FROM {table}, med) SELECT {keep}, {rounded}, {out}, {' OR '.join(flag.values())} AS any_outlier_flag FROM {table}, med, mad"


_PROFILE = f"""logged AS (SELECT *, ln(1 + intensity) AS x FROM obs),
prof AS (SELECT class, feature, median(x) AS md FROM logged GROUP BY 1, 2),
ranked AS (SELECT sample, {_rank("sample", "x")} AS rx, {_rank("sample", "md")} AS ry FROM logged JOIN prof USING (class, feature)),
rho AS (SELECT sample, {_corr("rx", "ry")} AS spearman_corr_to_class_median FROM ranked GROUP BY 1)"""

def _components_of(rows: str, k: int, p: str = "") -> str:
    """CTEs up to ``scores`` (sample, pc1, ...): components of ``rows`` (sample, feature, x) over standardised features.

    The first vector is the column space of a high power of the covariance, got by squaring it; the next ones follow
    after taking it out. Signs are arbitrary.
    """
    grid = f"""{p}grid AS MATERIALIZED (SELECT sample, feature, coalesce(x, 0) AS x FROM (SELECT DISTINCT sample FROM {rows}) CROSS JOIN (SELECT DISTINCT feature FROM {rows}) LEFT JOIN {rows} USING (sample, feature)),
{p}norms AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS s FROM {p}grid GROUP BY 1 HAVING min(x) < max(x)),
{p}zs AS MATERIALIZED (SELECT sample, feature, (x - m) / s AS z FROM {p}grid JOIN {p}norms USING (feature)),
{p}cov1 AS MATERIALIZED (SELECT a.feature AS i, b.feature AS j, sum(a.z * b.z) AS v FROM {p}zs a JOIN {p}zs b USING (sample) GROUP BY 1, 2)"""
    parts = [grid]
    for n in range(1, k + 1):
        last = f"{p}cov{n}"
        for t in range(14):
            parts.append(f"{p}sq{n}_{t} AS MATERIALIZED (SELECT *, sum(v) FILTER (WHERE i = j) OVER () AS tr FROM (SELECT a.i, b.j, sum(a.v * b.v) AS v FROM {last} a JOIN {last} b ON a.j = b.i GROUP BY 1, 2))")
            parts.append(f"{p}pw{n}_{t} AS MATERIALIZED (SELECT i, j, v / tr AS v FROM {p}sq{n}_{t})")
            last = f"{p}pw{n}_{t}"
        parts.append(f"{p}vec{n} AS MATERIALIZED (SELECT p.i AS feature, p.v / sqrt(d.v) AS w FROM {last} p JOIN (SELECT i, v FROM {last} WHERE i = j ORDER BY v DESC LIMIT 1) d ON p.j = d.i)")
        parts.append(f"{p}cov{n + 1} AS MATERIALIZED (SELECT c.i, c.j, c.v - l.v * p.v AS v FROM {p}cov{n} c JOIN {last} p USING (i, j), (SELECT sum(c.v * p.v) AS v FROM {p}cov{n} c JOIN {last} p USING (i, j)) l)")
        parts.append(f"{p}sc{n} AS (SELECT sample, sum(z * w) AS pc{n} FROM {p}zs JOIN {p}vec{n} USING (feature) GROUP BY 1)")
    joins = " ".join(f"JOIN {p}sc{n} USING (sample)" for n in range(2, k + 1))
    return ", ".join([*parts, f"{p}scores AS MATERIALIZED (SELECT * FROM {p}sc1 {joins})"])


_LOW = ["log10_total_signal_plus1", "detected_features", "corr_to_class_median"]
_HIGH = ["zero_fraction", "pca_distance_to_class_centroid"]
_ALL = [*_LOW, *_HIGH]
_TIC = "tic AS (SELECT sample, sum(intensity) AS z FROM obs GROUP BY 1), tic_all AS (SELECT median(z) AS c FROM tic WHERE z > 0), tview AS (SELECT obs.*, coalesce(ln(1 + intensity / CASE WHEN z > 0 THEN z END * c), 0) AS x FROM obs JOIN tic USING (sample), tic_all)"


def _review() -> str:
    med = ", ".join(f"median({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _ALL)
    mad = ", ".join(f"median(abs({c} - m_{c})) AS d_{c}" for c in _ALL)
    z = {c: f"CASE WHEN {c} IS NULL THEN NULL WHEN d_{c} > 0 THEN 0.6745 * ({c} - m_{c}) / d_{c} WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0 END" for c in _ALL}
    flags = {c: f"coalesce(z_{c} {'< -2' if c in _LOW else '> 2'}, false)" for c in _ALL}
    pcs = range(1, 6)
    return f"""{OBS_SQL}, {_METRICS}, {_TIC}, bio AS MATERIALIZED (SELECT sample, class, feature, x FROM tview WHERE class IN ({SQL_BIO})), {_components_of("bio", 5)},
placed AS (SELECT sample, class, scores.* EXCLUDE (sample) FROM scores JOIN (SELECT DISTINCT sample, class FROM bio) USING (sample)), centre AS (SELECT class, {", ".join(f"avg(pc{i}) AS c{i}" for i in pcs)} FROM placed GROUP BY 1),
far AS (SELECT sample, sqrt({" + ".join(f"(pc{i} - c{i}) ** 2" for i in pcs)}) AS pca_distance_to_class_centroid FROM placed JOIN centre USING (class)),
prof AS (SELECT class, feature, median(x) AS md FROM bio GROUP BY 1, 2), ranked AS (SELECT sample, {_rank("sample", "x")} AS rx, {_rank("sample", "md")} AS ry FROM bio JOIN prof USING (class, feature)), rho AS (SELECT sample, {_corr("rx", "ry")} AS corr_to_class_median FROM ranked GROUP BY 1),
b AS (SELECT sample, class, log10_total_signal_plus1, detected_features::DOUBLE AS detected_features, corr_to_class_median, zero_fraction, pca_distance_to_class_centroid FROM m JOIN rho USING (sample) JOIN far USING (sample)),
med AS (SELECT class, {med} FROM b GROUP BY 1), mad AS (SELECT class, {mad} FROM b JOIN med USING (class) GROUP BY 1),
zs5 AS (SELECT b.*, {", ".join(f"{v} AS z_{c}" for c, v in z.items())} FROM b JOIN med USING (class) JOIN mad USING (class)),
fl AS (SELECT *, {", ".join(f"{v} AS flag_{c}" for c, v in flags.items())} FROM zs5),
nf AS (SELECT *, {" + ".join(f"flag_{c}::INT" for c in _ALL)} AS n_review_flags FROM fl),
ex AS (SELECT *, n_review_flags >= 3 AND (flag_corr_to_class_median OR flag_pca_distance_to_class_centroid) AS recommend_exclude FROM nf),
review AS (SELECT sample, class, {", ".join(f"round({c}, 4) AS {c}" for c in _ALL)}, {", ".join(f"round(z_{c}, 4) AS {c}_robust_z_within_class" for c in _ALL)}, {", ".join(f"flag_{c}" for c in _ALL)}, n_review_flags, recommend_exclude,
  CASE WHEN recommend_exclude THEN 'strong_review' WHEN n_review_flags >= 2 THEN 'review' WHEN n_review_flags = 1 THEN 'minor_review' ELSE 'keep' END AS review_tier FROM ex)"""


def _qc(prefix: str, classes: str) -> str:
    return f"""{prefix}_rows AS (SELECT *, ln(1 + intensity) AS lx FROM obs WHERE class IN ({classes})),
{prefix}_stats AS (SELECT feature, count(intensity) AS {prefix}_n, avg((intensity > {_T})::INT) AS {prefix}_detection_rate, avg(intensity) AS {prefix}_mean, median(intensity) AS {prefix}_median,
  stddev_samp(intensity) AS {prefix}_sd, 100 * stddev_samp(intensity) / CASE WHEN avg(intensity) > 0 THEN avg(intensity) END AS {prefix}_cv FROM {prefix}_rows GROUP BY 1),
{prefix}_ranks AS (SELECT feature, {_rank("feature", "lx")} AS rx, {_rank("feature", "run_order")} AS ry FROM {prefix}_rows),
{prefix}_drifts AS (SELECT feature, {_corr("rx", "ry")} AS {prefix}_drift FROM {prefix}_ranks GROUP BY 1),
{prefix}_all AS (SELECT * FROM {prefix}_stats LEFT JOIN {prefix}_drifts USING (feature))"""


def _r(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


_QC_COLUMNS = "detection_rate mean median sd cv drift"
_CONT = f"""cont AS (SELECT *, (blank_mean + 1) / (qc_mean + 1) AS blank_to_qc_ratio, (blank_mean + 1) / (bio_mean + 1) AS blank_to_bio_ratio FROM (SELECT feature,
  {", ".join(f"avg(intensity) FILTER (WHERE class IN ({c})) AS {n}_mean, median(intensity) FILTER (WHERE class IN ({c})) AS {n}_median, avg((intensity > {_T})::INT) FILTER (WHERE class IN ({c})) AS {n}_detection_rate" for n, c in (("blank", SQL_BLANK), ("qc", SQL_QC), ("bio", SQL_BIO)))}
  FROM obs GROUP BY 1)),
contam AS (SELECT *, log10(blank_to_qc_ratio) AS log10_blank_to_qc, log10(blank_to_bio_ratio) AS log10_blank_to_bio,
  coalesce(blank_to_qc_ratio >= 1 AND blank_to_bio_ratio >= 1 AND blank_detection_rate >= 0.1, false) AS blank_dominant FROM cont)"""
_CARRY = f"""tot AS (SELECT sample, batch, run_order, class, sum(intensity) AS t FROM obs GROUP BY ALL),
lagged AS (SELECT sample, class, ln(1 + lag(t) OVER (PARTITION BY batch ORDER BY run_order, sample)) AS prev FROM tot),
ctx AS (SELECT feature, ln(1 + intensity) AS x, prev FROM obs JOIN lagged USING (sample) WHERE lagged.class IN ({SQL_BLANK}) AND prev IS NOT NULL),
cranks AS (SELECT feature, {_rank("feature", "x")} AS rx, {_rank("feature", "prev")} AS ry FROM ctx),
carry AS (SELECT feature, {_corr("rx", "ry")} AS carryover_rho, count(*) AS n_blank_contexts FROM cranks GROUP BY 1)"""


def _tech(name: str, value: str) -> str:
    parts = {"qc": SQL_QC, "europe": "'EUROPE'", "middle_east": "'MIDDLE EAST'"}
    per = ", ".join(
        f"avg({value}) FILTER (WHERE class IN ({c})) AS {n}_mean, stddev_samp({value}) FILTER (WHERE class IN ({c})) AS {n}_sd, stddev_samp(ln(1 + {value})) FILTER (WHERE class IN ({c})) AS {n}_log_sd, avg((intensity > {_T})::INT) FILTER (WHERE class IN ({c})) AS {n}_detection_rate"
        for n, c in parts.items()
    )
    cv = ", ".join(f"100 * {n}_sd / CASE WHEN {n}_mean > 0 THEN {n}_mean END AS {n}_cv" for n in parts)
    pair = lambda c: f"CASE WHEN europe_{c} IS NULL THEN middle_east_{c} WHEN middle_east_{c} IS NULL THEN europe_{c} ELSE (europe_{c} + middle_east_{c}) / 2 END"
    return f"""{name}_a AS (SELECT feature, {per} FROM obs GROUP BY 1), {name}_b AS (SELECT *, {cv} FROM {name}_a),
{name}_c AS (SELECT *, {pair("cv")} AS bio_cv_median, {pair("log_sd")} AS bio_log_sd_median, least(europe_detection_rate, middle_east_detection_rate) AS bio_detection_rate_min, greatest(europe_detection_rate, middle_east_detection_rate) AS bio_detection_rate_max FROM {name}_b),
{name} AS (SELECT *, qc_cv / CASE WHEN bio_cv_median > 0 THEN bio_cv_median END AS d_ratio_cv, qc_log_sd / CASE WHEN bio_log_sd_median > 0 THEN bio_log_sd_median END AS d_ratio_log FROM {name}_c)"""


_FILTER = f"""{OBS_SQL}, {_CONT}, {_CARRY}, {_tech("tb", f"CASE WHEN intensity > {_T} THEN intensity END")},
joined AS (SELECT feature, mz, qc_cv, bio_detection_rate_max, bio_detection_rate_min, d_ratio_log, contam.blank_detection_rate, blank_to_qc_ratio, blank_to_bio_ratio, blank_dominant, carryover_rho, n_blank_contexts
  FROM feats JOIN tb USING (feature) JOIN contam USING (feature) LEFT JOIN carry USING (feature)),
flags AS (SELECT *, coalesce(mz > 948, false) AS pass_mz, coalesce(qc_cv < 23, false) AS pass_qc_cv, coalesce(bio_detection_rate_max >= 0.85, false) AS pass_detection_any, coalesce(bio_detection_rate_min >= 0.85, false) AS pass_detection_all,
  coalesce(blank_detection_rate >= 0.7 AND (coalesce(blank_to_qc_ratio >= 1.04, false) OR coalesce(blank_to_bio_ratio >= 1.04, false) OR blank_dominant), false) AS blank_veto,
  coalesce(carryover_rho >= 0.7 AND n_blank_contexts >= 5, false) AS carryover_flag FROM joined),
kept AS (SELECT *, pass_mz AND pass_qc_cv AND pass_detection_any AND NOT blank_veto AS retained_main FROM flags),
filtered AS (SELECT *, retained_main AND coalesce(d_ratio_log <= 1, false) AS high_confidence FROM kept)"""

_TASKS = [("EUROPE", "MIDDLE EAST"), ("ASIA", "EUROPE"), ("AMERICA", "ASIA")]
_SIDES = "tasks(task_name, class, positive) AS (VALUES " + ", ".join(f"('{p}_vs_{n}', '{p}', true), ('{p}_vs_{n}', '{n}', false)" for p, n in _TASKS) + ")"
_MWU_BODY = f"""trows AS (SELECT task_name, feature, positive, intensity FROM obs JOIN tasks USING (class)),
tr AS (SELECT *, {_rank("task_name, feature", "intensity")} AS rk, count(*) OVER (PARTITION BY task_name, feature, intensity) AS t FROM trows),
u0 AS (SELECT task_name, feature, count(*) FILTER (WHERE positive) AS n_pos, count(*) FILTER (WHERE NOT positive) AS n_neg, sum(rk) FILTER (WHERE positive) AS r, sum(t * t - 1.0) AS ties FROM tr GROUP BY 1, 2),
u1 AS (SELECT *, r - n_pos * (n_pos + 1) / 2 AS u_stat, sqrt(n_pos * n_neg / 12 * (n_pos + n_neg + 1 - ties / ((n_pos + n_neg) * (n_pos + n_neg - 1.0)))) AS sd FROM u0),
mwu AS (SELECT task_name, feature, n_pos, n_neg, u_stat, greatest(0, abs(u_stat - n_pos * n_neg / 2) - 0.5) / sd AS z, u_stat / (n_pos * n_neg) AS auc, 2 * u_stat / (n_pos * n_neg) - 1 AS cliffs_delta FROM u1)"""
_MWU = f"{_SIDES}, {_MWU_BODY}"

_STAND = "stds AS (SELECT p_type AS compound_id, avg(p_retailprice) AS s_mz, avg(p_size) AS s_rt FROM part GROUP BY 1)"
_MATCH = f"""{OBS_SQL}, {_STAND},
near AS (SELECT compound_id, feature, (mz - s_mz) / s_mz * 1e6 AS ppm_error, rt - s_rt AS rt_error, abs((mz - s_mz) / s_mz * 1e6) / 20000 + abs(rt - s_rt) / 1.0 AS score FROM feats, stds),
matches AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY compound_id ORDER BY score, feature) = 1)"""

_PPM = """WITH f AS (SELECT * FROM feature_metadata WHERE mz > 0 AND rt IS NOT NULL),
p0 AS (SELECT a.feature AS feature_a, b.feature AS feature_b, b.mz - a.mz AS delta_mz, b.rt - a.rt AS delta_rt
  FROM f a JOIN f b ON b.mz >= a.mz AND b.mz <= a.mz * 1.0000201 AND (b.mz > a.mz OR b.feature > a.feature)
  WHERE (b.mz - a.mz) / ((a.mz + b.mz) / 2) * 1e6 <= 20)"""


def _related(feats: str, rho: str, r: RedundancyRules) -> str:
    """CTEs up to ``edges``: all related pairs of ``feats``; rho: a CTE (a, b, rho) with a < b, or an empty one."""
    return f"""{rho},
p0 AS (SELECT x.feature AS feature_a, y.feature AS feature_b, y.mz - x.mz AS delta_mz, y.rt - x.rt AS delta_rt, rho
  FROM {feats} x JOIN {feats} y ON (coalesce(x.mz, 'inf'::DOUBLE), x.feature) < (coalesce(y.mz, 'inf'::DOUBLE), y.feature)
  LEFT JOIN rho ON rho.a = least(x.feature, y.feature) AND rho.b = greatest(x.feature, y.feature)),
p1 AS (SELECT *, coalesce(delta_mz <= {r.isomer_mz} AND abs(delta_rt) >= {r.isomer_rt}, false) AS is_isomer, coalesce(abs(delta_rt) <= {r.adduct_rt} AND delta_mz BETWEEN {r.adduct_least_mz} AND {r.adduct_most_mz}, false) AS is_adduct,
  coalesce(rho >= {r.join_rho} AND delta_mz <= {r.duplicate_mz} AND abs(delta_rt) <= {r.duplicate_rt}, false) AS is_near_duplicate, coalesce(rho >= {r.report_rho}, false) AS is_correlated FROM p0),
edges AS (SELECT *, CASE WHEN is_isomer AND is_correlated THEN 'candidate_isomer_correlated' WHEN is_isomer THEN 'candidate_isomer' WHEN is_adduct AND is_correlated THEN 'candidate_isotope_or_adduct_correlated'
  WHEN is_adduct THEN 'candidate_isotope_or_adduct' WHEN is_near_duplicate THEN 'high_corr_near_duplicate' ELSE 'high_corr_other' END AS relation_type FROM p1 WHERE is_isomer OR is_adduct OR is_near_duplicate OR is_correlated)"""


def _components(feats: str) -> str:
    """CTEs up to ``clusters``: the smallest feature that each one reaches; labels spread along the edges and loops."""
    return f"""ways AS (SELECT feature_a AS a, feature_b AS b FROM edges WHERE is_isomer OR is_adduct OR is_near_duplicate UNION SELECT feature_b, feature_a FROM edges WHERE is_isomer OR is_adduct OR is_near_duplicate UNION SELECT feature, feature FROM {feats}),
spread AS (SELECT feature AS v, feature AS c, 0 AS i FROM {feats} UNION ALL SELECT w.b, min(s.c), s.i + 1 FROM spread s JOIN ways w ON s.v = w.a WHERE s.i < 300 GROUP BY w.b, s.i),
clusters AS (SELECT v AS feature, c AS cluster FROM spread WHERE i = 300)"""


_NO_RHO = "rho AS (SELECT NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS rho WHERE false)"
_EDGES = "WITH RECURSIVE " + _related("feature_metadata", _NO_RHO, RedundancyRules())
_CLUSTERS = _EDGES + ", " + _components("feature_metadata")
_NEIGHBOURS = "ends AS (SELECT feature_a AS feature, edges.* FROM edges UNION ALL SELECT feature_b, edges.* FROM edges), near AS (SELECT feature, " + ", ".join(f"count(*) FILTER (WHERE is_{k}) AS n_{k}" for k in RELATIONS) + " FROM ends GROUP BY 1)"
_BRAND_RHO = f"""ranks AS (SELECT sample, feature, {_rank("feature", "intensity")} AS x FROM obs),
rho AS (SELECT p.feature AS a, q.feature AS b, {_corr("p.x", "q.x")} AS rho FROM ranks p JOIN ranks q ON p.sample = q.sample AND p.feature < q.feature GROUP BY 1, 2)"""
_BRAND_EDGES = OBS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _related("feats", _BRAND_RHO, BRAND_RULES)

_SEQ = """WITH nul AS (SELECT unnest(['', 'nan', 'None', 'NA']) AS x),
seqs AS (SELECT gly_id, CASE WHEN trim(glycan, ' ') NOT IN (SELECT x FROM nul) THEN trim(glycan, ' ') END AS glycan_sequence,
  CASE WHEN trim(composition, ' ') NOT IN (SELECT x FROM nul) THEN trim(composition, ' ') END AS composition,
  CASE WHEN trim(tissue_species, ' ') NOT IN (SELECT x FROM nul) THEN trim(tissue_species, ' ') END AS tissue_species,
  CASE WHEN trim(tissue_sample, ' ') NOT IN (SELECT x FROM nul) THEN trim(tissue_sample, ' ') END AS tissue_sample,
  CAST(NULL AS VARCHAR) AS disease, 'glycan_list' AS source_name, 0 AS is_n_glycan, 'glycan' AS original_sequence_column FROM glycan_list),
seq AS (SELECT * FROM seqs WHERE glycan_sequence IS NOT NULL)"""
_SOURCES = r"""WITH g AS (SELECT *, regexp_replace(lower(glycan), '[^a-z0-9]', '', 'g') AS k FROM glycan_list),
k AS (SELECT *, CASE WHEN source_name = 'df_glycan' THEN 0 ELSE 1 END AS rk, coalesce(source_name, 'none') AS src FROM g WHERE k <> '')"""
_KNN = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
d AS (SELECT a.vec_id AS anchor, b.vec_id AS neighbor, round(1 - list_cosine_similarity(a.v, b.v), 12) AS cosine_distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
nn AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY cosine_distance, neighbor) AS neighbor_rank FROM d),
knn AS (SELECT * FROM nn WHERE neighbor_rank <= 10)"""
_BIND = "bind AS (SELECT l_partkey AS vec_id, 'P' || (l_suppkey % 10) AS protein, l_quantity AS binding_value FROM lineitem)"
_CONTEXT = _KNN + """, flags AS (SELECT vec_id AS neighbor, label < 6 AS general, label % 3 = 0 AS disease, label = 1 AS specific FROM embeddings),
ctx AS (SELECT anchor, count(*) AS n_neighbors, avg(cosine_distance) AS mean_distance, max(cosine_distance) AS max_distance, avg(general::INT) AS general_fraction, avg(disease::INT) AS disease_fraction, avg(specific::INT) AS specific_fraction FROM knn JOIN flags USING (neighbor) GROUP BY 1)"""
_ROBUST = """, d2 AS (SELECT a.vec_id AS anchor, b.vec_id AS neighbor, round(1 - list_cosine_similarity(a.v[1:32], b.v[1:32]), 12) AS cosine_distance FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
knn2 AS (SELECT * FROM d2 QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY cosine_distance, neighbor) <= 10),
s1 AS (SELECT anchor, list(neighbor) AS a FROM knn GROUP BY 1), s2 AS (SELECT anchor, list(neighbor) AS b FROM knn2 GROUP BY 1),
robust AS (SELECT anchor, len(list_intersect(a, b)) AS n_shared, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) AS jaccard FROM s1 JOIN s2 USING (anchor))"""

_RES = "Neu5Ac|Neu5Gc|Kdn|GalNAc|GlcNAc|ManNAc|Gal|Glc|Man|Fuc|Xyl"
_CORE = "contains(s, 'GlcNAc(b1-4)GlcNAc') AND contains(s, 'Man(b1-4)GlcNAc') AND contains(s, 'Man(a1-3)') AND contains(s, 'Man(a1-6)')"
_EXACT = r"nullif(regexp_replace(glycan_sequence, '[\s\x{0B}\x{85}\p{Z}]+', '', 'g'), '')"
_TOPOLOGY = r"nullif(regexp_replace(lower(regexp_replace(glycan_sequence, '\([^)]*\)', '', 'g')), '[^a-z0-9\[\]]', '', 'g'), '')"
_PLAUSIBLE = r"""(s IS NOT NULL AND NOT (regexp_matches(lower(s), 'homo_sapiens|mus_musculus|bos_taurus|arabidopsis|virus|cell_line|blood|plasma|mucosa|seminal_fluid')
  OR (starts_with(s, '[') AND contains(s, '][') AND NOT regexp_matches(s, 'GlcNAc|Gal|Man')))
  AND (regexp_matches(s, 'GlcNAc|GalNAc|Neu5Ac|Neu5Gc|Kdn|Gal|Glc|Man|Fuc|Xyl|WURCS=|RES|;N') OR (contains(s, '(') AND contains(s, ')')) OR (contains(s, '[') AND contains(s, ']'))))"""
_STATS = rf"""length(s) AS seq_length, len(regexp_extract_all(s, '\[')) AS branch_count, len(regexp_extract_all(s, '\?')) AS unknown_count, len(regexp_extract_all(s, '{_RES}')) AS residue_count,
  len(regexp_extract_all(s, 'Fuc')) AS fucose_count, len(regexp_extract_all(s, 'Neu5Ac|Neu5Gc|Kdn')) AS sialic_count"""
_CANCER = "cancer|carcinoma|adenocarcinoma|tumor|tumour|leukemia|leukaemia|lymphoma|myeloma|sarcoma|cholangiocarcinoma|melanoma|glioma"
_PARTS = ("Hex", "HexNAc", "dHex", "Neu5Ac", "Neu5Gc", "Kdn", "Fuc", "Xyl", "Gal", "Glc", "Man", "GalNAc", "GlcNAc")


def _comp(rows: str, key: str) -> str:
    """CTE ``comp``: composition counts, totals and shares of ``rows`` (key, composition)."""
    item = r"""'([\p{L}][\p{L}\p{N}_-]*)["'']?\s*(?:[:=,(]|\s)\s*(\d+)'"""
    own = ", ".join(f"coalesce(sum(n) FILTER (WHERE name = '{p.lower()}'), 0)::BIGINT AS \"comp_{p}\"" for p in _PARTS)
    return f"""ci AS (SELECT {key}, unnest(regexp_extract_all(lower(composition), {item}, 1)) AS name, unnest(regexp_extract_all(lower(composition), {item}, 2))::BIGINT AS n FROM {rows}),
cg AS (SELECT {key}, {own}, coalesce(sum(n), 0)::BIGINT AS comp_total_residues FROM {rows} LEFT JOIN ci USING ({key}) GROUP BY 1),
ct AS (SELECT *, "comp_dHex" + "comp_Fuc" AS comp_fucose_total, "comp_Neu5Ac" + "comp_Neu5Gc" + "comp_Kdn" AS comp_sialic_total FROM cg),
comp AS (SELECT *, coalesce(comp_fucose_total / nullif(comp_total_residues, 0), 0) AS comp_fucose_ratio, coalesce(comp_sialic_total / nullif(comp_total_residues, 0), 0) AS comp_sialic_ratio, coalesce("comp_HexNAc" / nullif("comp_Hex", 0), 0) AS comp_hexnac_to_hex_ratio FROM ct)"""


_SHARES = ("comp_fucose_ratio", "comp_sialic_ratio", "comp_hexnac_to_hex_ratio")
_MASTER = _SEQ + f""", named AS (SELECT seq.*, CASE g.source_name WHEN 'df_glycan' THEN 1 WHEN 'n_glycans' THEN 2 ELSE 0 END AS rk FROM seq JOIN glycan_list g USING (gly_id)),
mast AS (SELECT glycan_sequence, coalesce(min(composition) FILTER (WHERE rk = 0), arg_min(composition, (rk, composition)) FILTER (WHERE rk > 0 AND composition IS NOT NULL)) AS composition,
  coalesce(min(tissue_species) FILTER (WHERE rk = 0), arg_min(tissue_species, (rk, tissue_species)) FILTER (WHERE rk > 0 AND tissue_species IS NOT NULL)) AS tissue_species,
  coalesce(max((rk = 2)::INT) FILTER (WHERE rk > 0), 0) AS is_n_glycan, max((rk = 0)::INT) AS discovered_flag, max((rk > 0)::INT) AS reference_flag,
  nullif(array_to_string(list_sort(list_distinct(list(CASE rk WHEN 1 THEN 'df_glycan' WHEN 2 THEN 'n_glycans' END) FILTER (WHERE rk > 0))), '|'), '') AS source_names FROM named GROUP BY 1),
bnd AS (SELECT trim(glycan, ' ') AS glycan_sequence, 'P' || (l_suppkey % 10) AS protein, l_quantity AS binding_value FROM lineitem JOIN glycan_list ON l_partkey = gly_id WHERE trim(glycan, ' ') NOT IN (SELECT x FROM nul)),
bk AS (SELECT *, {_EXACT} AS canonical_sequence, {_TOPOLOGY} AS topology_key FROM bnd),
be AS (SELECT canonical_sequence, count(*) AS n_binding_rows, count(DISTINCT protein) AS n_binding_proteins, avg(binding_value) AS mean_binding_value, max(binding_value) AS max_binding_value FROM bk GROUP BY 1),
bt AS (SELECT topology_key, count(*) AS n_binding_rows_topology, count(DISTINCT protein) AS n_binding_proteins_topology FROM bk GROUP BY 1),
{_comp("mast", "glycan_sequence")},
mk AS (SELECT *, {_EXACT} AS s, {_TOPOLOGY} AS t FROM mast JOIN comp USING (glycan_sequence)),
canon AS (SELECT mk.s AS canonical_sequence, t AS topology_key, mk.* EXCLUDE (s, t), coalesce({_CORE}, false)::INT AS likely_n_glycan, {_STATS}, coalesce(n_binding_rows, 0) AS n_binding_rows, coalesce(n_binding_proteins, 0) AS n_binding_proteins,
  coalesce(mean_binding_value, 0) AS mean_binding_value, coalesce(max_binding_value, 0) AS max_binding_value, coalesce(n_binding_rows_topology, 0) AS n_binding_rows_topology, coalesce(n_binding_proteins_topology, 0) AS n_binding_proteins_topology,
  (coalesce(n_binding_rows, 0) > 0)::INT AS has_binding_exact, (coalesce(n_binding_rows_topology, 0) > 0)::INT AS has_binding_topology
  FROM mk LEFT JOIN be ON mk.s IS NOT DISTINCT FROM be.canonical_sequence LEFT JOIN bt ON mk.t IS NOT DISTINCT FROM bt.topology_key),
inter AS (SELECT canonical_sequence, arg_min(is_n_glycan, glycan_sequence) AS is_n_glycan, arg_min(likely_n_glycan, glycan_sequence) AS likely_n_glycan, arg_min(has_binding_exact, glycan_sequence) AS has_binding_exact, arg_min(discovered_flag, glycan_sequence) AS discovered_flag, arg_min(reference_flag, glycan_sequence) AS reference_flag
  FROM canon WHERE {_PLAUSIBLE.replace("(s ", "(canonical_sequence ").replace("(s,", "(canonical_sequence,").replace("(s)", "(canonical_sequence)")} GROUP BY 1)"""
_BLOCK = [*(f"comp_{p}" for p in _PARTS if p not in ("GalNAc", "GlcNAc")), "comp_total_residues", "comp_fucose_total", "comp_sialic_total", *_SHARES, "branch_count", "unknown_count", "residue_count", "fucose_count", "sialic_count"]
_EV = f"""{OBS_SQL}, {_SIDES}, ev AS (SELECT task_name, feature, positive, intensity AS raw, ln(1 + intensity) AS x FROM obs JOIN tasks USING (class)),
evm AS (SELECT task_name, feature, median(x) FILTER (WHERE positive) AS pos_median, median(x) FILTER (WHERE NOT positive) AS neg_median,
  avg(x) FILTER (WHERE positive) - avg(x) FILTER (WHERE NOT positive) AS mean_difference,
  log2((median(raw) FILTER (WHERE positive) + 1) / (median(raw) FILTER (WHERE NOT positive) + 1)) AS log2_ratio,
  avg((raw > {_T})::INT) FILTER (WHERE positive) AS pos_detection_rate, avg((raw > {_T})::INT) FILTER (WHERE NOT positive) AS neg_detection_rate FROM ev GROUP BY 1, 2)"""

_DECIDED = _FILTER.replace("WITH ", "WITH RECURSIVE ", 1) + ", main AS (SELECT feature, feats.mz, rt FROM filtered JOIN feats USING (feature) WHERE retained_main), ranks AS (SELECT sample, feature, " + _rank("feature", "intensity") + """ AS x FROM obs WHERE feature IN (SELECT feature FROM main)),
""" + _related("main", f"rho AS (SELECT p.feature AS a, q.feature AS b, {_corr('p.x', 'q.x')} AS rho FROM ranks p JOIN ranks q ON p.sample = q.sample AND p.feature < q.feature GROUP BY 1, 2)", RedundancyRules()) + ", " + _components("main") + ", " + _NEIGHBOURS + """,
grp AS (SELECT feature, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size, first_value(feature) OVER (PARTITION BY cluster ORDER BY NOT high_confidence, qc_cv NULLS LAST, d_ratio_log NULLS LAST, bio_detection_rate_max DESC, feature) AS rep FROM clusters JOIN filtered USING (feature)),
dec AS (SELECT feature, retained_main, high_confidence, carryover_flag, cluster, coalesce(cluster_size, 1) AS cluster_size, coalesce(feature = rep, false) AS is_representative, CASE WHEN rep IS NULL THEN 'not_modeled' WHEN cluster_size = 1 THEN 'singleton' WHEN feature = rep THEN 'representative' ELSE 'member' END AS redundancy_role,
  """ + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in RELATIONS) + """ FROM filtered LEFT JOIN grp USING (feature) LEFT JOIN near USING (feature))"""
_REVIEWED = "review AS (" + _review() + " SELECT * FROM review)"

_EVIDENCE = f"""{_EV}, {_MWU_BODY}, sd AS (SELECT task_name, max(class) FILTER (WHERE positive) AS p, max(class) FILTER (WHERE NOT positive) AS n FROM tasks GROUP BY 1),
er AS (SELECT task_name, feature, CASE WHEN z > 0 THEN 1 - 2 / sqrt(pi()) * exp(-z * z / 2) * sum(exp(2 * k * ln(2) + (2 * k + 1) * ln(z / sqrt(2)) + lgamma(k + 1) - lgamma(2 * k + 2))) WHEN z IS NOT NULL THEN 1.0 END AS p_value
  FROM (SELECT task_name, feature, z, unnest(range(0, 200)) AS k FROM mwu) GROUP BY task_name, feature, z),
raws AS (SELECT task_name, feature, median(raw) FILTER (WHERE positive) AS pos_raw_median, median(raw) FILTER (WHERE NOT positive) AS neg_raw_median FROM ev GROUP BY 1, 2),
qr AS (SELECT *, p_value * count(p_value) OVER (PARTITION BY task_name) / row_number() OVER (PARTITION BY task_name ORDER BY p_value NULLS LAST) AS rawq FROM er),
qv AS (SELECT task_name, feature, p_value, CASE WHEN p_value IS NOT NULL THEN least(1, min(rawq) OVER (PARTITION BY task_name ORDER BY p_value DESC NULLS FIRST, rawq ASC NULLS FIRST ROWS UNBOUNDED PRECEDING)) END AS q_value FROM qr),
evid AS (SELECT *, greatest(auc, 1 - auc) AS best_auc, pos_median - neg_median AS median_difference, pos_detection_rate - neg_detection_rate AS detection_rate_difference, 2 * auc - 1 AS rank_biserial, -log10(greatest(q_value, 1e-300)) AS neg_log10_q,
  coalesce(q_value < 0.05, false) AS significant, sd.p || CASE WHEN pos_median >= neg_median THEN ' > ' ELSE ' < ' END || sd.n AS direction FROM evm JOIN raws USING (task_name, feature) JOIN mwu USING (task_name, feature) JOIN qv USING (task_name, feature) JOIN sd USING (task_name))"""
_CLASS_MEDIANS = """cm AS (SELECT feature, class, median(intensity / 1000) AS m FROM obs WHERE class IN ('ASIA', 'EUROPE', 'MIDDLE EAST') GROUP BY 1, 2),
co AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY m, class) AS r, count(*) OVER (PARTITION BY feature) AS n FROM cm),
cw AS (SELECT feature, any_value(n) AS n, max(m) FILTER (WHERE class = 'ASIA') AS median_ASIA, max(m) FILTER (WHERE class = 'EUROPE') AS median_EUROPE, max(m) FILTER (WHERE class = 'MIDDLE EAST') AS median_MIDDLE_EAST,
  max(m) FILTER (WHERE r = n) AS m1, max(class) FILTER (WHERE r = n) AS c1, max(m) FILTER (WHERE r = n - 1) AS m2, max(m) FILTER (WHERE r = 1) AS l1, max(class) FILTER (WHERE r = 1) AS d1, max(m) FILTER (WHERE r = 2) AS l2 FROM co GROUP BY 1),
cs AS (SELECT feature, count(*) FILTER (WHERE q_value <= 0.05 AND best_auc >= 0.85 AND abs(log2_ratio) >= 0.10) AS n_strong_tasks FROM evid GROUP BY 1)"""


def _view_scores() -> str:
    views = {"raw": "intensity", "log1p": "ln(1 + intensity)", "tic_log1p": "coalesce(ln(1 + intensity / CASE WHEN t.z > 0 THEN t.z END * tc.c), 0)", "median_log1p": "coalesce(ln(1 + intensity / CASE WHEN n.z > 0 THEN n.z END * nc.c), 0)"}
    columns = ", ".join(f"{v} AS {k}" for k, v in views.items())
    parts = [f"""{OBS_SQL}, t AS (SELECT sample, sum(intensity) AS z FROM obs GROUP BY 1), tc AS (SELECT median(z) AS c FROM t WHERE z > 0), n AS (SELECT sample, median(intensity) FILTER (WHERE intensity <> 0) AS z FROM obs GROUP BY 1), nc AS (SELECT median(z) AS c FROM n WHERE z > 0),
every AS MATERIALIZED (SELECT obs.sample, feature, class, run_order, {columns} FROM obs JOIN t USING (sample) JOIN n USING (sample), tc, nc)"""]
    rows = []
    for i, v in enumerate(views):
        parts.append(f"q{i} AS MATERIALIZED (SELECT sample, feature, run_order, {v} AS x FROM every WHERE class IN ({SQL_QC})), b{i} AS (SELECT sample, class, feature, {v} AS x FROM every WHERE class IN ({SQL_BIO}))")
        parts.append(f"k{i} AS (SELECT sample, feature, {_rank('sample', 'ln(1 + x)')} AS r FROM q{i}), c{i} AS (SELECT {_corr('a.r', 'b.r')} AS rho FROM k{i} a JOIN k{i} b ON a.feature = b.feature AND a.sample < b.sample GROUP BY a.sample, b.sample)")
        parts.append(f"m{i} AS (SELECT class, feature, median(x) AS m FROM b{i} GROUP BY 1, 2), br{i} AS (SELECT sample, {_rank('sample', 'x')} AS rx, {_rank('sample', 'm')} AS ry FROM b{i} JOIN m{i} USING (class, feature)), bc{i} AS (SELECT {_corr('rx', 'ry')} AS rho FROM br{i} GROUP BY sample)")
        parts.append(_components_of(f"q{i}", 1, f"v{i}") + f", o{i} AS (SELECT {_rank('1', 'pc1')} AS rx, {_rank('1', 'run_order')} AS ry FROM v{i}scores JOIN (SELECT DISTINCT sample, run_order FROM q{i}) USING (sample)), s{i} AS (SELECT sum(x) AS t FROM q{i} GROUP BY sample)")
        rows.append(f"SELECT '{v}' AS view, (SELECT median(rho) FROM c{i}) AS qc_median_rho, (SELECT min(rho) FROM c{i}) AS qc_min_rho, (SELECT median(rho) FROM bc{i}) AS bio_median_rho, (SELECT min(rho) FROM bc{i}) AS bio_min_rho, (SELECT 100 * stddev_samp(t) / avg(t) FROM s{i}) AS qc_signal_cv, (SELECT abs({_corr('rx', 'ry')}) FROM o{i}) AS abs_pc1_order_rho, (SELECT sum(pc1 ** 2) FROM v{i}scores) / (SELECT sum(v) FROM v{i}cov1 WHERE i = j) AS pc1_variance")
    names = "qc_median_rho qc_min_rho bio_median_rho bio_min_rho qc_signal_cv abs_pc1_order_rho pc1_variance"
    return ", ".join(parts) + f" SELECT view, {_r(names, 5)} FROM ({' UNION ALL '.join(rows)})"


ORACLE = {
    "evidence_table": _EVIDENCE + f" SELECT task_name, feature, n_pos, n_neg, significant, direction, row_number() OVER (PARTITION BY task_name ORDER BY significant DESC, q_value NULLS LAST, best_auc DESC NULLS LAST, cliffs_delta DESC NULLS LAST, feature) AS evidence_rank, {_r('mean_difference pos_detection_rate neg_detection_rate pos_median neg_median pos_raw_median neg_raw_median u_stat z auc cliffs_delta p_value q_value log2_ratio best_auc median_difference detection_rate_difference rank_biserial neg_log10_q')} FROM evid",
    "class_profiles": f"{_EVIDENCE}, {_CLASS_MEDIANS}" + """ SELECT feature, round(median_ASIA, 6) AS "median_ASIA", round(median_EUROPE, 6) AS "median_EUROPE", round(median_MIDDLE_EAST, 6) AS "median_MIDDLE_EAST", coalesce(n_strong_tasks, 0) AS n_strong_tasks,
CASE WHEN coalesce(n_strong_tasks, 0) = 0 OR n < 2 THEN 'no_clear_profile' WHEN m1 - m2 >= 0.05 THEN c1 || '_high' WHEN l2 - l1 >= 0.05 THEN d1 || '_low' ELSE 'mixed' END AS profile FROM cw LEFT JOIN cs USING (feature)""",
    "view_scores": _view_scores(),
    "frozen_samples": "SELECT sample, class, batch, run_order::DOUBLE AS run_order FROM (SELECT sample, class, batch, run_order, row_number() OVER (PARTITION BY sample ORDER BY batch NULLS FIRST, run_order NULLS FIRST, class NULLS FIRST) AS r FROM acquisition_list WHERE class IN ('Dunn', 'French', 'LMU')) WHERE r = 1",
    "operational_subset": "SELECT sample, class, batch, run_order::DOUBLE AS run_order FROM (SELECT sample, class, batch, run_order, row_number() OVER (PARTITION BY sample ORDER BY batch NULLS FIRST, run_order NULLS FIRST, class NULLS FIRST) AS r FROM acquisition_list WHERE batch = 1 AND class IN ('QC', 'dQC', 'Dunn', 'French', 'LMU')) WHERE r = 1",
    "control_samples": "SELECT DISTINCT sample FROM acquisition_list WHERE class IN ('QC', 'dQC') AND sample IS NOT NULL",
    "operational_observations": f"{OBS_SQL} SELECT sample, feature, round(intensity, 6) AS intensity FROM obs WHERE batch = 1 AND class IN ({SQL_QC}, {SQL_BIO})",
    "rejected_sequences": _SEQ + f" SELECT gly_id, s FROM (SELECT gly_id, {_EXACT} AS s FROM seq) WHERE NOT {_PLAUSIBLE}",
    "wide_round_trip": f"{OBS_SQL} SELECT s.sample, f.feature, round(intensity, 6) AS intensity FROM (SELECT DISTINCT sample FROM obs) s CROSS JOIN feats f LEFT JOIN obs ON obs.sample = s.sample AND obs.feature = f.feature",
    "inventory_pivot": "SELECT batch, " + ", ".join(f"count(*) FILTER (WHERE class = '{c}') AS \"{c}\"" for c in ("B", "SS", "dQC", "QC", "Dunn", "French", "LMU")) + " FROM acquisition_list WHERE batch IS NOT NULL AND class IS NOT NULL GROUP BY 1",
    "inventory_counts": "SELECT batch, class, count(*) AS n_samples, coalesce(list_position(['B', 'SS', 'dQC', 'QC', 'Dunn', 'French', 'LMU'], class), 8) AS class_rank FROM acquisition_list WHERE batch IS NOT NULL AND class IS NOT NULL GROUP BY 1, 2",
    "missing_orders": "WITH o AS (SELECT DISTINCT batch, run_order AS pos FROM acquisition_list WHERE run_order IS NOT NULL), n AS (SELECT batch, pos, lead(pos) OVER (PARTITION BY batch ORDER BY pos) AS nx FROM o) SELECT batch, pos + 1 AS first_missing, nx - 1 AS last_missing FROM n WHERE nx > pos + 1",
    "audit_set_differences": "SELECT 'acquisition_only' AS side, sample AS key FROM (SELECT sample FROM acquisition_list EXCEPT SELECT sample FROM sample_metrics) WHERE sample IS NOT NULL UNION ALL SELECT 'metrics_only', sample FROM (SELECT sample FROM sample_metrics EXCEPT SELECT sample FROM acquisition_list) WHERE sample IS NOT NULL",
    "audit_tables": OBS_SQL + """, c(\"check\", n) AS (
SELECT 'repeated_samples', (SELECT count(*) FROM (SELECT sample FROM samples GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'repeated_features', (SELECT count(*) FROM (SELECT feature FROM feats GROUP BY 1 HAVING count(*) > 1))
UNION ALL SELECT 'samples_without_observations', (SELECT count(*) FROM (SELECT sample FROM samples EXCEPT SELECT sample FROM obs))
UNION ALL SELECT 'observations_without_sample', (SELECT count(*) FROM (SELECT sample FROM obs EXCEPT SELECT sample FROM samples))
UNION ALL SELECT 'features_without_observations', (SELECT count(*) FROM (SELECT feature FROM feats EXCEPT SELECT feature FROM obs))
UNION ALL SELECT 'observations_without_feature', (SELECT count(*) FROM (SELECT feature FROM obs EXCEPT SELECT feature FROM feats))) SELECT * FROM c""",
    "sample_metrics": f"{OBS_SQL}, {_METRICS} SELECT sample, class, batch, detected_features, {_r('total_signal log10_total_signal_plus1 detection_rate zero_fraction mean_feature_intensity_nonzero')} FROM m",
    "sample_outliers": f"{OBS_SQL}, {_METRICS}" + _outliers("m", "sample, class, detected_features", ["log10_total_signal_plus1", "detected_features", "zero_fraction", "mean_feature_intensity_nonzero"], 4, _r("total_signal log10_total_signal_plus1 detection_rate zero_fraction mean_feature_intensity_nonzero", 4)),
    "metrics_outliers": "WITH m AS (SELECT row_id, detected_features::DOUBLE AS detected_features, zero_fraction FROM sample_metrics)" + _outliers("m", "row_id", ["detected_features", "zero_fraction"], 6, _r("detected_features zero_fraction")),
    "sample_summary": f"{OBS_SQL}, {_METRICS}, {_PROFILE}, s AS (SELECT batch, class, count(*) AS n_samples, avg(spearman_corr_to_class_median) AS mean_spearman_corr_to_class_median, median(total_signal) AS median_total_signal, avg(total_signal) AS mean_total_signal, median(detected_features) AS median_detected_features, avg(detected_features) AS mean_detected_features, median(zero_fraction) AS median_zero_fraction FROM m JOIN rho USING (sample) GROUP BY 1, 2) SELECT batch, class, n_samples, {_r('mean_spearman_corr_to_class_median median_total_signal mean_total_signal median_detected_features mean_detected_features median_zero_fraction')} FROM s",
    "class_profile_spearman": f"{OBS_SQL}, {_PROFILE} SELECT sample, {_r('spearman_corr_to_class_median')} FROM rho",
    "sample_review_flags": _review() + " SELECT * FROM review",
    "handoff_sample_counts": _review() + " SELECT class, count(*) FILTER (WHERE NOT recommend_exclude) AS n_retained, count(*) FILTER (WHERE recommend_exclude) AS n_excluded, " + ", ".join(f"count(*) FILTER (WHERE review_tier = '{t}') AS n_{t}" for t in ("keep", "minor_review", "review", "strong_review")) + " FROM review GROUP BY 1",
    "threshold_sensitivity": f"{OBS_SQL}, r AS (SELECT sample, class, batch, threshold, avg((intensity > threshold)::INT) AS rate FROM obs, (SELECT unnest([100.0, 500.0, 700.0, 1000.0])::DOUBLE AS threshold) GROUP BY ALL), g AS (SELECT class, batch, threshold, avg(rate) AS mean_rate, median(rate) AS median_rate, min(rate) AS min_rate, max(rate) AS max_rate FROM r GROUP BY 1, 2, 3) SELECT class, batch, threshold, {_r('mean_rate median_rate min_rate max_rate')} FROM g",
    "qc_feature_metrics": f"{OBS_SQL}, {_qc('qc', SQL_QC + ', ' + SQL_DQC)} SELECT feature, qc_n, {_r(' '.join('qc_' + c for c in _QC_COLUMNS.split()))} FROM qc_all",
    "qc_summary": f"{OBS_SQL}, {_qc('qc', SQL_QC)}, s AS (SELECT count(*) AS n_features, median(qc_cv) AS median_cv, avg(qc_cv) AS mean_cv, count(*) FILTER (WHERE qc_cv < 30) AS n_stable, avg(coalesce(qc_cv < 30, false)::INT) AS share_stable, median(qc_detection_rate) AS median_detection_rate FROM qc_all) SELECT n_features, n_stable, {_r('median_cv mean_cv share_stable median_detection_rate')} FROM s",
    "qc_batch_cv": f"{OBS_SQL} SELECT feature, batch, round(avg(intensity), 6) AS batch_mean, round(100 * stddev_samp(intensity) / avg(intensity), 6) AS batch_cv FROM obs WHERE class IN ({SQL_QC}) GROUP BY 1, 2",
    "qc_vs_dqc": f"{OBS_SQL}, {_qc('qc', SQL_QC)}, {_qc('dqc', SQL_DQC)} SELECT feature, qc_n, dqc_n, {_r(' '.join(f'{p}_{c}' for p in ('qc', 'dqc') for c in _QC_COLUMNS.split()))}, coalesce(qc_cv < 30, false) AS qc_stable, coalesce(dqc_cv < 30, false) AS dqc_stable, round(dqc_cv - qc_cv, 6) AS cv_gap, round(abs(abs(dqc_drift) - abs(qc_drift)), 6) AS drift_gap, coalesce(qc_cv < 30, false) AND NOT coalesce(dqc_cv < 30, false) AS concentration_sensitive FROM qc_all FULL JOIN dqc_all USING (feature)",
    "qc_vs_dqc_summary": f"{OBS_SQL}, {_qc('qc', SQL_QC)}, {_qc('dqc', SQL_DQC)}, c AS (SELECT feature, qc_n, dqc_n, qc_cv, dqc_cv, qc_drift, dqc_drift, coalesce(qc_cv < 30, false) AS qc_stable, coalesce(dqc_cv < 30, false) AS dqc_stable, round(abs(abs(dqc_drift) - abs(qc_drift)), 6) AS drift_gap, coalesce(qc_cv < 30, false) AND NOT coalesce(dqc_cv < 30, false) AS concentration_sensitive FROM qc_all FULL JOIN dqc_all USING (feature))" + """ SELECT unnest(['n_features', 'n_qc_stable', 'share_qc_stable', 'n_dqc_stable', 'share_dqc_stable', 'n_stable_in_both', 'n_concentration_sensitive', 'median_qc_cv', 'median_dqc_cv', 'median_abs_qc_drift', 'median_abs_dqc_drift']) AS metric,
round(unnest([count(*), count(*) FILTER (WHERE qc_stable), avg(qc_stable::INT), count(*) FILTER (WHERE dqc_stable), avg(dqc_stable::INT), count(*) FILTER (WHERE qc_stable AND dqc_stable), count(*) FILTER (WHERE concentration_sensitive), median(qc_cv), median(dqc_cv), median(abs(qc_drift)), median(abs(dqc_drift))]::DOUBLE[]), 6) AS value FROM c""",
    "qc_pairwise_corr": f"{OBS_SQL}, q AS (SELECT feature AS f, sample AS s, ln(1 + intensity) AS x FROM obs WHERE class IN ({SQL_QC})) SELECT a.s AS sample_a, b.s AS sample_b, round({_corr('a.x', 'b.x')}, 6) AS rho, count(*) AS n FROM q a JOIN q b ON a.f = b.f AND a.s < b.s GROUP BY 1, 2",
    "pca_distances": f"{OBS_SQL}, lg AS (SELECT sample, feature, ln(1 + intensity) AS x FROM obs), {_components_of('lg', 2)}" + """, c AS (SELECT median(pc1) AS m1, median(pc2) AS m2 FROM scores), d AS (SELECT sample, class, pc1, pc2, sqrt((pc1 - m1) ** 2 + (pc2 - m2) ** 2) AS dist FROM scores JOIN samples USING (sample), c),
dm AS (SELECT median(dist) AS md FROM d), da AS (SELECT median(abs(dist - md)) AS mad FROM d, dm), z AS (SELECT d.*, 0.6745 * (dist - md) / nullif(mad, 0) AS z FROM d, dm, da), g AS (SELECT class, avg(pc1) AS g1, avg(pc2) AS g2 FROM d GROUP BY 1)
SELECT sample, class, round(abs(pc1), 5) AS "PC1", round(abs(pc2), 5) AS "PC2", round(dist, 5) AS pca_distance, round(z, 5) AS pca_robust_z, coalesce(abs(z) > 3.5, false) AS outlier_pca, round(sqrt((pc1 - g1) ** 2 + (pc2 - g2) ** 2), 5) AS pca_distance_to_class_centroid FROM z JOIN g USING (class)""",
    "pc1_drift": f"{OBS_SQL}, lg AS (SELECT sample, feature, ln(1 + intensity) AS x FROM obs), {_components_of('lg', 1)}, r AS (SELECT {_rank('1', 'pc1')} AS rx, {_rank('1', 'run_order')} AS ry FROM scores JOIN samples USING (sample)), v AS (SELECT (SELECT sum(pc1 ** 2) FROM scores) / (SELECT sum(v) FROM cov1 WHERE i = j) AS share) SELECT round(abs({_corr('rx', 'ry')}), 6) AS abs_pc1_order_rho, count(*) AS n, round(any_value(share), 6) AS pc1_variance FROM r, v",
    "view_raw": f"{OBS_SQL} SELECT sample, feature, round(intensity, 6) AS intensity FROM obs",
    "view_log1p": f"{OBS_SQL} SELECT sample, feature, round(ln(1 + intensity), 6) AS intensity FROM obs",
    "view_tic_log1p": f"{OBS_SQL}, s AS (SELECT sample, sum(intensity) AS z FROM obs GROUP BY 1), c AS (SELECT median(z) AS c FROM s WHERE z > 0) SELECT sample, feature, round(coalesce(ln(1 + intensity / CASE WHEN z > 0 THEN z END * c), 0), 6) AS intensity FROM obs JOIN s USING (sample), c",
    "view_median_log1p": f"{OBS_SQL}, s AS (SELECT sample, median(intensity) FILTER (WHERE intensity <> 0) AS z FROM obs GROUP BY 1), c AS (SELECT median(z) AS c FROM s WHERE z > 0) SELECT sample, feature, round(coalesce(ln(1 + intensity / CASE WHEN z > 0 THEN z END * c), 0), 6) AS intensity FROM obs JOIN s USING (sample), c",
    "detection_rates": f"{OBS_SQL}, g AS (SELECT feature, 'all' AS class_group, intensity FROM obs UNION ALL SELECT feature, class, intensity FROM obs UNION ALL SELECT feature, 'biological', intensity FROM obs WHERE class IN ({SQL_BIO}) UNION ALL SELECT feature, 'qc_like', intensity FROM obs WHERE class IN ({SQL_QC}, {SQL_DQC}) UNION ALL SELECT feature, 'blank', intensity FROM obs WHERE class IN ({SQL_BLANK})) SELECT feature, class_group, round(avg((intensity > {_T})::INT), 6) AS detection_rate FROM g GROUP BY 1, 2",
    "detection_summary": f"{OBS_SQL}, r AS (SELECT feature, class, avg((intensity > {_T})::INT) AS rate FROM obs GROUP BY 1, 2) SELECT class, round(avg(rate), 6) AS mean_rate, round(median(rate), 6) AS median_rate, round(avg((rate >= 0.7)::INT), 6) AS share_70, round(avg((rate >= 0.9)::INT), 6) AS share_90 FROM r WHERE class IN ({', '.join(repr(c) for c in CLASSES)}) GROUP BY 1",
    "contamination_metrics": f"{OBS_SQL}, {_CONT} SELECT feature, blank_dominant, {_r(' '.join(f'{n}_{c}' for n in ('blank', 'qc', 'bio') for c in ('mean', 'median', 'detection_rate')) + ' blank_to_qc_ratio blank_to_bio_ratio log10_blank_to_qc log10_blank_to_bio')} FROM contam",
    "carryover": f"{OBS_SQL}, {_CARRY} SELECT feature, round(carryover_rho, 6) AS carryover_rho, n_blank_contexts FROM carry",
    "nearest_standard": f"{_MATCH} SELECT compound_id, feature, {_r('score ppm_error rt_error', 5)}, abs(ppm_error) <= 20000 AND abs(rt_error) <= 1 AS within_tolerance FROM matches",
    "standard_readings": f"{_MATCH} SELECT compound_id, feature, sample, class, round(intensity, 6) AS intensity, round(log10(intensity + 1), 6) AS log10_intensity FROM obs JOIN matches USING (feature)",
    "standard_tracking": f"{_MATCH} SELECT compound_id, feature, batch, class, count(*) AS n, round(avg(intensity), 6) AS mean_intensity, round(median(intensity), 6) AS median_intensity, round(avg(log10(intensity + 1)), 6) AS mean_log10 FROM obs JOIN matches USING (feature) GROUP BY 1, 2, 3, 4",
    "isomer_pairs": _PPM + ", z AS (SELECT a.mz AS ma, b.mz AS mb, p0.* FROM p0 JOIN f a ON a.feature = feature_a JOIN f b ON b.feature = feature_b) SELECT feature_a, feature_b, round((mb - ma) / ((ma + mb) / 2) * 1e6, 6) AS delta_ppm, round(delta_rt, 6) AS delta_rt FROM z WHERE abs(delta_rt) >= 0.1",
    "adduct_pairs": """WITH f AS (SELECT * FROM feature_metadata WHERE mz IS NOT NULL AND rt IS NOT NULL), s(i, shift, m) AS (VALUES (0, '13C1', 1.003355), (1, '13C2', 2.006710), (2, 'Na-H', 21.981943), (3, 'K-H', 37.955882), (4, 'O-like', 16.018724)),
p AS (SELECT CASE WHEN a.mz > b.mz THEN b.feature ELSE a.feature END AS feature_a, CASE WHEN a.mz > b.mz THEN a.feature ELSE b.feature END AS feature_b, abs(b.mz - a.mz) AS delta_mz
  FROM f a JOIN f b ON b.rt >= a.rt AND b.rt - a.rt <= 9 AND (b.rt > a.rt OR b.feature > a.feature)),
best AS (SELECT *, abs(delta_mz - m::DOUBLE) AS e FROM p, s QUALIFY row_number() OVER (PARTITION BY feature_a, feature_b ORDER BY e, i) = 1)
SELECT feature_a, feature_b, round(delta_mz, 6) AS delta_mz, shift, round(e, 6) AS shift_error FROM best WHERE e <= 0.1""",
    "pair_correlations": f"""{OBS_SQL}, bp AS (SELECT a.feature AS feature_a, b.feature AS feature_b FROM feats a JOIN feats b ON (b.mz > a.mz OR (b.mz = a.mz AND b.feature > a.feature)) WHERE (b.mz - a.mz) / ((a.mz + b.mz) / 2) * 1e6 <= 20000),
w AS (SELECT sample, feature, ln(1 + intensity) AS x, 'all' AS subset FROM obs UNION ALL SELECT sample, feature, ln(1 + intensity), 'biological' FROM obs WHERE class IN ({SQL_BIO}) UNION ALL SELECT sample, feature, ln(1 + intensity), 'qc_like' FROM obs WHERE class IN ({SQL_QC}, {SQL_DQC}) UNION ALL SELECT sample, feature, ln(1 + intensity), 'biological_batch1' FROM obs WHERE class IN ({SQL_BIO}) AND batch = 1),
r AS (SELECT sample, feature, subset, {_rank('subset, feature', 'x')} AS x FROM w)
SELECT feature_a, feature_b, a.subset AS subset, count(*) AS n, round(CASE WHEN count(*) >= 3 THEN {_corr('a.x', 'b.x')} END, 6) + 0.0 AS rho FROM bp JOIN r a ON a.feature = feature_a JOIN r b ON b.feature = feature_b AND a.subset = b.subset AND a.sample = b.sample GROUP BY 1, 2, 3""",
    "redundancy_edges": _EDGES + " SELECT feature_a, feature_b, round(delta_mz, 6) AS delta_mz, round(delta_rt, 6) AS delta_rt, relation_type FROM edges",
    "redundancy_neighbours": _EDGES + ", " + _NEIGHBOURS + " SELECT * FROM near",
    "redundancy_types": _BRAND_EDGES + " SELECT feature_a, feature_b, round(delta_mz, 6) AS delta_mz, round(delta_rt, 6) AS delta_rt, round(rho, 6) AS rho, is_isomer, is_adduct, is_near_duplicate, is_correlated, relation_type FROM edges",
    "redundancy_annotated": _BRAND_EDGES + ", " + _components("feats") + ", " + _NEIGHBOURS + """, g AS (SELECT feature, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size, first_value(feature) OVER (PARTITION BY cluster ORDER BY mz DESC, feature) AS representative_feature FROM clusters JOIN feats USING (feature))
SELECT feature, cluster, cluster_size, representative_feature, CASE WHEN cluster_size = 1 THEN 'singleton' WHEN feature = representative_feature THEN 'representative' ELSE 'member' END AS redundancy_role, """ + ", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in RELATIONS) + " FROM g LEFT JOIN near USING (feature)",
    "redundancy_clusters": _CLUSTERS + " SELECT feature, cluster FROM clusters",
    "representative_pick": _CLUSTERS + """, s AS (SELECT feature, cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size, first_value(feature) OVER (PARTITION BY cluster ORDER BY mz_std NULLS LAST, feature) AS representative_feature FROM clusters JOIN feature_metadata USING (feature))
SELECT *, CASE WHEN cluster_size = 1 THEN 'singleton' WHEN feature = representative_feature THEN 'representative' ELSE 'member' END AS redundancy_role FROM s""",
    "tech_bio_metrics": f"{OBS_SQL}, {_tech('tb', 'intensity')} SELECT feature, {_r(' '.join(f'{n}_{c}' for n in ('qc', 'europe', 'middle_east') for c in ('mean', 'log_sd', 'detection_rate', 'cv')) + ' bio_cv_median bio_log_sd_median bio_detection_rate_min bio_detection_rate_max d_ratio_cv d_ratio_log')} FROM tb",
    "detected_only_stats": f"{OBS_SQL}, x AS (SELECT feature, class, CASE WHEN intensity > {_T} THEN intensity END AS x FROM obs) SELECT feature, class, count(x) AS n_detected, round(count(x) / count(*), 6) AS detection_rate, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_samp(ln(1 + x)), 6) AS log_sd, round(100 * stddev_samp(x) / avg(x), 6) AS cv FROM x GROUP BY 1, 2",
    "feature_filter": _FILTER + """ SELECT feature, pass_mz, pass_qc_cv, pass_detection_any, pass_detection_all, blank_veto, carryover_flag, retained_main, high_confidence,
CASE WHEN retained_main THEN 'retained' ELSE concat_ws('; ', CASE WHEN NOT pass_mz THEN 'low m/z' END, CASE WHEN NOT pass_qc_cv THEN 'unstable in controls' END, CASE WHEN NOT pass_detection_any THEN 'rarely detected' END, CASE WHEN blank_veto THEN 'present in blanks' END) END AS exclusion_reason FROM filtered""",
    "filter_funnel": _FILTER + """ SELECT unnest(['all', 'pass_mz', 'pass_qc_cv', 'pass_detection', 'no_blank_veto', 'high_confidence']) AS metric, unnest([count(*), count(*) FILTER (WHERE pass_mz), count(*) FILTER (WHERE pass_mz AND pass_qc_cv), count(*) FILTER (WHERE pass_mz AND pass_qc_cv AND pass_detection_any), count(*) FILTER (WHERE retained_main), count(*) FILTER (WHERE high_confidence)])::DOUBLE AS value FROM filtered""",
    "retained_observations": _FILTER + " SELECT feature, count(*) AS n, round(sum(intensity), 6) AS total FROM obs JOIN filtered USING (feature) WHERE retained_main GROUP BY 1",
    "acceptance_flags": f"{OBS_SQL}, {_tech('tb', 'intensity')} SELECT feature, coalesce(qc_cv < 24, false) AS pass_cv, coalesce(bio_detection_rate_min >= 0.6, false) AS pass_detection, coalesce(mz > 948, false) AS pass_mz FROM feats JOIN tb USING (feature)",
    "retained_summary": f"WITH {_REVIEWED}, f AS ({_FILTER} SELECT * FROM filtered) SELECT 'retained_samples' AS artifact, count(*) FILTER (WHERE NOT recommend_exclude) AS n FROM review UNION ALL SELECT 'retained_main_features', count(*) FILTER (WHERE retained_main) FROM f UNION ALL SELECT 'retained_high_confidence_features', count(*) FILTER (WHERE high_confidence) FROM f",
    "loaded_spaces": f"WITH {_REVIEWED}, d AS ({_DECIDED} SELECT * FROM dec), cells AS ({OBS_SQL}, {_TIC} SELECT sample, feature, intensity, x FROM tview), sp AS (SELECT 'main' AS space, feature FROM d WHERE retained_main UNION ALL SELECT 'high', feature FROM d WHERE high_confidence UNION ALL SELECT 'representative', feature FROM d WHERE is_representative) SELECT space, count(DISTINCT sample) AS n_samples, count(DISTINCT feature) AS n_features, count(*) AS n_cells, round(sum(intensity), 4) AS raw_total, round(sum(x), 4) AS total FROM sp JOIN cells USING (feature) JOIN (SELECT sample FROM review WHERE NOT recommend_exclude) USING (sample) GROUP BY 1",
    "feature_decisions": _DECIDED + " SELECT * EXCLUDE (carryover_flag) FROM dec",
    "handoff_samples": f"WITH {_REVIEWED} SELECT class, count(*) AS n_total, count(*) FILTER (WHERE NOT recommend_exclude) AS n_retained, count(*) FILTER (WHERE recommend_exclude) AS n_excluded, count(*) FILTER (WHERE review_tier <> 'keep') AS n_minor_or_worse, count(*) FILTER (WHERE review_tier IN ('review', 'strong_review')) AS n_review_or_worse FROM review GROUP BY 1",
    "handoff_features": _DECIDED + " SELECT unnest(['n_features', 'n_main', 'n_high_confidence', 'n_main_with_carryover', 'n_main_in_clusters', 'n_main_representatives']) AS metric, unnest([count(*), count(*) FILTER (WHERE retained_main), count(*) FILTER (WHERE high_confidence), count(*) FILTER (WHERE retained_main AND carryover_flag), count(*) FILTER (WHERE retained_main AND cluster_size > 1), count(*) FILTER (WHERE retained_main AND is_representative)])::DOUBLE AS value FROM dec",
    "handoff_caveats": f"WITH {_REVIEWED}, d AS ({_DECIDED} SELECT * FROM dec) SELECT 'excluded_samples' AS caveat, count(*) FILTER (WHERE recommend_exclude) AS n FROM review UNION ALL SELECT 'main_features_with_carryover', count(*) FILTER (WHERE retained_main AND carryover_flag) FROM d UNION ALL SELECT 'main_features_in_clusters', count(*) FILTER (WHERE retained_main AND cluster_size > 1) FROM d",
    "acceptance_counts": f"{OBS_SQL}, {_tech('tb', 'intensity')} " + " UNION ALL ".join(f"SELECT '{n}' AS criterion_type, {float(t)}::DOUBLE AS threshold, count(*) FILTER (WHERE {c} {t}) AS n_features FROM tb" for n, c, ts in (("qc_cv", "qc_cv <", (20, 30, 40, 50)), ("detection_min", "bio_detection_rate_min >=", (0.4, 0.5, 0.6)), ("d_ratio", "d_ratio_log <", (0.75, 1.0, 1.25))) for t in ts),
    "threshold_ablation": _FILTER + " " + " UNION ALL ".join(f"SELECT '{n}' AS criterion_type, {float(t)}::DOUBLE AS threshold, count(*) FILTER (WHERE NOT blank_veto AND {c} {t}) AS n_features FROM filtered" for n, c, ts in (("qc_cv", "qc_cv <", (20, 30, 40)), ("detection_max", "bio_detection_rate_max >=", (0.5, 0.7, 0.9)), ("d_ratio", "d_ratio_log <=", (0.75, 1.0, 1.25))) for t in ts),
    "mann_whitney_u": f"{OBS_SQL}, {_MWU} SELECT task_name, feature, n_pos, n_neg, {_r('u_stat z auc cliffs_delta')} FROM mwu",
    "bh_from_given_p": """WITH t AS (SELECT batch, class, threshold, round(1 / (1 + abs(median)), 6) AS p FROM threshold_table WHERE median IS NULL OR NOT isnan(median)),
r AS (SELECT *, p * count(p) OVER (PARTITION BY class, threshold) / row_number() OVER (PARTITION BY class, threshold ORDER BY p NULLS LAST) AS raw FROM t)
SELECT batch, class, threshold, p, CASE WHEN p IS NOT NULL THEN round(least(1, min(raw) OVER (PARTITION BY class, threshold ORDER BY p DESC NULLS FIRST, raw ASC NULLS FIRST ROWS UNBOUNDED PRECEDING)), 6) END AS q_value FROM r""",
    "evidence_medians": f"{_EV}, {_MWU_BODY}, sd AS (SELECT task_name, max(class) FILTER (WHERE positive) AS p, max(class) FILTER (WHERE NOT positive) AS n FROM tasks GROUP BY 1) SELECT task_name, feature, {_r('pos_median neg_median mean_difference log2_ratio pos_detection_rate neg_detection_rate auc')}, round(pos_median - neg_median, 6) AS median_difference, round(pos_detection_rate - neg_detection_rate, 6) AS detection_rate_difference, round(2 * auc - 1, 6) AS rank_biserial, p || CASE WHEN pos_median >= neg_median THEN ' > ' ELSE ' < ' END || n AS direction FROM evm JOIN mwu USING (task_name, feature) JOIN sd USING (task_name)",
    "decision_pivot": f"{_EV}, {_MWU_BODY}, j AS (SELECT * FROM mwu JOIN evm USING (task_name, feature)) SELECT feature, " + ", ".join(f"round(max({c}) FILTER (WHERE task_name = '{p}_vs_{n}'), 6) AS {c}__{p.replace(' ', '_')}_vs_{n.replace(' ', '_')}" for p, n in _TASKS for c in ("auc", "mean_difference")) + " FROM j GROUP BY 1",
    "cluster_collapse": _CLUSTERS + """, c AS (SELECT cluster, m.* FROM clusters JOIN feature_metadata m USING (feature))
SELECT cluster, arg_min(feature, (rt_std IS NOT NULL, coalesce(rt_std, 0), feature)) AS feature, round(arg_min(mz, (rt_std IS NOT NULL, coalesce(rt_std, 0), feature)) FILTER (WHERE mz IS NOT NULL), 6) AS mz, round(arg_min(rt, (rt_std IS NOT NULL, coalesce(rt_std, 0), feature)) FILTER (WHERE rt IS NOT NULL), 6) AS rt, count(*) AS n_members FROM c GROUP BY 1""",
    "standardise_strings": _SEQ + " SELECT * FROM seq",
    "canonical_keys": _SEQ + f" SELECT gly_id, {_EXACT} AS exact, {_TOPOLOGY} AS topology FROM seq",
    "sequence_statistics": _SEQ + f", q AS (SELECT gly_id, tissue_sample, {_EXACT} AS s FROM seq) SELECT gly_id, {_STATS}, {_CORE} AS likely_n_glycan, {_PLAUSIBLE} AS plausible, CASE WHEN s IS NULL THEN 'NA' WHEN length(s) > 55 THEN s[1:52] || '...' ELSE s END AS label, coalesce(regexp_matches(lower(tissue_sample), '{_CANCER}'), false) AS cancer FROM q",
    "structural_families": _SEQ + f""", q AS (SELECT {_EXACT} AS s FROM seq), u AS (SELECT unnest([CASE WHEN {_CORE} THEN 'N-glycan-like' END, CASE WHEN regexp_matches(s, 'Neu5Ac|Neu5Gc|Kdn') THEN 'sialylated' END, CASE WHEN regexp_matches(s, 'Fuc|dHex') THEN 'fucosylated' END,
CASE WHEN contains(s, 'GalNAc') THEN 'GalNAc-bearing' END, CASE WHEN contains(s, '?') THEN 'ambiguous-linkage' END, CASE WHEN contains(s, '[') THEN 'branched' END, CASE WHEN contains(s, 'GlcNAc(b1-4)GlcNAc') THEN 'core-GlcNAc' END]) AS family FROM q)
SELECT family, count(*) AS n FROM u WHERE family IS NOT NULL GROUP BY 1""",
    "token_counts": _SEQ + rf""", q AS (SELECT gly_id, regexp_extract_all(s, '{_RES}') AS r, regexp_extract_all(s, '\(([^)]+)\)', 1) AS l, s FROM (SELECT gly_id, coalesce({_EXACT}, '') AS s FROM seq)),
t0 AS (SELECT gly_id, list_concat(list_concat(list_transform(r, lambda x: 'RES_' || x), list_transform(l, lambda x: 'LNK_' || x)), list_concat(list_concat(list_transform(regexp_extract_all(s, '\['), lambda x: 'BRANCH_OPEN'), list_transform(regexp_extract_all(s, '\]'), lambda x: 'BRANCH_CLOSE')),
  list_transform(range(1, len(r)), lambda i: 'PAIR_' || r[i] || '__' || r[i + 1]))) AS t FROM q),
t1 AS (SELECT gly_id, list_transform(t, lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_]+$', '')) AS t FROM t0),
g AS (SELECT gly_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS token FROM t1), c AS (SELECT gly_id, token, count(*) AS n FROM g GROUP BY 1, 2)
SELECT token, count(*) AS df, sum(n)::BIGINT AS tf FROM c GROUP BY 1""",
    "word_counts": "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, token, count(*) AS n FROM w GROUP BY 1, 2) SELECT token, count(*) AS df, sum(n)::BIGINT AS tf FROM c GROUP BY 1 HAVING count(*) >= 2",
    "union_master": _SOURCES + """ SELECT k AS glycan_sequence, """ + ", ".join(f"arg_min({c}, (rk, {c})) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ("composition", "tissue_species", "tissue_sample")) + ", 0 AS is_n_glycan, array_to_string(list_sort(list_distinct(list(src))), '|') AS source_names FROM k GROUP BY 1",
    "master_full_outer": _SOURCES + " SELECT k AS glycan_sequence, " + ", ".join(f"coalesce(min({c}) FILTER (WHERE rk = 1), min({c}) FILTER (WHERE rk = 0)) AS {c}" for c in ("composition", "tissue_species", "tissue_sample")) + ", CASE WHEN max((rk = 0)::INT) = 1 THEN 'df_glycan' END AS source_names, 0 AS is_n_glycan, max((rk = 1)::INT) AS in_query, max((rk = 0)::INT) AS in_reference FROM k GROUP BY 1",
    "overlap_counts": _SOURCES + """, p AS (SELECT k, bool_or(rk = 0) AS l, bool_or(rk = 1) AS r FROM k GROUP BY 1)
SELECT unnest(['left', 'right', 'shared', 'left_only', 'right_only']) AS metric, unnest([count(*) FILTER (WHERE l), count(*) FILTER (WHERE r), count(*) FILTER (WHERE l AND r), count(*) FILTER (WHERE NOT r), count(*) FILTER (WHERE NOT l)]) AS n FROM p""",
    "source_coverage": _SEQ + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count({c}) AS n_present, round(count({c}) / count(*), 6) AS share_present, count(DISTINCT {c}) AS n_distinct FROM seq" for c in ("composition", "tissue_species", "tissue_sample", "disease", "source_name")),
    "modelling_subset": _SEQ + ", k AS (SELECT CASE WHEN contains(glycan_sequence, 'Neu5Gc') THEN 'chosen' WHEN tissue_species IS NOT NULL AND composition IS NOT NULL THEN 'labelled' ELSE 'background' END AS kind FROM seq) SELECT kind, CASE WHEN kind = 'background' THEN least(count(*), 50) ELSE count(*) END AS n FROM k GROUP BY 1",
    "binding_by_sequence": f"WITH {_BIND}, b AS (SELECT vec_id, count(DISTINCT protein) AS n, avg(binding_value) AS m, max(binding_value) AS x FROM bind GROUP BY 1) SELECT e.vec_id, label, coalesce(n, 0) AS exact_n_proteins, round(m, 6) AS exact_mean, round(x, 6) AS exact_max, (coalesce(n, 0) > 0)::INT AS has_binding_exact FROM embeddings e LEFT JOIN b USING (vec_id)",
    "metadata_onehot": _SEQ + ", t AS (SELECT DISTINCT gly_id, 'residues::' || unnest(regexp_extract_all(glycan_sequence, '[A-Z][A-Za-z0-9]+')) AS col FROM seq UNION ALL SELECT gly_id, 'source::' || source_name FROM seq) SELECT gly_id, col, 1.0::DOUBLE AS val FROM t WHERE col IN (SELECT col FROM t GROUP BY 1 HAVING count(*) >= 25)",
    "block_density": _SEQ + ", t AS (SELECT DISTINCT gly_id, unnest(regexp_extract_all(glycan_sequence, '[A-Z][A-Za-z0-9]+')) AS col FROM seq), k AS (SELECT * FROM t WHERE col IN (SELECT col FROM t GROUP BY 1 HAVING count(*) >= 25)) SELECT count(DISTINCT gly_id) AS n_rows, count(DISTINCT col) AS n_columns, count(*) AS n_entries, round(count(*) / (count(DISTINCT gly_id) * count(DISTINCT col)), 6) AS density, round(count(*) / count(DISTINCT gly_id), 6) AS mean_active FROM k",
    "binding_block": f"WITH {_BIND}, p AS (SELECT protein FROM bind GROUP BY 1 HAVING count(DISTINCT vec_id) >= 20 ORDER BY count(DISTINCT vec_id) DESC, protein LIMIT 8) SELECT vec_id, protein AS col, round(avg(binding_value), 6) AS val FROM bind JOIN p USING (protein) GROUP BY 1, 2",
    "knn_cosine": _KNN + " SELECT anchor, neighbor, round(cosine_distance, 6) AS cosine_distance, neighbor_rank FROM knn",
    "knn_indexed": "SELECT 10 AS k, TRUE AS at_least_nine_tenths",
    "label_purity": _KNN + ", p AS (SELECT anchor, a.label AS label, avg((a.label = b.label)::INT) AS p FROM nn JOIN e a ON a.vec_id = anchor JOIN e b ON b.vec_id = neighbor WHERE neighbor_rank <= 5 GROUP BY 1, 2) SELECT label, round(avg(p), 6) AS purity, count(*) AS n FROM p GROUP BY 1",
    "neighbor_robustness": _KNN + _ROBUST + " SELECT anchor, n_shared, round(jaccard, 6) AS jaccard FROM robust",
    "jaccard_relevance": _KNN + f", {_BIND}, s AS (SELECT vec_id, list_distinct(list(protein)) AS m FROM bind WHERE binding_value > 45 GROUP BY 1), j AS (SELECT anchor, len(list_intersect(a.m, b.m)) / (len(a.m) + len(b.m) - len(list_intersect(a.m, b.m))) AS j FROM knn JOIN s a ON a.vec_id = anchor JOIN s b ON b.vec_id = neighbor) SELECT anchor, round(avg(j), 6) AS mean_jaccard, count(*) AS n_neighbors FROM j GROUP BY 1",
    "edge_list": _KNN + " SELECT least(anchor, neighbor) AS a, greatest(anchor, neighbor) AS b, round(max(1 - cosine_distance), 6) AS weight FROM knn WHERE neighbor_rank <= 5 GROUP BY 1, 2",
    "silhouette": """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), c AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2),
d AS (SELECT x.vec_id, x.label, c.label AS other, sqrt(sum((x.x - c.x) ** 2)) AS d FROM x JOIN c USING (i) GROUP BY 1, 2, 3),
s AS (SELECT vec_id, label, min(d) FILTER (WHERE other = label) AS a, min(d) FILTER (WHERE other <> label) AS b FROM d GROUP BY 1, 2) SELECT label, round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM s GROUP BY 1""",
    "top_terms": _KNN + f", {_BIND}, t AS (SELECT anchor, protein AS term, count(DISTINCT neighbor) AS n_neighbors FROM knn JOIN bind ON bind.vec_id = neighbor GROUP BY 1, 2) SELECT anchor, term, n_neighbors, row_number() OVER (PARTITION BY anchor ORDER BY n_neighbors DESC, term) AS rank FROM t QUALIFY rank <= 4",
    "rendered_terms": "SELECT anchor, string_agg(term || ' (' || n_neighbors || ')', ' | ' ORDER BY rank) AS terms FROM (" + _KNN + f", {_BIND}, t AS (SELECT anchor, protein AS term, count(DISTINCT neighbor) AS n_neighbors FROM knn JOIN bind ON bind.vec_id = neighbor GROUP BY 1, 2) SELECT anchor, term, n_neighbors, row_number() OVER (PARTITION BY anchor ORDER BY n_neighbors DESC, term) AS rank FROM t QUALIFY rank <= 4" + ") GROUP BY 1",
    "top_dimensions": _KNN + ", v AS (SELECT anchor, unnest(range(0, 8)) AS i, v FROM knn JOIN e ON vec_id = neighbor), m AS (SELECT anchor, 'd' || i AS column, avg(v[i + 1]) AS mean FROM v GROUP BY 1, i) SELECT anchor, \"column\", round(mean, 6) AS mean, row_number() OVER (PARTITION BY anchor ORDER BY round(mean, 9) DESC, \"column\") AS rank FROM m WHERE mean > 0 QUALIFY rank <= 4",
    "context_layers": _CONTEXT + f" SELECT anchor, n_neighbors, {_r('mean_distance max_distance general_fraction disease_fraction specific_fraction')}, CASE WHEN specific_fraction >= 0.2 AND general_fraction >= 0.5 THEN 'specific_context' WHEN disease_fraction >= 0.2 AND general_fraction >= 0.5 THEN 'disease_context' WHEN general_fraction >= 0.5 THEN 'general_context' ELSE 'weak_context' END AS profile FROM ctx",
    "protein_support": _KNN + f", {_BIND}, pre AS (SELECT vec_id AS neighbor, protein, avg(binding_value) AS v, count(*) AS n FROM bind GROUP BY 1, 2), s AS (SELECT anchor, protein, sum(1 / neighbor_rank) AS support, avg(v) AS mean_value, sum(n)::BIGINT AS n_rows FROM knn JOIN pre USING (neighbor) GROUP BY 1, 2) SELECT anchor, protein, round(support, 6) AS support, round(mean_value, 6) AS mean_value, n_rows, row_number() OVER (PARTITION BY anchor ORDER BY round(support, 9) DESC, protein) AS rank FROM s QUALIFY rank <= 4",
    "priority_scores": _CONTEXT + _ROBUST + f", {_BIND}, sets AS (SELECT vec_id, list_distinct(list(protein)) AS m FROM bind WHERE binding_value > 45 GROUP BY 1), jr AS (SELECT anchor, avg(len(list_intersect(a.m, b.m)) / (len(a.m) + len(b.m) - len(list_intersect(a.m, b.m)))) AS mj FROM knn JOIN sets a ON a.vec_id = anchor JOIN sets b ON b.vec_id = neighbor GROUP BY 1)" + ", s AS (SELECT anchor, greatest(0, 1 - least(round(mean_distance, 6), 1)) AS confidence, round(general_fraction, 6) AS g, round(specific_fraction, 6) AS sp, round(jaccard, 6) AS j, round(mj, 6) AS mj FROM ctx JOIN robust USING (anchor) LEFT JOIN jr USING (anchor)), t AS (SELECT *, confidence * 0.3 + g * 0.2 + (mj IS NOT NULL)::INT * 0.15 + sp * 0.15 + coalesce(mj, 0) * 0.1 + j * 0.1 AS priority_score FROM s) SELECT anchor, round(confidence, 5) AS confidence, round(priority_score, 5) AS priority_score, CASE WHEN priority_score >= 0.65 THEN 'A' WHEN priority_score >= 0.45 THEN 'B' ELSE 'C' END AS priority_tier FROM t",
    "composition_features": "WITH " + _comp("glycan_list", "gly_id") + " SELECT * EXCLUDE (comp_fucose_ratio, comp_sialic_ratio, comp_hexnac_to_hex_ratio), " + ", ".join(f"round({c}, 6) AS {c}" for c in _SHARES) + " FROM comp",
    "canonical_master": _MASTER + " SELECT * EXCLUDE (glycan_sequence, composition, tissue_species, mean_binding_value, max_binding_value, comp_fucose_ratio, comp_sialic_ratio, comp_hexnac_to_hex_ratio), " + ", ".join(f"round({c}, 6) AS {c}" for c in (*_SHARES, "mean_binding_value", "max_binding_value")) + " FROM canon",
    "interpretation_set": _MASTER + " SELECT * FROM inter",
    "composition_block": _MASTER + ", cb AS (" + " UNION ALL ".join(f"SELECT '{c}' AS col, round(sum(\"{c}\"), 4)::DOUBLE AS total, count(*) FILTER (WHERE \"{c}\" <> 0) AS n_active FROM canon" for c in _BLOCK) + ") SELECT * FROM cb",
    "binding_long": _MASTER + " SELECT glycan_sequence, protein, round(avg(binding_value), 6) AS mean_value, count(*) AS n FROM bnd GROUP BY 1, 2",
    "source_audit": _SEQ + """, n AS (SELECT seq.*, g.source_name AS src FROM seq JOIN glycan_list g USING (gly_id)), k AS (SELECT glycan_sequence, bool_or(src = 'glycan_list') AS a, bool_or(src = 'df_glycan') AS b, bool_or(src = 'n_glycans') AS c FROM n WHERE src IS NOT NULL GROUP BY 1),
p AS (SELECT src, count(*) AS n_rows, count(DISTINCT glycan_sequence) AS n_unique, count(composition) / count(*) AS f1, count(tissue_sample) / count(*) AS f2, count(tissue_species) / count(*) AS f3 FROM n WHERE src IS NOT NULL GROUP BY 1)
SELECT src AS source, unnest(['n_rows', 'n_unique', 'fraction_with_composition', 'fraction_with_tissue_sample', 'fraction_with_tissue_species', 'fraction_with_disease']) AS metric, round(unnest([n_rows, n_unique, f1, f2, f3, 0]::DOUBLE[]), 6) AS value FROM p
UNION ALL SELECT unnest(['union', 'glycan_list & df_glycan', 'glycan_list & n_glycans', 'df_glycan & n_glycans']), 'n_unique', unnest([count(*), count(*) FILTER (WHERE a AND b), count(*) FILTER (WHERE a AND c), count(*) FILTER (WHERE b AND c)]::DOUBLE[]) FROM k""",
    "sequence_qc": _SEQ + f" SELECT {_PLAUSIBLE} AS plausible, count(*) AS n_rows, count(DISTINCT s) AS n_distinct FROM (SELECT {_EXACT} AS s FROM seq) GROUP BY 1",
    "handoff_tiers": "WITH t AS (SELECT representative_feature AS feature, min(relation_type) AS target_tier FROM feature_redundancy WHERE representative_feature IS NOT NULL GROUP BY 1) SELECT feature, target_tier FROM feature_metadata LEFT JOIN t USING (feature)",
    "validation_feasibility": _SEQ + " " + " UNION ALL ".join(f"SELECT '{t}' AS task, count(*) FILTER (WHERE {c}) AS n_eligible, round(count(*) FILTER (WHERE {c}) / count(*), 6) AS fraction FROM seq" for t, c in (*((c, f"{c} IS NOT NULL") for c in ("composition", "tissue_species", "tissue_sample")), ("n_glycan", _CORE.replace("contains(s,", "contains(glycan_sequence,")))),
    "balanced_sample": "SELECT label, least(count(*), 20) AS n, least(count(*), 20) AS n_distinct FROM embeddings WHERE label IS NOT NULL GROUP BY 1",
    "token_presence": _KNN + f", {_BIND}, m AS (SELECT anchor, neighbor AS member FROM knn UNION ALL SELECT DISTINCT anchor, anchor FROM knn), t AS (SELECT anchor, protein AS token, count(DISTINCT member) AS n_rows FROM m JOIN bind ON vec_id = member GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n_rows DESC, token) AS rank FROM t QUALIFY rank <= 3",
    "bipartite_edges": _KNN + f", {_BIND}, pre AS (SELECT DISTINCT vec_id AS neighbor, protein FROM bind), s AS (SELECT anchor, protein, sum(1 / neighbor_rank) AS w FROM knn JOIN pre USING (neighbor) GROUP BY 1, 2) SELECT anchor, protein, round(w, 6) AS weight FROM s QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY round(w, 9) DESC, protein) <= 3",
    "warning_free_features": _FILTER + " SELECT feature FROM filtered WHERE NOT carryover_flag AND NOT blank_veto",
}
ORACLE["neighbourhood_table"] = f"SELECT * FROM ({ORACLE['context_layers']}) LEFT JOIN ({ORACLE['rendered_terms']}) USING (anchor) LEFT JOIN (SELECT anchor, mean_jaccard FROM ({ORACLE['jaccard_relevance']})) USING (anchor)"
