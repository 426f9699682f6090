"""Queries of sources, data quality and representation."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline import families
from emberline.functions.scalars import r6, transform
from emberline.operators import quality as Q
from emberline.operators import represent as R
from emberline.plans.catalog import query
from emberline.plans.oracle_parts import EVR, EVT, FLOOR, HIGH, LOW, TEL, TU, U, inv
from emberline.plans.oracle_parts import r6 as o6
from emberline.registry import REGISTRY
from emberline.sources import adapters as A
from emberline.sources import ingest as I

W = "WITH "


def labels_v1(spark, d):
    """Label rows derived from the telemetry itself: deviation threshold 0.2."""
    tel = A.telemetry_parts(spark, d)
    flags = R.first_abnormal(tel, 0.2).drop("lot_id")
    return tel.join(flags, ["component_id", "parameter_name"])


LABELS_SQL = TEL + """,
zer AS (SELECT *, max(CASE WHEN elapsed_hours = 0 THEN value END) OVER (PARTITION BY component_id, parameter_name) AS z FROM tel),
dev AS MATERIALIZED (SELECT * EXCLUDE (z), CASE WHEN z = 0 THEN 0.0::DOUBLE ELSE (value - z) / z END AS r FROM zer WHERE z IS NOT NULL),
fab AS MATERIALIZED (SELECT component_id, lot_id, parameter_name, min(CASE WHEN abs(r) >= 0.2 THEN elapsed_hours END) AS first_abnormal_hour FROM dev GROUP BY 1, 2, 3)"""


@query("scan_telemetry", W + TEL + f" SELECT component_id, lot_id, parameter_name, elapsed_hours, {o6('value')} AS value, unit, 'real' AS source_type FROM tel")
def scan_telemetry(spark, d):
    df = I.tag_source(Q.assert_no_labels(Q.assert_columns(A.telemetry_parts(spark, d))), "real")
    return df.select("component_id", "lot_id", "parameter_name", "elapsed_hours", r6("value").alias("value"), "unit", "source_type")


@query(
    "ingest_coerce",
    W + EVR + """ SELECT reject_reason, lot_id, count(*) AS n_rows, count(DISTINCT component_id) AS n_components, round(sum(v), 2) AS total FROM (
 SELECT *, CASE WHEN event_id % 7 = 0 THEN 'MISSING_FIELD' WHEN event_id % 11 = 0 THEN 'NON_NUMERIC_VALUE' ELSE 'ACCEPTED' END AS reject_reason,
 CASE WHEN event_id % 11 <> 0 THEN value END AS v FROM evr) GROUP BY 1, 2""",
)
def ingest_coerce(spark, d):
    ev = A.event_readings(spark, d)
    rec = ev.select(
        "event_id",
        F.when(F.col("event_id") % 7 == 0, " ").otherwise(F.col("parameter_name")).alias("parameter_name"),
        "component_id", "lot_id",
        F.col("elapsed_hours").cast("string").alias("elapsed_hours"),
        F.when(F.col("event_id") % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
    )
    out = I.coerce(rec)
    return out.groupBy(F.coalesce("reject_reason", F.lit("ACCEPTED")).alias("reject_reason"), "lot_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("component_id").alias("n_components"),
        F.round(F.sum("value_num"), 2).alias("total"),
    )


@query(
    "upload_profile",
    W + EVR + """, k AS (SELECT component_id, parameter_name, elapsed_hours, count(*) AS c FROM evr GROUP BY 1, 2, 3)
SELECT (SELECT count(*) FROM evr) AS n_rows, (SELECT count(*) FROM evr WHERE value IS NULL) AS n_missing, CAST(0 AS BIGINT) AS n_invalid,
 '0,24,96,168' AS checkpoints, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT parameter_name AS p FROM evr)) AS parameters,
 (SELECT CAST(sum(c - 1) AS BIGINT) FROM k) AS n_duplicate, (SELECT count(DISTINCT component_id) FROM evr) AS n_components,
 (SELECT count(DISTINCT lot_id) FROM evr) AS n_lots, 'NEEDS_REVIEW' AS readiness""",
)
def upload_profile(spark, d):
    return I.upload_profile(A.event_readings(spark, d))


@query(
    "sensor_matrix_long",
    """SELECT vec_id AS row_id, i - 1 AS sensor_id, CASE WHEN (vec_id * 31 + i - 1) % 17 = 0 THEN NULL ELSE round(CAST(embedding[i] AS DOUBLE), 6) + 0.0::DOUBLE END AS value
FROM embeddings, range(1, 65) t(i)""",
)
def sensor_matrix_long(spark, d):
    return A.sensor_matrix(spark, d).select("row_id", F.col("sensor_id").cast("bigint").alias("sensor_id"), r6("value").alias("value"))


@query(
    "component_metadata",
    W + EVT + """ SELECT component_id, lot_id, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT elapsed_hours AS t FROM evt b WHERE b.component_id = a.component_id)) AS checkpoints,
 (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT parameter_name AS p FROM evt b WHERE b.component_id = a.component_id)) AS parameters
FROM (SELECT DISTINCT component_id, lot_id FROM evt) a""",
)
def component_metadata(spark, d):
    return I.component_metadata(A.telemetry_events(spark, d))


@query(
    "union_dedup",
    W + EVT + """, s1 AS (SELECT * FROM evt WHERE elapsed_hours <= 24), s2 AS (SELECT component_id, lot_id, parameter_name, elapsed_hours, unit, value + 1.0::DOUBLE AS value FROM evt)
SELECT component_id, lot_id, parameter_name, elapsed_hours, round(value, 6) AS value FROM (
 SELECT *, row_number() OVER (PARTITION BY component_id, parameter_name, elapsed_hours ORDER BY src) AS rn FROM (SELECT *, 0 AS src FROM s1 UNION ALL SELECT *, 1 FROM s2)) WHERE rn = 1""",
)
def union_dedup(spark, d):
    t = A.telemetry_events(spark, d).select("component_id", "lot_id", "parameter_name", "elapsed_hours", "value")
    out = I.union_dedup(t.where("elapsed_hours <= 24"), t.withColumn("value", F.col("value") + 1.0))
    return out.withColumn("value", r6("value"))


@query(
    "collapse_last",
    W + EVR + """ SELECT component_id, lot_id, parameter_name, elapsed_hours, value FROM (
 SELECT *, row_number() OVER (PARTITION BY component_id, parameter_name, elapsed_hours ORDER BY ts DESC, event_id DESC) AS rn FROM evr) WHERE rn = 1""",
)
def collapse_last(spark, d):
    return I.collapse_last(A.event_readings(spark, d), F.struct("ts", "event_id"))


@query("as_of_slice", W + TEL + f" SELECT component_id, parameter_name, elapsed_hours, {o6('value')} AS value FROM tel WHERE elapsed_hours <= 24")
def as_of_slice(spark, d):
    return Q.as_of(A.telemetry_parts(spark, d), 24).select("component_id", "parameter_name", "elapsed_hours", r6("value").alias("value"))


@query(
    "as_of_label_mask",
    W + LABELS_SQL + """ SELECT t.component_id, t.parameter_name, t.elapsed_hours, CASE WHEN f.first_abnormal_hour <= 24 THEN f.first_abnormal_hour END AS first_abnormal_hour,
 coalesce(f.first_abnormal_hour <= 24, false) AS abnormal_by_24h, CAST(NULL AS BOOLEAN) AS abnormal_by_96h, CAST(NULL AS BOOLEAN) AS abnormal_by_168h
FROM tel t JOIN fab f ON t.component_id = f.component_id AND t.parameter_name = f.parameter_name WHERE t.elapsed_hours <= 24""",
)
def as_of_label_mask(spark, d):
    return Q.as_of_masked(labels_v1(spark, d), 24).select(
        "component_id", "parameter_name", "elapsed_hours", "first_abnormal_hour", "abnormal_by_24h", "abnormal_by_96h", "abnormal_by_168h"
    )


@query(
    "split_obs_labels",
    W + LABELS_SQL + f""" SELECT t.component_id, t.parameter_name, t.elapsed_hours, {o6('t.value')} AS value, f.first_abnormal_hour
FROM tel t JOIN fab f ON t.component_id = f.component_id AND t.parameter_name = f.parameter_name""",
)
def split_obs_labels(spark, d):
    both = labels_v1(spark, d)
    label_cols = [c for c in both.columns if c in Q.FORBIDDEN]
    obs, labels = both.drop(*label_cols), both.select(*Q.KEY, *label_cols)
    Q.assert_no_labels(obs)
    return obs.join(labels, Q.KEY).select(*Q.KEY, r6("value").alias("value"), "first_abnormal_hour")


STATUS_SQL = "CASE WHEN v IS NULL THEN 'MISSING' WHEN isnan(v) OR isinf(v) THEN 'NON_FINITE' WHEN v = 0 THEN 'ZERO' WHEN v < 0 THEN 'NEGATIVE' ELSE 'POSITIVE' END"
# readings with every defect, by a fixed rule on the event id
DEFECT_SQL = EVR + """, dirty AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 'nan'::DOUBLE WHEN event_id % 19 = 0 THEN 'inf'::DOUBLE WHEN event_id % 23 = 0 THEN 0.0 WHEN event_id % 29 = 0 THEN -value ELSE value END AS v,
 CASE WHEN event_id % 31 = 0 THEN ' ' ELSE lot_id END AS lot, CASE WHEN event_id % 37 = 0 THEN -5 WHEN event_id % 41 = 0 THEN 48 ELSE elapsed_hours END AS t,
 CASE WHEN event_id % 43 = 0 THEN 'NOMINAL' ELSE 'VALID' END AS quality, CASE WHEN event_id % 47 = 0 THEN 'field' ELSE 'real' END AS src, CASE WHEN event_id % 53 = 0 THEN -1 ELSE 0 END AS rework FROM evr)"""


def defects(spark, d):
    e = F.col("event_id")
    v = F.col("value")
    return A.event_readings(spark, d).select(
        "event_id", "component_id", "parameter_name", "unit",
        F.when(e % 13 == 0, F.lit(None)).when(e % 17 == 0, F.lit(float("nan"))).when(e % 19 == 0, F.lit(float("inf")))
        .when(e % 23 == 0, F.lit(0.0)).when(e % 29 == 0, -v).otherwise(v).alias("value"),
        F.when(e % 31 == 0, F.lit(" ")).otherwise(F.col("lot_id")).alias("lot_id"),
        F.when(e % 37 == 0, -5).when(e % 41 == 0, 48).otherwise(F.col("elapsed_hours")).cast("int").alias("elapsed_hours"),
        F.when(e % 43 == 0, "NOMINAL").otherwise("VALID").alias("measurement_quality"),
        F.when(e % 47 == 0, "field").otherwise("real").alias("source_type"),
        F.when(e % 53 == 0, -1).otherwise(0).alias("rework_count"),
    )


@query("value_status", W + DEFECT_SQL + f" SELECT event_id, {STATUS_SQL} AS status FROM dirty")
def value_status(spark, d):
    return defects(spark, d).select("event_id", Q.value_status("value").alias("status"))


@query(
    "duplicates",
    W + EVR + """, k AS (SELECT component_id, parameter_name, elapsed_hours, count(*) AS copies, min(value) = max(value) AS identical FROM evr GROUP BY 1, 2, 3 HAVING count(*) > 1)
SELECT event_id, copies, identical FROM evr JOIN k USING (component_id, parameter_name, elapsed_hours)""",
)
def duplicates(spark, d):
    return Q.duplicates(A.event_readings(spark, d)).select("event_id", "copies", "identical")


@query(
    "dq_errors",
    W + DEFECT_SQL + f""" SELECT event_id, 'BLANK_LOT_ID' AS rule FROM dirty WHERE trim(lot) = ''
UNION ALL SELECT event_id, CASE WHEN t < 0 THEN 'BAD_CHECKPOINT' ELSE 'ERROR_UNSCHEDULED_CHECKPOINT' END FROM dirty WHERE t NOT IN (0, 24, 96, 168)
UNION ALL SELECT event_id, 'BAD_QUALITY' FROM dirty WHERE quality = 'NOMINAL'
UNION ALL SELECT event_id, 'BAD_SOURCE' FROM dirty WHERE src = 'field'
UNION ALL SELECT event_id, 'BAD_REWORK' FROM dirty WHERE rework < 0
UNION ALL SELECT event_id, 'VALUE_' || s FROM (SELECT event_id, {STATUS_SQL} AS s FROM dirty) WHERE s IN ('MISSING', 'NON_FINITE')""",
)
def dq_errors(spark, d):
    return Q.row_errors(defects(spark, d)).select("event_id", "rule")


@query(
    "log_eligibility",
    W + DEFECT_SQL + f""", s AS (SELECT event_id, {STATUS_SQL} AS status, parameter_name IN ('IDSS', 'RDS(on)') AS lg FROM dirty)
SELECT event_id, status, CASE WHEN status IN ('MISSING', 'NON_FINITE') THEN false WHEN status = 'POSITIVE' THEN true ELSE NOT lg END AS log_eligible,
 CASE WHEN status IN ('NEGATIVE', 'ZERO') AND lg THEN status || '_KEPT_RAW' WHEN status = 'POSITIVE' AND lg THEN 'POSITIVE_LOG_READY' ELSE status END AS note FROM s""",
)
def log_eligibility(spark, d):
    return Q.log_eligibility(defects(spark, d)).select("event_id", "status", "log_eligible", "note")


@query(
    "unit_mismatch",
    W + EVR + """, m AS (SELECT event_id, parameter_name, CASE WHEN event_id % 59 = 0 THEN 'kV' ELSE unit END AS unit,
 CASE parameter_name WHEN 'IDSS' THEN 'uA' WHEN 'VGS(th)' THEN 'V' WHEN 'RDS(on)' THEN 'mOhm' WHEN 'IGSS' THEN 'nA' END AS expected_unit FROM evr)
SELECT event_id, expected_unit, CASE WHEN expected_unit IS NULL THEN 'PARAMETER_NOT_ALLOWED' ELSE 'UNIT_MISMATCH' END AS issue FROM m WHERE expected_unit IS NULL OR unit <> expected_unit""",
)
def unit_mismatch(spark, d):
    ev = A.event_readings(spark, d).withColumn("unit", F.when(F.col("event_id") % 59 == 0, "kV").otherwise(F.col("unit")))
    return Q.unit_mismatch(ev).select("event_id", "expected_unit", "issue")


FAM_SQL = TEL + """,
fr AS (SELECT component_id, elapsed_hours, value, CAST(substr(component_id, 2) AS BIGINT) AS k, CASE parameter_name WHEN 'IDSS' THEN 'leakage_current' WHEN 'RDS(on)' THEN 'iddq' WHEN 'VGS(th)' THEN 'propagation_delay' ELSE parameter_name END AS parameter_name, unit FROM tel),
fa AS (SELECT component_id, elapsed_hours, parameter_name, value, CASE k % 6 WHEN 0 THEN 'dc_dc_converter' WHEN 1 THEN 'POWER_SUPPLY_UNIT' WHEN 2 THEN 'ELECTRONIC_CONTROL_BOARD' WHEN 3 THEN 'PACKAGED_MMIC' WHEN 4 THEN 'HYBRID' END AS family_id,
 CASE parameter_name WHEN 'iddq' THEN CASE WHEN k % 7 = 0 THEN 'mOhm' ELSE 'mA' END WHEN 'propagation_delay' THEN 'ns' ELSE unit END AS unit FROM fr),
ft AS (SELECT * FROM (VALUES ('DC_DC_CONVERTER', 'leakage_current', 'uA'), ('DC_DC_CONVERTER', 'iddq', 'mA'), ('POWER_SUPPLY_UNIT', 'leakage_current', 'uA'), ('POWER_SUPPLY_UNIT', 'iddq', 'mA'), ('ELECTRONIC_CONTROL_BOARD', 'leakage_current', 'uA'), ('ELECTRONIC_CONTROL_BOARD', 'iddq', 'mA'), ('ELECTRONIC_CONTROL_BOARD', 'propagation_delay', 'ns'), ('PACKAGED_MMIC', 'leakage_current', 'uA')) v(f, p, u))"""


def family_readings(spark, d):
    """Telemetry of parts dealt to families, their parameters under the names that families use."""
    tel = A.telemetry_parts(spark, d)
    k = F.substring("component_id", 2, 20).cast("long")
    name = F.expr("CASE parameter_name WHEN 'IDSS' THEN 'leakage_current' WHEN 'RDS(on)' THEN 'iddq' WHEN 'VGS(th)' THEN 'propagation_delay' ELSE parameter_name END")
    family = F.element_at(F.array(*map(F.lit, ["dc_dc_converter", "POWER_SUPPLY_UNIT", "ELECTRONIC_CONTROL_BOARD", "PACKAGED_MMIC", "HYBRID", None])), (k % 6 + 1).cast("int"))
    unit = F.when(F.col("parameter_name") == "iddq", F.when(k % 7 == 0, "mOhm").otherwise("mA")).when(F.col("parameter_name") == "propagation_delay", "ns").otherwise(F.col("unit"))
    return tel.withColumns({"parameter_name": name, "family_id": family}).withColumn("unit", unit)


@query(
    "family_issues",
    W + FAM_SQL + """, j AS (SELECT fa.*, CASE WHEN family_id IS NULL THEN CASE parameter_name WHEN 'IGSS' THEN 'nA' END ELSE u END AS expected_unit, family_id IS NOT NULL AND upper(family_id) NOT IN (SELECT f FROM ft) AS strange FROM fa LEFT JOIN ft ON f = upper(family_id) AND p = parameter_name)
SELECT component_id, parameter_name, elapsed_hours, expected_unit, CASE WHEN strange THEN 'FAMILY_UNKNOWN' WHEN expected_unit IS NULL THEN 'PARAMETER_NOT_ALLOWED' ELSE 'UNIT_MISMATCH' END AS issue FROM j WHERE strange OR expected_unit IS NULL OR unit <> expected_unit""",
)
def family_issues(spark, d):
    return Q.family_issues(family_readings(spark, d), families.to_df(spark)).select(*Q.KEY, "expected_unit", "issue")


@query(
    "family_limit_breaches",
    W + FAM_SQL + """, l AS (SELECT *, CASE parameter_name WHEN 'iddq' THEN 40.0 END AS hi_run, CASE WHEN parameter_name = 'leakage_current' AND upper(family_id) = 'PACKAGED_MMIC' THEN 2.0 END AS lo_fam,
 CASE WHEN parameter_name = 'leakage_current' AND upper(family_id) = 'PACKAGED_MMIC' THEN 4.0 WHEN parameter_name = 'leakage_current' AND upper(family_id) IN (SELECT f FROM ft) THEN 50.0 END AS hi_fam,
 CASE WHEN parameter_name = 'leakage_current' THEN 1.0 END AS lo_row, CASE WHEN parameter_name = 'leakage_current' THEN 3.0 END AS hi_row FROM fa),
m AS (SELECT *, CAST(coalesce(lo_fam, lo_row) AS DOUBLE) AS limit_low, CAST(coalesce(hi_run, hi_fam, hi_row) AS DOUBLE) AS limit_high FROM l)
SELECT component_id, parameter_name, elapsed_hours, limit_low, limit_high, 'LOW' AS breach FROM m WHERE value < limit_low UNION ALL SELECT component_id, parameter_name, elapsed_hours, limit_low, limit_high, 'HIGH' FROM m WHERE value > limit_high""",
)
def family_limit_breaches(spark, d):
    fam = families.to_df(spark, families.with_user_limits(families.FAMILIES, "packaged_mmic", "leakage_current", 2.0, 4.0))
    run = spark.createDataFrame([("iddq", None, 40.0)], "parameter_name STRING, low DOUBLE, high DOUBLE")
    leak = F.col("parameter_name") == "leakage_current"
    rows = family_readings(spark, d).withColumns({"absolute_limit_low": F.when(leak, 1.0), "absolute_limit_high": F.when(leak, 3.0)})
    return Q.family_limit_breaches(rows, fam, run).select(*Q.KEY, "limit_low", "limit_high", "breach")


@query(
    "dataset_audit",
    W + TEL + """, o AS MATERIALIZED (SELECT component_id, parameter_name, CASE WHEN k % 23 = 0 AND elapsed_hours = 24 THEN 25 ELSE elapsed_hours END AS elapsed_hours, CASE WHEN k % 29 = 0 THEN 'kV' ELSE unit END AS unit, CASE WHEN k % 31 = 0 THEN NULL ELSE value END AS value FROM (SELECT *, CAST(substr(component_id, 2) AS BIGINT) AS k FROM tel)),
lb AS MATERIALIZED (SELECT component_id, parameter_name, elapsed_hours, CASE WHEN k % 13 = 0 THEN -abs(value) ELSE value END AS latent, CASE WHEN k % 17 = 0 THEN 'odd' ELSE 'stable' END AS cls, CASE WHEN k % 5 = 0 THEN 24 END AS h, k % 10 = 0 AS f FROM (SELECT *, CAST(substr(component_id, 2) AS BIGINT) AS k FROM tel) WHERE NOT (k % 19 = 0 AND elapsed_hours = 96)),
n AS (SELECT 'INVALID_CHECKPOINT' AS rule, count(*) AS n FROM o WHERE elapsed_hours NOT IN (0, 24, 96, 168)
 UNION ALL SELECT 'UNIT_NOT_UNIFORM', count(*) FROM o WHERE unit <> CASE parameter_name WHEN 'IDSS' THEN 'uA' WHEN 'VGS(th)' THEN 'V' WHEN 'RDS(on)' THEN 'mOhm' ELSE 'nA' END
 UNION ALL SELECT 'NON_FINITE_VALUE', count(*) FROM o WHERE value IS NULL OR NOT isfinite(value)
 UNION ALL SELECT 'LATENT_NOT_PHYSICAL', count(*) FROM lb WHERE (parameter_name IN ('IDSS', 'RDS(on)') AND latent < 0) OR (parameter_name = 'VGS(th)' AND latent <= 0)
 UNION ALL SELECT 'UNKNOWN_CLASS', count(*) FROM lb WHERE cls = 'odd' UNION ALL SELECT 'FLAG_INCONSISTENT', count(*) FROM lb WHERE h <= 24 AND NOT f
 UNION ALL SELECT 'OBSERVATION_WITHOUT_LABEL', count(*) FROM (SELECT DISTINCT component_id, parameter_name, elapsed_hours FROM o EXCEPT SELECT component_id, parameter_name, elapsed_hours FROM lb))
SELECT rule, n AS n_violations, n = 0 AS passed FROM n""",
)
def dataset_audit(spark, d):
    tel = A.telemetry_parts(spark, d)
    k = F.substring("component_id", 2, 20).cast("long")
    obs = tel.withColumns(
        {
            "elapsed_hours": F.when((k % 23 == 0) & (F.col("elapsed_hours") == 24), 25).otherwise(F.col("elapsed_hours")),
            "unit": F.when(k % 29 == 0, "kV").otherwise(F.col("unit")),
            "value": F.when(k % 31 != 0, F.col("value")),
        }
    )
    labels = tel.where(~((k % 19 == 0) & (F.col("elapsed_hours") == 96))).select(
        *Q.KEY,
        F.when(k % 13 == 0, -F.abs("value")).otherwise(F.col("value")).alias("latent_value"),
        F.when(k % 17 == 0, "odd").otherwise("stable").alias("trajectory_class"),
        F.when(k % 5 == 0, 24).alias("first_abnormal_hour"),
        (k % 10 == 0).alias("abnormal_by_24h"),
    )
    return Q.dataset_audit(obs, labels)


@query(
    "reference_deviation",
    W + TEL + f" SELECT component_id, parameter_name, elapsed_hours, {o6('value')} AS value FROM tel WHERE (parameter_name = 'IDSS' AND abs(value - 5.25) > 0.5 * 5.25) OR (parameter_name = 'RDS(on)' AND abs(value - 45.0) > 0.5 * 45.0)",
)
def reference_deviation(spark, d):
    refs = spark.createDataFrame(
        [("IDSS", 5.25, True), ("RDS(on)", 45.0, True), ("VGS(th)", 1.0, False)],
        "parameter_name STRING, reference DOUBLE, verified BOOLEAN",
    )
    return Q.reference_deviation(A.telemetry_parts(spark, d), refs).select(*Q.KEY, r6("value").alias("value"))


@query(
    "limit_breaches",
    W + TEL + f""", l AS (SELECT *, CASE parameter_name WHEN 'IDSS' THEN 3.0 WHEN 'VGS(th)' THEN 2.0 WHEN 'IGSS' THEN -100.0 END AS limit_low,
 CASE parameter_name WHEN 'IDSS' THEN 7.0 WHEN 'VGS(th)' THEN 4.0 WHEN 'RDS(on)' THEN 60.0 WHEN 'IGSS' THEN 100.0 END AS limit_high FROM tel)
SELECT component_id, parameter_name, elapsed_hours, CAST(limit_low AS DOUBLE) AS limit_low, CAST(limit_high AS DOUBLE) AS limit_high, 'LOW' AS breach FROM l WHERE value < limit_low
UNION ALL SELECT component_id, parameter_name, elapsed_hours, CAST(limit_low AS DOUBLE), CAST(limit_high AS DOUBLE), 'HIGH' FROM l WHERE value > limit_high""",
)
def limit_breaches(spark, d):
    run = spark.createDataFrame([("IDSS", 3.0, 7.0), ("RDS(on)", None, 60.0)], "parameter_name STRING, low DOUBLE, high DOUBLE")
    fam = REGISTRY.to_df(spark).select("parameter_name", F.col("spec_low").alias("low"), F.col("spec_high").alias("high"))
    return Q.limit_breaches(A.telemetry_parts(spark, d), run, fam).select(*Q.KEY, "limit_low", "limit_high", "breach")


@query(
    "bad_limits",
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN 'LOW_ABOVE_HIGH' ELSE 'REFERENCE_WITHOUT_PROVENANCE' END AS issue FROM part
WHERE p_size > 40 OR (p_partkey % 3 = 0 AND p_partkey % 2 = 0)""",
)
def bad_limits(spark, d):
    limits = A.table(spark, d, "part").select(
        "p_partkey",
        F.col("p_size").cast("double").alias("low"),
        F.lit(40.0).alias("high"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice")).alias("reference"),
        F.when(F.col("p_partkey") % 2 == 1, F.col("p_type")).alias("provenance"),
    )
    return Q.bad_limits(limits).select("p_partkey", "issue")


@query(
    "missing_checkpoints",
    W + EVT + """, s AS (SELECT DISTINCT component_id, lot_id, parameter_name FROM evt)
SELECT component_id, lot_id, parameter_name, string_agg(t, '_' ORDER BY t) AS missing FROM s, (VALUES (0), (24), (96), (168)) h(t)
WHERE NOT EXISTS (SELECT 1 FROM evt e WHERE e.component_id = s.component_id AND e.parameter_name = s.parameter_name AND e.elapsed_hours = h.t) GROUP BY 1, 2, 3""",
)
def missing_checkpoints(spark, d):
    return Q.missing_checkpoints(A.telemetry_events(spark, d)).withColumn(
        "missing", F.array_join(F.col("missing").cast("array<string>"), "_")
    )


@query("peer_counts", W + TEL + " SELECT lot_id, elapsed_hours, count(DISTINCT component_id) AS n_components, count(DISTINCT component_id) >= 8 AS sufficient FROM tel GROUP BY 1, 2")
def peer_counts(spark, d):
    return Q.peer_counts(A.telemetry_parts(spark, d), 8)


@query(
    "validation_summary",
    W + DEFECT_SQL + f""", k AS (SELECT component_id, parameter_name, t, count(*) AS c FROM dirty GROUP BY 1, 2, 3), s AS (SELECT {STATUS_SQL} AS s FROM dirty),
x AS (SELECT (SELECT count(*) FROM dirty) AS n_rows, (SELECT CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) FROM k) AS duplicate_rows,
 (SELECT count(*) FROM dirty WHERE trim(lot) = '') + (SELECT count(*) FROM dirty WHERE t NOT IN (0, 24, 96, 168)) + (SELECT count(*) FROM dirty WHERE quality = 'NOMINAL')
 + (SELECT count(*) FROM dirty WHERE src = 'field') + (SELECT count(*) FROM dirty WHERE rework < 0) + (SELECT count(*) FROM s WHERE s IN ('MISSING', 'NON_FINITE')) AS rule_errors,
 (SELECT count(*) FROM dirty WHERE parameter_name = 'ERR') AS unit_errors)
SELECT *, duplicate_rows + rule_errors + unit_errors = 0 AS is_valid FROM x""",
)
def validation_summary(spark, d):
    return Q.validation_summary(defects(spark, d))


@query(
    "key_containment",
    W + EVT + """, lab AS (SELECT component_id, parameter_name, elapsed_hours FROM evt WHERE elapsed_hours <> 96 UNION SELECT component_id, parameter_name, 48 FROM evt WHERE elapsed_hours = 24)
SELECT component_id, parameter_name, elapsed_hours, 'OBSERVATION_WITHOUT_LABEL' AS side FROM evt WHERE elapsed_hours = 96
UNION ALL SELECT component_id, parameter_name, elapsed_hours, 'LABEL_WITHOUT_OBSERVATION' FROM lab WHERE elapsed_hours = 48""",
)
def key_containment(spark, d):
    obs = A.telemetry_events(spark, d).select(*Q.KEY)
    extra = obs.where("elapsed_hours = 24").withColumn("elapsed_hours", F.lit(48))
    return Q.key_containment(obs, obs.where("elapsed_hours <> 96").unionByName(extra))


@query(
    "dataset_stats",
    W + TEL + f""", s AS (SELECT *, {LOW} AS lo, {HIGH} AS hi FROM tel)
SELECT parameter_name, count(*) AS n_rows, count(*) FILTER (value < 0) AS n_negative, count(*) FILTER (value = 0) AS n_zero, CAST(0 AS BIGINT) AS n_non_finite,
 count(*) FILTER (value < lo OR value > hi) AS n_limit_crossings, count(DISTINCT component_id) AS n_series,
 {o6('1.0 - count(*)::DOUBLE / (count(DISTINCT component_id) * 4)::DOUBLE')} AS missing_rate FROM s GROUP BY 1""",
)
def dataset_stats(spark, d):
    return Q.dataset_stats(A.telemetry_parts(spark, d)).withColumn("missing_rate", r6("missing_rate"))


@query(
    "as_of_audit",
    W + EVT + """ SELECT h.t AS as_of_hours, count(*) AS n_rows, max(elapsed_hours) AS max_hours, max(elapsed_hours) > h.t AS leaks FROM (VALUES (0), (24), (96), (168)) h(t) JOIN evt ON elapsed_hours <= h.t GROUP BY h.t""",
)
def as_of_audit(spark, d):
    return Q.as_of_audit(A.telemetry_events(spark, d))


@query(
    "slice_changes",
    W + EVT + """ SELECT component_id, parameter_name, elapsed_hours FROM evt WHERE elapsed_hours = 96""",
)
def slice_changes(spark, d):
    t = A.telemetry_events(spark, d)
    return Q.changed_between(Q.as_of(t, 24), Q.as_of(t, 96)).select(*Q.KEY)


@query(
    "monotonic_time",
    W + EVR + """ SELECT event_id, elapsed_hours, previous_hours FROM (SELECT *, lag(elapsed_hours) OVER (PARTITION BY component_id, parameter_name ORDER BY event_id % 1000, event_id) AS previous_hours FROM evr) WHERE elapsed_hours < previous_hours""",
)
def monotonic_time(spark, d):
    ev = A.event_readings(spark, d).withColumn("arrival", (F.col("event_id") % 1000) * 10000000 + F.floor(F.col("event_id") / 1000))
    return Q.out_of_order(ev, "arrival", 10000000).select("event_id", "elapsed_hours", "previous_hours")


@query(
    "signed_audit",
    W + TEL + f""", s AS (SELECT *, {LOW} AS lo, {HIGH} AS hi FROM tel)
SELECT parameter_name, bool_or(value > 0) AS has_positive, bool_or(value < 0) AS has_negative, bool_or(value = 0) AS has_zero, bool_or(abs(value) < 1) AS has_near_zero,
 {o6('min(value)')} AS min_value, {o6('max(value)')} AS max_value, count(*) FILTER (value < lo) AS n_low_breach, count(*) FILTER (value > hi) AS n_high_breach FROM s GROUP BY 1""",
)
def signed_audit(spark, d):
    return Q.signed_audit(A.telemetry_parts(spark, d)).withColumns({"min_value": r6("min_value"), "max_value": r6("max_value")})


@query(
    "channel_f_ratio",
    W + TU + f""", c AS (SELECT lot_id, parameter_name, elapsed_hours, channel_id, avg(u) AS m, var_samp(u) AS v FROM tu GROUP BY 1, 2, 3, 4),
g AS (SELECT lot_id, parameter_name, elapsed_hours, var_samp(m) AS b, avg(v) AS w, count(*) AS n_channels FROM c GROUP BY 1, 2, 3)
SELECT lot_id, parameter_name, elapsed_hours, n_channels, {o6('b / w')} AS f_ratio FROM g""",
)
def channel_f_ratio(spark, d):
    t = R.with_u(A.telemetry_parts(spark, d))
    return Q.channel_f_ratio(t).select("lot_id", "parameter_name", "elapsed_hours", "n_channels", r6("f_ratio").alias("f_ratio"))


@query(
    "common_shift",
    W + TU + f""", p AS (SELECT a.lot_id, a.parameter_name, b.u - a.u AS shift FROM tu a JOIN tu b USING (component_id, parameter_name) WHERE a.elapsed_hours = 0 AND b.elapsed_hours = 24),
g AS (SELECT lot_id, parameter_name, avg(shift) AS mean_shift, stddev_pop(shift) AS std_shift, count(*) FILTER (shift > 0) AS p, count(*) FILTER (shift < 0) AS m, count(*) AS n, median(shift) AS med FROM p GROUP BY 1, 2)
SELECT lot_id, parameter_name, n, {o6('mean_shift')} AS mean_shift, {o6('med')} AS median_shift, {o6('std_shift')} AS std_shift, {o6('CASE WHEN med > 0 THEN p WHEN med < 0 THEN m END::DOUBLE / n::DOUBLE')} AS same_sign_share FROM g""",
)
def common_shift(spark, d):
    u = R.with_u(A.telemetry_parts(spark, d))
    tr = R.triads(u, (0, 24), "u", "u").withColumn("shift", F.col("u24") - F.col("u0"))
    out = Q.common_shift(tr)
    return out.select("lot_id", "parameter_name", "n", *[r6(c).alias(c) for c in ("mean_shift", "median_shift", "std_shift", "same_sign_share")])


@query(
    "pairwise_corr",
    W + TU + f""", w AS (SELECT component_id, max(u) FILTER (parameter_name = 'IDSS') AS a, max(u) FILTER (parameter_name = 'VGS(th)') AS b, max(u) FILTER (parameter_name = 'RDS(on)') AS c, max(u) FILTER (parameter_name = 'IGSS') AS d FROM tu WHERE elapsed_hours = 0 GROUP BY 1)
SELECT {o6('corr(a, b)')} AS idss_vgs, {o6('corr(a, c)')} AS idss_rds, {o6('corr(a, d)')} AS idss_igss, {o6('corr(b, c)')} AS vgs_rds, {o6('corr(b, d)')} AS vgs_igss, {o6('corr(c, d)')} AS rds_igss FROM w""",
)
def pairwise_corr(spark, d):
    u = R.with_u(Q.as_of(A.telemetry_parts(spark, d), 0))
    wide = u.groupBy("component_id").pivot("parameter_name", REGISTRY.names).agg(F.max("u")).toDF("component_id", "idss", "vgs", "rds", "igss")
    names = ["idss", "vgs", "rds", "igss"]
    return wide.agg(*[r6(F.corr(a, b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]])


@query(
    "coupling_audit",
    W + LABELS_SQL + f""", c AS (SELECT component_id, count(DISTINCT coalesce(first_abnormal_hour, -1)) AS nc, count(*) FILTER (first_abnormal_hour IS NOT NULL) AS nd FROM fab GROUP BY 1)
SELECT count(*) AS n_components, {o6('avg((nc = 1)::INT)')} AS p_same_class, {o6('avg((nd = 0)::INT)')} AS p_0_degraded, {o6('avg((nd = 1)::INT)')} AS p_1_degraded, {o6('avg((nd = 2)::INT)')} AS p_2_degraded,
 {o6('avg((nd = 3)::INT)')} AS p_3_degraded, {o6('avg((nd = 4)::INT)')} AS p_4_degraded, {o6('avg((nd >= 2)::INT) FILTER (nd >= 1)')} AS p_two_given_one FROM c""",
)
def coupling_audit(spark, d):
    lab = R.first_abnormal(A.telemetry_parts(spark, d), 0.2).select(
        "component_id",
        F.coalesce("first_abnormal_hour", F.lit(-1)).alias("scenario"),
        F.col("first_abnormal_hour").isNotNull().alias("degraded"),
    )
    out = Q.coupling_audit(lab)
    return out.select("n_components", *[r6(c).alias(c) for c in out.columns if c != "n_components"])


@query(
    "card_violations",
    W + TEL + f""", f AS (SELECT component_id, parameter_name, value AS measured, value * 1.02::DOUBLE AS predicted, CASE WHEN component_id LIKE '%7' THEN 'kV' ELSE unit END AS funit, unit,
 CASE WHEN component_id LIKE '%9' THEN value * 1.05::DOUBLE ELSE value * 0.9::DOUBLE END AS lower, value * 1.1::DOUBLE AS upper, {LOW} AS lo, {HIGH} AS hi FROM tel WHERE elapsed_hours = 168)
SELECT component_id, parameter_name, 'PASS_WITH_BREACH' AS violation FROM f WHERE measured < lo OR measured > hi
UNION ALL SELECT component_id, parameter_name, 'UNIT_MISMATCH' FROM f WHERE funit <> unit
UNION ALL SELECT component_id, parameter_name, 'INTERVAL_ORDER' FROM f WHERE lower > predicted OR predicted > upper""",
)
def card_violations(spark, d):
    t = A.telemetry_parts(spark, d).where("elapsed_hours = 168")
    fc = t.select(
        "component_id", "parameter_name", F.lit("PASS").alias("state"),
        F.when(F.col("component_id").endswith("7"), "kV").otherwise(F.col("unit")).alias("unit"),
        (F.col("value") * 1.02).alias("predicted"),
        F.when(F.col("component_id").endswith("9"), F.col("value") * 1.05).otherwise(F.col("value") * 0.9).alias("lower"),
        (F.col("value") * 1.1).alias("upper"),
    )
    return Q.card_violations(t, fc).select("component_id", "parameter_name", "violation")


PARTS_SQL = "lp AS (SELECT lot_id, CASE WHEN 2 * (rn - 1) < n THEN 'CAL' WHEN 4 * (rn - 1) < 3 * n THEN 'VAL' ELSE 'EVAL' END AS part FROM (SELECT lot_id, row_number() OVER (ORDER BY lot_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand AS lot_id FROM part)))"


def lot_partitions(spark, d):
    """CAL / VAL / EVAL by position in the sorted lot list (one row per lot: a small dimension)."""
    from pyspark.sql import Window

    lots = A.table(spark, d, "part").select(F.col("p_brand").alias("lot_id")).distinct()
    n = lots.agg(F.count(F.lit(1)).alias("n"))
    ranked = lots.withColumn("rn", F.row_number().over(Window.orderBy("lot_id"))).crossJoin(F.broadcast(n))
    i = F.col("rn") - 1
    return ranked.select(
        "lot_id", F.when(2 * i < F.col("n"), "CAL").when(4 * i < 3 * F.col("n"), "VAL").otherwise("EVAL").alias("partition")
    )


@query(
    "partition_overlap",
    W + PARTS_SQL + """, u AS (SELECT lot_id, part FROM lp UNION ALL SELECT lot_id, 'HOLDOUT' FROM lp WHERE lot_id LIKE '%5')
SELECT lot_id, count(DISTINCT part) AS n_partitions, min(part) AS first_partition, max(part) AS last_partition FROM u GROUP BY 1 HAVING count(DISTINCT part) > 1""",
)
def partition_overlap(spark, d):
    p = lot_partitions(spark, d)
    hold = p.where(F.col("lot_id").endswith("5")).withColumn("partition", F.lit("HOLDOUT"))
    return Q.partition_overlap(p.unionByName(hold))


@query("effective_limits", W + TEL + f" SELECT DISTINCT component_id, parameter_name, {LOW} AS limit_low, CASE WHEN parameter_name = 'IDSS' AND component_id LIKE '%3' THEN 9.5::DOUBLE ELSE {HIGH} END AS limit_high FROM tel")
def effective_limits(spark, d):
    t = A.telemetry_parts(spark, d).withColumn(
        "absolute_limit_high",
        F.when((F.col("parameter_name") == "IDSS") & F.col("component_id").endswith("3"), F.lit(9.5)),
    )
    return Q.effective_limits(t)


@query("transform", W + TU + f" SELECT component_id, parameter_name, elapsed_hours, {o6('u')} AS u, u IS NOT NULL AS domain_ok FROM tu")
def q_transform(spark, d):
    return R.with_u(A.telemetry_parts(spark, d)).select(*Q.KEY, r6("u").alias("u"), "domain_ok")


@query("inverse_transform", W + TU + f" SELECT component_id, parameter_name, elapsed_hours, {o6(inv('u + 0.1::DOUBLE'))} AS y FROM tu")
def q_inverse(spark, d):
    t = R.with_u(A.telemetry_parts(spark, d)).withColumn("up", F.col("u") + 0.1)
    return R.with_value(t, "up", "y").select(*Q.KEY, r6("y").alias("y"))


@query(
    "triads",
    W + TEL + f""", w AS (SELECT component_id, lot_id, parameter_name, max(value) FILTER (elapsed_hours = 0) AS v0, max(value) FILTER (elapsed_hours = 24) AS v24, max(value) FILTER (elapsed_hours = 168) AS v168 FROM tel GROUP BY 1, 2, 3)
SELECT component_id, lot_id, parameter_name, {o6('v0')} AS v0, {o6('v24')} AS v24, {o6('v168')} AS v168 FROM w WHERE v0 IS NOT NULL AND v24 IS NOT NULL AND v168 IS NOT NULL""",
)
def triads(spark, d):
    t = R.triads(A.telemetry_parts(spark, d))
    return t.select("component_id", "lot_id", "parameter_name", *[r6(c).alias(c) for c in ("v0", "v24", "v168")])


@query(
    "trajectory",
    W + EVT + """ SELECT component_id, lot_id, parameter_name, count(*) AS k, string_agg(elapsed_hours || ':' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ' ' ORDER BY elapsed_hours) AS points FROM evt GROUP BY 1, 2, 3""",
)
def trajectory(spark, d):
    t = R.trajectories(A.telemetry_events(spark, d), "value")
    text = F.array_join(
        F.transform("pts", lambda p: F.concat(p["t"].cast("string"), F.lit(":"), F.round(p["u"] * 100).cast("bigint").cast("string"))), " "
    )
    return t.select("component_id", "lot_id", "parameter_name", F.size("pts").cast("bigint").alias("k"), text.alias("points"))


@query("relative_deviation", W + LABELS_SQL + f" SELECT component_id, parameter_name, elapsed_hours, {o6('r')} AS r FROM dev")
def relative_deviation(spark, d):
    return R.relative_deviation(A.telemetry_parts(spark, d)).select(*Q.KEY, r6("r").alias("r"))


@query(
    "first_abnormal",
    W + LABELS_SQL + """ SELECT component_id, lot_id, parameter_name, first_abnormal_hour, coalesce(first_abnormal_hour <= 24, false) AS abnormal_by_24h,
 coalesce(first_abnormal_hour <= 96, false) AS abnormal_by_96h, coalesce(first_abnormal_hour <= 168, false) AS abnormal_by_168h FROM fab""",
)
def first_abnormal(spark, d):
    return R.first_abnormal(A.telemetry_parts(spark, d), 0.2)
