"""Queries of evidence output."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions.scalars import r6
from emberline.operators import prognostics as P
from emberline.operators import reporting as O
from emberline.plans import screening as S
from emberline.plans.catalog import query
from emberline.plans.oracle_parts import TEL, inv
from emberline.plans.oracle_parts import r6 as o6
from emberline.plans.prognostic_queries import TRI, decided, safety
from emberline.plans.screening_oracle import component_ctes, screen_ctes
from emberline.sources import adapters as A

T = 168
ID = ["component_id", "parameter_name"]


def _said(kind, cond, reason):
    return f"CASE WHEN {cond} THEN '{kind}:' || {reason} END"


WHY = ", ".join(
    [
        _said("limit", "spec_status IN ('SPEC_BREACH', 'SCREENING_MARGIN_BREACH')", "spec_reason"),
        _said("peers", "peer_status IN ('PEER_MILD_OUTLIER', 'PEER_EXTREME_OUTLIER')", "peer_reason"),
        _said("drift", "drift_status IN ('ACCELERATING_DRIFT', 'SUBTLE_DRIFT', 'PERSISTENT_DRIFT')", "drift_reason"),
        _said("step", "step_status = 'ABRUPT_JUMP_ALERT'", "step_reason"),
        _said("equipment", "suspected", "eq_reason"),
        _said("data", "NOT sufficient", "suff_reason"),
    ]
)


@query("why_flagged", "WITH " + screen_ctes(T) + f" SELECT component_id, parameter_name, coalesce(nullif(concat_ws('; ', {WHY}), ''), 'nominal') AS why FROM pf")
def why_flagged(spark, d):
    return O.why_flagged(S.screen_parameters(A.telemetry_parts(spark, d), T, fields={})).select(*ID, "why")


@query("evidence_flat")
def evidence_flat(spark, d):
    e = O.evidence_flat(S.screen_parameters(A.telemetry_parts(spark, d), T))
    return e.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in e.schema.fields])


@query(
    "justification",
    "WITH " + component_ctes(T) + """ SELECT component_id, CASE state WHEN 'PASS' THEN component_id || ' is within limits and stable at 168 h.' WHEN 'FAIL' THEN component_id || ' fails at 168 h: ' || reason || '.' WHEN 'HOLD' THEN component_id || ' is held for re-test at 168 h: ' || reason || '.'
 WHEN 'INSUFFICIENT_DATA' THEN component_id || ' cannot be judged at 168 h: ' || reason || '.' WHEN 'EQUIPMENT_SUSPECTED' THEN component_id || ' moved with its equipment at 168 h: ' || reason || '.' ELSE component_id || ' needs review at 168 h: ' || reason || '.' END AS justification FROM cf""",
)
def justification(spark, d):
    return O.justification(S.screen_components(A.telemetry_parts(spark, d), T, evidence=False)).select("component_id", "justification")


SAID = """CASE state WHEN 'PASS' THEN component_id || ' is within limits and stable at {t} h.' WHEN 'FAIL' THEN component_id || ' fails at {t} h: ' || reason || '.' WHEN 'HOLD' THEN component_id || ' is held for re-test at {t} h: ' || reason || '.'
 WHEN 'INSUFFICIENT_DATA' THEN component_id || ' cannot be judged at {t} h: ' || reason || '.' WHEN 'EQUIPMENT_SUSPECTED' THEN component_id || ' moved with its equipment at {t} h: ' || reason || '.' ELSE component_id || ' needs review at {t} h: ' || reason || '.' END"""
_Z = "1.6448536269514722::DOUBLE * sig"
DECIDED = TRI[TRI.index("\ntri AS") : TRI.index(",\ndu AS")] + safety("lky", "y", inv(f"uh - {_Z}"), inv(f"uh + {_Z}"))
REPORT = "WITH " + component_ctes(24) + "," + DECIDED + f""",
er AS (SELECT component_id, bool_or(decision = 'EARLY_REJECT') AS early_reject, count(*) AS n_forecasts, string_agg(parameter_name || '=' || decision || '/' || istat, ';' ORDER BY parameter_name) AS decisions FROM sf GROUP BY 1)
SELECT component_id, lot_id, state, CASE state WHEN 'FAIL' THEN 'CONDEMN_TO_SCRAP' WHEN 'EQUIPMENT_SUSPECTED' THEN 'QUARANTINE_SOCKET_RETEST' WHEN 'HOLD' THEN 'HOLD_MATERIAL_REVIEW_BOARD' WHEN 'INSUFFICIENT_DATA' THEN 'DEFER_INSUFFICIENT_DATA' ELSE 'CLEARED_FOR_FLIGHT' END AS action,
 early_reject, n_forecasts, decisions, {SAID.format(t=24)} AS justification FROM cf LEFT JOIN er USING (component_id)"""


@query("component_report", REPORT)
def component_report(spark, d):
    f = P.breach_interpretation(decided(spark, d), "v24")
    f = f.withColumn("predicted", r6("predicted", 4))
    rep = O.component_report(S.screen_components(A.telemetry_parts(spark, d), 24, evidence=False), f)
    told = F.array_join(F.transform("forecasts", lambda x: F.concat(x["parameter_name"], F.lit("="), x["decision"], F.lit("/"), x["interval_status"])), ";")
    number = F.when(F.col("forecasts").isNotNull(), F.size("forecasts").cast("long"))
    return rep.select("component_id", "lot_id", "final.state", "action", "early_reject", number.alias("n_forecasts"), told.alias("decisions"), "justification")


@query("telemetry_digest", "WITH " + TEL + " SELECT component_id, lot_id, sha256(string_agg(r, '|' ORDER BY r)) AS digest FROM (SELECT component_id, lot_id, parameter_name || ':' || elapsed_hours || ':' || CAST(round(value * 1000000) AS BIGINT) AS r FROM tel) GROUP BY 1, 2")
def telemetry_digest(spark, d):
    return O.telemetry_digest(A.telemetry_parts(spark, d))


# four decimals as JSON writes them: below a thousandth with an exponent
JSON_NUMBER = "CASE WHEN {v} <> 0 AND abs({v}) < 0.001 THEN CASE WHEN {v} < 0 THEN '-' ELSE '' END || CAST(CAST(round(abs({v}) * 10000) AS INTEGER) AS VARCHAR) || '.0E-4' ELSE CAST({v} AS VARCHAR) END"


@query("result_digest", "WITH " + TRI[: TRI.index(",\ndu AS")] + safety("lky", "y", inv(f"uh - {_Z}"), inv(f"uh + {_Z}")) + f""" SELECT component_id, parameter_name, sha256('{{"component_id":"' || component_id || '","decision":"' || decision || '","parameter_name":"' || parameter_name || '","predicted":' || {JSON_NUMBER.format(v=o6('yy', 4))} || '}}') AS digest FROM sf""")
def result_digest(spark, d):
    f = decided(spark, d).select(*ID, r6("predicted", 4).alias("predicted"), "decision", F.lit("r1").alias("run_id"))
    return O.result_digest(f).select(*ID, "digest")
