"""Evidence output: reports, flat tables, explanations and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.quality import as_of

# Fixed values of the disposition contract: prescribed action per state.
ACTIONS = {
    "FAIL": "CONDEMN_TO_SCRAP",
    "EQUIPMENT_SUSPECTED": "QUARANTINE_SOCKET_RETEST",
    "HOLD": "HOLD_MATERIAL_REVIEW_BOARD",
    "INSUFFICIENT_DATA": "DEFER_INSUFFICIENT_DATA",
}
DEFAULT_ACTION = "CLEARED_FOR_FLIGHT"


def action(state: str | Column) -> Column:
    state = F.col(state) if isinstance(state, str) else state
    out = None
    for k, v in ACTIONS.items():
        out = F.when(state == k, v) if out is None else out.when(state == k, v)
    return out.otherwise(DEFAULT_ACTION)


def evidence_flat(params: DataFrame) -> DataFrame:
    """O2: one flat row per component and parameter with every detector's fields."""
    cols = []
    for group in ("spec", "peer", "drift", "step", "eq", "suff", "fused"):
        for f in params.schema[group].dataType.fields:
            if f.dataType.typeName() != "array":
                cols.append(F.col(f"{group}.{f.name}").alias(f"{group}_{f.name}"))
    return params.select("as_of_hours", "component_id", "lot_id", "parameter_name", F.col("now.value").alias("value"), *cols)


def why_flagged(params: DataFrame) -> DataFrame:
    """O3: which detectors spoke for a parameter, in a fixed order."""
    said = F.expr(
        "array_compact(array("
        "IF(spec.status IN ('SPEC_BREACH', 'SCREENING_MARGIN_BREACH'), concat('limit:', spec.reason), NULL), "
        "IF(peer.status IN ('PEER_MILD_OUTLIER', 'PEER_EXTREME_OUTLIER'), concat('peers:', peer.reason), NULL), "
        "IF(drift.status IN ('ACCELERATING_DRIFT', 'SUBTLE_DRIFT', 'PERSISTENT_DRIFT'), concat('drift:', drift.reason), NULL), "
        "IF(step.status = 'ABRUPT_JUMP_ALERT', concat('step:', step.reason), NULL), "
        "IF(eq.suspected, concat('equipment:', eq.reason), NULL), "
        "IF(NOT suff.sufficient, concat('data:', suff.reason), NULL)))"
    )
    return params.withColumn("__s", said).withColumns(
        {"n_signals": F.size("__s").cast("bigint"), "why": F.when(F.size("__s") > 0, F.concat_ws("; ", "__s")).otherwise("nominal")}
    ).drop("__s")


def justification(components: DataFrame) -> DataFrame:
    """One sentence per component, by final state."""
    s = F.col("final.state")
    text = (
        F.when(s == "PASS", F.format_string("%s is within limits and stable at %d h.", "component_id", "as_of_hours"))
        .when(s == "FAIL", F.format_string("%s fails at %d h: %s.", "component_id", "as_of_hours", "final.reason"))
        .when(s == "HOLD", F.format_string("%s is held for re-test at %d h: %s.", "component_id", "as_of_hours", "final.reason"))
        .when(s == "INSUFFICIENT_DATA", F.format_string("%s cannot be judged at %d h: %s.", "component_id", "as_of_hours", "final.reason"))
        .when(s == "EQUIPMENT_SUSPECTED", F.format_string("%s moved with its equipment at %d h: %s.", "component_id", "as_of_hours", "final.reason"))
        .otherwise(F.format_string("%s needs review at %d h: %s.", "component_id", "as_of_hours", "final.reason"))
    )
    return components.withColumn("justification", text)


def component_report(components: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Screening result, forecasts and decisions of a component in one nested row."""
    fc = forecasts.groupBy("component_id").agg(
        F.sort_array(
            F.collect_list(F.struct("parameter_name", "predicted", "decision", "interval_status", "predicted_breach", "measured_failure"))
        ).alias("forecasts"),
        F.bool_or(F.col("decision") == "EARLY_REJECT").alias("early_reject"),
    )
    out = justification(components).join(fc, "component_id", "left")
    out = out.withColumn("action", action("final.state"))
    return out.withColumn("explanation", F.to_json(F.struct("justification", "action", "final", "forecasts")))


def telemetry_digest(df: DataFrame) -> DataFrame:
    """SHA-256 of a component's sorted readings (unique per key, hence a bounded list)."""
    row = F.concat_ws(":", "parameter_name", F.col("elapsed_hours").cast("string"), F.round(F.col("value") * 1000000).cast("bigint").cast("string"))
    return df.groupBy("component_id", "lot_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(row)), "|"), 256).alias("digest"))


def result_digest(df: DataFrame, volatile=("run_id", "generated_at")) -> DataFrame:
    """Digest of a result row over its columns in name order, run metadata excluded."""
    cols = sorted(c for c in df.columns if c not in volatile)
    return df.withColumn("digest", F.sha2(F.to_json(F.struct(*cols)), 256))


def audit_record(components: DataFrame, telemetry: DataFrame, t: int, run_id: str) -> DataFrame:
    """Audit rows: state, reasons, input digest, run context; inputs are re-sliced at ``t``."""
    dig = telemetry_digest(as_of(telemetry, t)).withColumnRenamed("digest", "input_digest")
    out = components.join(dig, ["component_id", "lot_id"], "left")
    return out.select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("generated_at"), "as_of_hours", "component_id", "lot_id",
        F.col("final.state").alias("state"), F.col("final.reasons").alias("reasons"), "input_digest",
    )
