"""Evidence fusion: one precedence cascade per parameter, one per component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.layers import Layer, layered

EXCESS_LIMIT = 2.5
# States and qualifiers of the disposition vocabulary.
STATES = ["PASS", "ALERT", "HOLD", "FAIL", "INSUFFICIENT_DATA", "EQUIPMENT_SUSPECTED"]
CONFOUNDED = "COMPONENT_DEGRADATION_CONFOUNDED_BY_EQUIPMENT"


# What the cascade reads of every evidence struct.
FUSION_READS = {
    "spec": ["status", "reason"],
    "peer": ["status", "reason"],
    "drift": ["status", "reason", "g", "g_excess", "persistent"],
    "step": ["status", "reason"],
    "eq": ["suspected", "reason"],
    "suff": ["sufficient", "reason"],
}

# What the component cascade reads of a parameter's ``fused`` and of ``joint`` (beside all reasons, where they are wanted).
FUSED_READS = ["state", "qualifier", "reason", "drifting"]
JOINT_READS = ["suspected", "reason"]


def fusion_layers() -> list[Layer]:
    """``fused`` STRUCT<state, qualifier, reason, reasons, drifting> on rows with all evidence."""
    mild = "drift.status IN ('SUBTLE_DRIFT', 'PERSISTENT_DRIFT')"
    accel, lasting = "drift.status = 'ACCELERATING_DRIFT'", "drift.status = 'PERSISTENT_DRIFT'"
    jump, margin = "step.status = 'ABRUPT_JUMP_ALERT'", "spec.status = 'SCREENING_MARGIN_BREACH'"
    # precedence, strongest first: (branch, condition, state, qualifier, reason)
    cascade = [
        ("spec.status = 'SPEC_BREACH'", "'FAIL'", "'SPECIFICATION_FAILURE'", "spec.reason"),
        ("NOT suff.sufficient", "'INSUFFICIENT_DATA'", "'INSUFFICIENT_EVIDENCE'", "suff.reason"),
        (
            f"eq.suspected AND (coalesce(abs(coalesce(drift.g_excess, drift.g)) >= {EXCESS_LIMIT}D, false) OR drift.persistent)",
            f"IF({accel} OR {jump}, 'FAIL', 'ALERT')",
            f"'{CONFOUNDED}'",
            f"CASE WHEN {accel} OR {lasting} THEN drift.reason WHEN {jump} THEN step.reason ELSE 'CONFOUNDED_TEMPORAL_DRIFT' END",
        ),
        ("eq.suspected", "'EQUIPMENT_SUSPECTED'", "'EQUIPMENT_ONLY'", "eq.reason"),
        (accel, "'FAIL'", "'COMPONENT_DEGRADATION'", "drift.reason"),
        (jump, "'FAIL'", "'COMPONENT_DEGRADATION'", "step.reason"),
        (f"{margin} AND {mild}", "'HOLD'", "'HOLD_SCREENING_MARGIN'", "'HOLD_SCREENING_MARGIN_BREACH_WITH_DRIFT'"),
        (mild, "'ALERT'", "'COMPONENT_DEGRADATION'", "drift.reason"),
        (margin, "'ALERT'", "'SPECIFICATION_FAILURE'", "spec.reason"),
        (
            "peer.status IN ('PEER_MILD_OUTLIER', 'PEER_EXTREME_OUTLIER')",
            "'ALERT'",
            "'PEER_OUTLIER_STATIONARY'",
            "IF(drift.status = 'STATIONARY', 'HIGH_BUT_STABLE_PEER_OUTLIER', peer.reason)",
        ),
        ("true", "'PASS'", "'NOMINAL_STABLE'", "'NOMINAL_SPEC_AND_STABLE_KINETICS'"),
    ]
    branch = "CASE " + " ".join(f"WHEN {c[0]} THEN {i}" for i, c in enumerate(cascade)) + " END"

    def pick(k):
        return F.expr("CASE __u " + " ".join(f"WHEN {i} THEN {c[k]}" for i, c in enumerate(cascade)) + " END")

    return [
        {"__u": F.expr(branch)},
        {
            "fused": F.struct(
                pick(1).alias("state"),
                pick(2).alias("qualifier"),
                pick(3).alias("reason"),
                F.expr("array(spec.reason, peer.reason, drift.reason, step.reason, eq.reason, suff.reason)").alias("reasons"),
                # branches 2 and 6 carry the confounded and hold qualifiers
                F.expr(f"{accel} OR {mild} OR {jump} OR __u IN (2, 6)").alias("drifting"),
            )
        },
    ]


def fuse_component(comp: DataFrame, params: str = "params", reasons: bool = True) -> DataFrame:
    """Adds ``final`` STRUCT<state, qualifier, reason, reasons, compound>, ``reasons`` (of all evidence) if wanted.

    ``comp`` has ``params`` (or the column named): ARRAY<STRUCT<parameter_name, fused, ...>> in registry order and ``joint``.
    """

    def of(state):
        return F.expr(f"filter({params}, p -> p.fused.state = '{state}')")

    layers: list[Layer] = [
        {
            "__fail": of("FAIL"),
            "__ins": of("INSUFFICIENT_DATA"),
            "__hold": of("HOLD"),
            "__alert": of("ALERT"),
            "__eq": of("EQUIPMENT_SUSPECTED"),
            "__drift": F.expr(f"filter({params}, p -> p.fused.drifting)"),
            **({"__all": F.expr(f"flatten({params}.fused.reasons)")} if reasons else {}),
            "__conf": F.expr(f"exists({params}, p -> p.fused.qualifier = '{CONFOUNDED}')"),
            "__jhit": F.expr("coalesce(joint.suspected, false)"),
        },
        {
            # degradation alerts go before peer outliers; otherwise registry order decides
            "__first": F.expr(
                "CASE WHEN size(__fail) > 0 THEN __fail[0] WHEN size(__ins) > 0 THEN __ins[0] "
                "WHEN size(__hold) > 0 THEN __hold[0] WHEN size(__alert) > 0 THEN concat(filter(__alert, "
                f"p -> p.fused.qualifier IN ('COMPONENT_DEGRADATION', '{CONFOUNDED}')), __alert)[0] "
                "WHEN size(__eq) > 0 THEN __eq[0] END"
            ),
            "__k": F.expr(
                "CASE WHEN size(__drift) >= 2 OR size(__fail) >= 2 THEN 'compound' WHEN size(__fail) > 0 THEN 'fail' "
                "WHEN size(__ins) > 0 THEN 'ins' WHEN size(__hold) > 0 THEN 'hold' WHEN size(__alert) > 0 THEN 'alert' "
                "WHEN size(__eq) > 0 THEN 'eq' WHEN __jhit THEN 'joint' ELSE 'pass' END"
            ),
            "__multi": F.expr("size(__drift) >= 2 OR size(__fail) + size(__hold) + size(__alert) >= 2 OR __jhit"),
            "__names": F.expr(
                "array_join(array_sort(array_distinct(transform(concat(__drift, __fail), p -> p.parameter_name))), '_')"
            ),
        },
        {
            "final": F.struct(
                F.expr(
                    "CASE __k WHEN 'compound' THEN 'FAIL' WHEN 'fail' THEN 'FAIL' WHEN 'ins' THEN 'INSUFFICIENT_DATA' "
                    "WHEN 'hold' THEN 'HOLD' WHEN 'alert' THEN 'ALERT' WHEN 'eq' THEN 'EQUIPMENT_SUSPECTED' "
                    "WHEN 'joint' THEN 'HOLD' ELSE 'PASS' END"
                ).alias("state"),
                F.expr(
                    f"CASE __k WHEN 'compound' THEN IF(__conf, '{CONFOUNDED}', 'COMPONENT_DEGRADATION') "
                    "WHEN 'joint' THEN 'HOLD_SCREENING_MARGIN' WHEN 'pass' THEN 'NOMINAL_STABLE' "
                    "ELSE __first.fused.qualifier END"
                ).alias("qualifier"),
                F.expr(
                    "CASE __k WHEN 'compound' THEN concat('COMPOUND_MULTI_PARAMETER_DRIFT_', __names) "
                    "WHEN 'joint' THEN concat('JOINT:', joint.reason) "
                    "WHEN 'pass' THEN 'NOMINAL_SPEC_AND_STABLE_KINETICS' "
                    "ELSE concat(__first.parameter_name, ':', __first.fused.reason) END"
                ).alias("reason"),
                *([F.expr("IF(__k = 'joint', concat(__all, array(joint.reason)), __all)").alias("reasons")] if reasons else []),
                F.expr("CASE __k WHEN 'compound' THEN true WHEN 'joint' THEN true WHEN 'pass' THEN false ELSE __multi END").alias(
                    "compound"
                ),
            )
        },
    ]
    return layered(comp, layers)
