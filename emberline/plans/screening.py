"""The assembled screening plan: telemetry -> parameter evidence -> component dispositions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators import detectors as D
from emberline.operators.fusion import FUSED_READS, FUSION_READS, JOINT_READS, fuse_component, fusion_layers
from emberline.operators.joint import joint_distance, joint_input_layers, lot_moments
from emberline.operators.layers import layered, merge, trimmed
from emberline.operators.quality import assert_no_labels
from emberline.operators.series import components, is_skewed_components, lot_context, series, with_context
from emberline.registry import REGISTRY, Registry
from emberline.session import compiled, cut


def _horizons(as_of) -> list[int]:
    return [int(as_of)] if isinstance(as_of, (int, float)) else [int(t) for t in as_of]


def _components(telemetry: DataFrame, as_of, reg: Registry) -> DataFrame:
    """Component histories, read from the source once and kept: everything below starts from them."""
    assert_no_labels(telemetry)
    compiled(telemetry.sparkSession)
    return cut(components(telemetry, _horizons(as_of), reg))


def _contextual(comps: DataFrame, reg: Registry, kinds=("level", "step", "end", "chamber", "joint"), channels: bool = True, skewed: bool | None = None) -> DataFrame:
    skewed = is_skewed_components(comps) if skewed is None else skewed
    ser = series(comps, reg)
    return with_context(ser, lot_context(ser, kinds, channels, skewed), kinds)


def contextual_series(
    telemetry: DataFrame,
    as_of: int | Iterable[int],
    reg: Registry = REGISTRY,
    kinds=("level", "step", "end", "chamber", "joint"),
    channels: bool = True,
    skewed: bool | None = None,
) -> DataFrame:
    """Series rows with lot context: what every detector starts from."""
    return _contextual(_components(telemetry, as_of, reg), reg, kinds, channels, skewed)


def _parameters(comps: DataFrame, reg: Registry, skewed: bool | None, fields: Mapping[str, Sequence[str]] | None) -> DataFrame:
    s = _contextual(comps, reg, skewed=skewed)
    evidence = merge(
        D.sufficiency_layers(), D.spec_layers(reg), D.equipment_layers(), D.peer_layers(reg), D.drift_layers(),
        D.step_layers(), joint_input_layers(),
    )
    if fields is not None:
        evidence = trimmed(evidence, {k: list(dict.fromkeys([*read, *fields.get(k, ())])) for k, read in FUSION_READS.items()})
    s = layered(s, [*evidence, *fusion_layers()])
    return s.select(
        "as_of_hours", "component_id", "lot_id", "parameter_name", "now", "u_now", "obs",
        "spec", "peer", "drift", "step", "eq", "suff", "fused", "joint_x", "joint_m", "joint_s",
    )


def screen_parameters(
    telemetry: DataFrame,
    as_of: int | Iterable[int],
    reg: Registry = REGISTRY,
    skewed: bool | None = None,
    fields: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """One row per (horizon, component, parameter) with all evidence structs and ``fused``.

    With ``fields`` the structs hold what the fusion reads and the fields named, and no more is computed.
    """
    return _parameters(_components(telemetry, as_of, reg), reg, skewed, fields)


def screen_components(
    telemetry: DataFrame, as_of: int | Iterable[int], reg: Registry = REGISTRY, skewed: bool | None = None, evidence: bool = True
) -> DataFrame:
    """One row per (horizon, component): final state, qualifier, reasons, joint evidence, params.

    Without ``evidence`` only ``final`` comes back, less its list of all reasons, and only what it reads is computed.

    Lot or component selections are filters on the *result*: they cannot move below the lot
    aggregation, so peers never change with the selection.
    """
    comps = _components(telemetry, as_of, reg)
    rows = _parameters(comps, reg, skewed, None if evidence else {})
    item = F.struct(
        reg.lookup("ordinal").alias("ordinal"), "parameter_name", "fused", "now", "spec", "peer", "drift", "step",
        "eq", "suff", "joint_x", "joint_m", "joint_s",
    )
    # what the fusion reads travels apart from the evidence, so that evidence nobody selects is not moved
    short = F.struct(
        reg.lookup("ordinal").alias("ordinal"), "parameter_name", F.col("now").isNotNull().alias("has_now"), "joint_x", "joint_m", "joint_s",
        (F.col("fused") if evidence else F.struct(*[F.col(f"fused.{f}").alias(f) for f in FUSED_READS])).alias("fused"),
    )
    lists = [F.sort_array(F.collect_list(short)).alias("__params")]
    if evidence:
        lists.append(F.sort_array(F.collect_list(item)).alias("params"))
    comp = rows.groupBy("as_of_hours", "component_id", "lot_id").agg(*lists)
    comp = _with_joint(comp, comps, reg, "__params", None if evidence else JOINT_READS)
    comp = fuse_component(comp, "__params", evidence)
    return comp.select("as_of_hours", "component_id", "lot_id", "final", *(["joint", "params"] if evidence else []))


def joint_only(
    telemetry: DataFrame, as_of: int | Iterable[int], reg: Registry = REGISTRY, skewed: bool | None = None
) -> DataFrame:
    """Joint evidence alone: component rows with ``joint``."""
    comps = _components(telemetry, as_of, reg)
    s = layered(_contextual(comps, reg, ("joint",), False, skewed), joint_input_layers())
    comp = s.groupBy("as_of_hours", "component_id", "lot_id").agg(
        F.sort_array(
            F.collect_list(F.struct(reg.lookup("ordinal").alias("ordinal"), "has_now", "joint_x", "joint_m", "joint_s"))
        ).alias("params")
    )
    return _with_joint(comp, comps, reg, "params")


def _with_joint(comp: DataFrame, comps: DataFrame, reg: Registry, params: str, fields: Sequence[str] | None = None) -> DataFrame:
    p = F.col(params)
    comp = comp.withColumns({"x": p["joint_x"], "joint_m": p["joint_m"], "joint_s": p["joint_s"], "now_any": F.array_contains(p["has_now"], True)})
    comps = comps.withColumn("now_any", F.expr("exists(readings, r -> r.elapsed_hours = as_of_hours)"))
    moments = lot_moments(series_vectors(comps, reg), len(reg.parameters))
    return joint_distance(comp, moments, reg.names, fields)


def series_vectors(comps: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """Component rows with ``x``: the joint vector in registry order (NULL where undefined)."""

    def at(name, t):
        return F.get(
            F.filter("readings", lambda r: (r["parameter_name"] == name) & (r["elapsed_hours"] == t)), F.lit(0)
        )

    xs = []
    for name in reg.names:
        now, zero = at(name, F.col("as_of_hours")), at(name, F.lit(0))
        xs.append(
            F.when((F.col("as_of_hours") > 0) & zero.isNotNull(), now["u"] - zero["u"]).otherwise(now["u"])
        )
    return comps.withColumn("x", F.array(*xs)).drop("readings")
