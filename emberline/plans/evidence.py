"""Views over screened evidence: lots, equipment, comparisons, sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.reporting import action


def lot_statuses(components: DataFrame) -> DataFrame:
    """lot -> component -> state, one row per component (a lot is never gathered in a cell)."""
    return components.select("lot_id", "component_id", "final.state", action("final.state").alias("action"))


def equipment_diagnostics(s: DataFrame) -> DataFrame:
    """per lot and channel: members, verdicts, worst z and the action."""
    ch = s.where("has_now AND eq.channel IS NOT NULL").groupBy("lot_id", "parameter_name", F.col("eq.channel").alias("channel")).agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or("eq.chamber_suspected").alias("c"),
        F.bool_or("eq.channel_suspected").alias("b"),
        F.max(F.abs("eq.channel_z")).alias("z"),
    )
    out = ch.groupBy("lot_id", "channel").agg(
        F.max("n").alias("n_affected"),
        F.bool_or("c").alias("chamber_suspected"),
        F.bool_or("b").alias("channel_suspected"),
        F.max("z").alias("worst_z"),
    )
    action = F.when(F.col("chamber_suspected"), "INSPECT_CHAMBER").when(F.col("channel_suspected"), "RECALIBRATE_CHANNEL").otherwise("NO_ACTION")
    return out.withColumn("action", action)


def channel_verdicts(s: DataFrame, parameter: str = "RDS(on)") -> DataFrame:
    """per lot and channel of one parameter: components, offset, z, status, reason, action and the lot's protocol.

    A channel without enough components of its own or beside it is SUPPRESSED and its action SAMPLE_INSUFFICIENT.
    """
    at = s.where((F.col("parameter_name") == parameter) & F.expr("has_now AND eq.channel IS NOT NULL"))
    ch = at.groupBy("lot_id", F.col("eq.channel").alias("channel")).agg(
        F.count_distinct("component_id").alias("n_components"),
        F.max("eq.channel_offset").alias("channel_offset"),
        F.max("eq.channel_z").alias("z"),
        F.bool_or("eq.channel_suspected").alias("suspected"),
        F.max("eq.channel_reason").alias("reason"),
    )
    short = F.col("reason").isin("CHANNEL_BIAS_SUPPRESSED_SMALL_SAMPLE", "INSUFFICIENT_REFERENCE_POPULATION")
    told = ch.withColumns(
        {
            "status": F.when(F.col("suspected"), "DRIFT_SUSPECTED").when(short, "SUPPRESSED").otherwise("NOMINAL"),
            "action": F.when(F.col("suspected"), "QUARANTINE_SOCKET_FIXTURE").when(short, "SAMPLE_INSUFFICIENT").otherwise("ACCEPT_FOR_FLIGHT"),
        }
    )
    lots = told.groupBy("lot_id").agg(F.bool_or("suspected").alias("any"), F.sum(F.when(F.col("suspected"), F.col("n_components")).otherwise(0)).alias("n_affected"))
    protocol = F.when(F.col("any"), "EXCURSION_DETECTED").otherwise("NOMINAL").alias("fixture_status")
    return told.join(lots.select("lot_id", protocol, "n_affected"), "lot_id").drop("suspected")


def affected_components(s: DataFrame, parameter: str = "RDS(on)") -> DataFrame:
    """lot_id, channel, component_id of the components in suspected channels; one row each, whatever their number."""
    hit = s.where((F.col("parameter_name") == parameter) & F.expr("has_now AND eq.channel_suspected"))
    return hit.select("lot_id", F.col("eq.channel").alias("channel"), "component_id").distinct()


def naive_vs_aware(naive: DataFrame, components: DataFrame) -> DataFrame:
    """F8: what the naive screener rejects against the fused state."""
    rej = naive.groupBy("component_id").agg(F.bool_or("reject").alias("naive"))
    j = components.join(rej, "component_id", "left")
    return j.groupBy("final.state", F.coalesce("naive", F.lit(False)).alias("naive_reject")).agg(F.count(F.lit(1)).alias("n"))


def g_excess_sweep(s: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """Equipment-suspected series counted as confounded or equipment-only per cut."""
    aggs = []
    for i, c in enumerate(cuts):
        conf = F.coalesce(F.abs(F.coalesce("drift.g_excess", "drift.g")) >= c, F.lit(False)) | F.col("drift.persistent")
        aggs += [
            F.count_if(F.col("eq.suspected") & conf).alias(f"a{i}"),
            F.count_if(F.col("eq.suspected") & ~conf).alias(f"b{i}"),
        ]
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cut"), F.col(f"a{i}").alias("n_confounded"), F.col(f"b{i}").alias("n_equipment_only")) for i, c in enumerate(cuts)])
    return s.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")
