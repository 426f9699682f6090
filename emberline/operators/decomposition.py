"""Baseline decomposition, naive screener, static screener."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import MAD_SCALE
from emberline.operators.loo import with_loo
from emberline.operators.ranks import group_median_mad
from emberline.registry import REGISTRY, Registry

# Thresholds of the decomposition vocabulary.
B_LEVELS = (1.5, 2.5, 3.5)
G_LEVELS = (1.5, 3.0)
MIN_PEERS = 4


def decomposition(df: DataFrame, hours: int, reg: Registry = REGISTRY, min_peers: int = MIN_PEERS, skewed: bool | None = None) -> DataFrame:
    """Split a reading into the component's standing at 0 h (b) and its motion since (g).

    ``df`` carries ``u``; one LOO pass serves both checkpoints because the checkpoint is a key.
    """
    keys = ["lot_id", "parameter_name", "elapsed_hours"]
    rows = df.where(F.col("elapsed_hours").isin(0, hours)).where(F.col("u").isNotNull())
    loo = with_loo(rows.select("component_id", *keys, "u"), keys, "u", reg.floor(), "p", skewed)

    def at(h, c):
        return F.max(F.when(F.col("elapsed_hours") == h, F.col(c)))

    # the scaffold keeps components whose readings were missing or outside the domain
    seen = df.where(F.col("elapsed_hours").isin(0, hours)).groupBy("component_id", "lot_id", "parameter_name").agg(
        at(0, "value").alias("raw_0"), at(hours, "value").alias("raw_t")
    )
    wide = loo.groupBy("component_id", "lot_id", "parameter_name").agg(
        *[at(0, c).alias(f"{n}_0") for c, n in (("u", "u"), ("p_n", "n"), ("p_med", "med"), ("p_mad", "mad"), ("p_scale", "scale"))],
        *[at(hours, c).alias(f"{n}_t") for c, n in (("u", "u"), ("p_n", "n"), ("p_med", "med"), ("p_mad", "mad"), ("p_scale", "scale"))],
    )
    out = seen.join(wide, ["component_id", "lot_id", "parameter_name"], "left")
    b = (F.col("u_0") - F.col("med_0")) / F.col("scale_0")
    g = ((F.col("u_t") - F.col("med_t")) - (F.col("u_0") - F.col("med_0"))) / F.col("scale_0")
    base_ok = F.col("u_0").isNotNull() & (F.col("n_0") >= min_peers)
    t_ok = base_ok & F.col("u_t").isNotNull() & (F.col("n_t") >= min_peers)
    out = out.withColumns({"b": F.when(base_ok, b), "g": F.when(t_ok, F.lit(0.0) if hours == 0 else g)})
    peer = (
        F.when(F.col("b").isNull(), "INSUFFICIENT_DATA").when(F.abs("b") >= B_LEVELS[2], "MAJOR_OUTLIER")
        .when(F.abs("b") >= B_LEVELS[1], "OUTLIER").when(F.abs("b") >= B_LEVELS[0], "SUSPECT").otherwise("NORMAL")
    )
    trend = (
        F.when(F.col("g").isNull(), "INSUFFICIENT_DATA").when(F.abs("g") >= G_LEVELS[1], "ACCELERATING")
        .when(F.abs("g") >= G_LEVELS[0], "DRIFTING").otherwise("STABLE")
    )
    note = (
        F.when(F.col("raw_0").isNull(), "MISSING_BASELINE")
        .when(F.col("u_0").isNull(), "INELIGIBLE_BASELINE")
        .when(F.col("n_0") < min_peers, "FEW_PEERS_AT_BASELINE")
        .when(F.col("raw_t").isNull(), "MISSING_OBSERVATION")
        .when(F.col("u_t").isNull(), "INELIGIBLE_OBSERVATION")
        .when(F.col("n_t") < min_peers, "FEW_PEERS_AT_CHECKPOINT")
        .otherwise("OK")
    )
    return out.withColumns({"peer_status": peer, "trend_status": trend, "note": note})


def naive_screen(df: DataFrame, hours: int, reg: Registry = REGISTRY, z_limit: float = 3.0, skewed: bool | None = None) -> DataFrame:
    """Whole-lot z at one checkpoint, no equipment awareness; ``reject`` per reading."""
    now = df.where((F.col("elapsed_hours") == hours) & F.col("u").isNotNull())
    keys = ["lot_id", "parameter_name"]
    g = group_median_mad(now, keys, "u", skewed)
    z = (F.col("u") - F.col("median")) / F.greatest(MAD_SCALE * F.col("mad"), reg.floor())
    return now.join(g, keys).withColumn("z", z).withColumn("reject", F.abs("z") >= z_limit)


def static_screen(df: DataFrame, hours: int, reg: Registry = REGISTRY) -> DataFrame:
    """Components with any absolute breach at one checkpoint."""
    v = F.col("value")
    breach = (v < reg.lookup("spec_low")) | (v > reg.lookup("spec_high"))
    return df.where((F.col("elapsed_hours") == hours) & breach).select("component_id", "lot_id").distinct()
