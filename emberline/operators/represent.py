"""Reshaping operators: transforms as columns, triads, trajectories, relative deviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import inverse_transform, transform, transform_last_bit
from emberline.registry import REGISTRY, Registry

SERIES = ["component_id", "lot_id", "parameter_name"]


def with_u(df: DataFrame, reg: Registry = REGISTRY, last_bit: bool = False) -> DataFrame:
    """Representation value ``u`` and whether the reading was inside the domain.

    ``last_bit`` is for results that take the signs of differences: ``u`` is then that of the C library to the last bit.
    """
    u = transform_last_bit if last_bit else transform
    return df.withColumn("u", u("parameter_name", "value", reg)).withColumn("domain_ok", F.col("u").isNotNull())


def with_value(df: DataFrame, u: str = "u", name: str = "value_back", reg: Registry = REGISTRY) -> DataFrame:
    return df.withColumn(name, inverse_transform("parameter_name", u, reg))


def triads(df: DataFrame, hours=(0, 24, 168), value: str = "value", prefix: str = "v") -> DataFrame:
    """One row per series with the readings of the given checkpoints; incomplete series drop out.

    Conditional aggregates are what ``pivot`` with fixed values plans to; they also keep the
    names stable.
    """
    out = df.where(F.col("elapsed_hours").isin(*hours)).groupBy(*SERIES).agg(
        *[F.max(F.when(F.col("elapsed_hours") == h, F.col(value))).alias(f"{prefix}{h}") for h in hours]
    )
    return out.dropna(subset=[f"{prefix}{h}" for h in hours])


def trajectories(df: DataFrame, value: str = "u") -> DataFrame:
    """Ordered ARRAY<STRUCT<t, u>> per series (bounded by the checkpoint schedule)."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*SERIES)
        .agg(F.array_sort(F.collect_list(F.struct(F.col("elapsed_hours").alias("t"), F.col(value).alias("u")))).alias("pts"))
    )


def relative_deviation(df: DataFrame) -> DataFrame:
    """(x(t) - x(0)) / x(0); 0 where the 0 h reading is 0."""
    w = Window.partitionBy(*SERIES)
    zero = F.max(F.when(F.col("elapsed_hours") == 0, F.col("value"))).over(w)
    return df.withColumn("__z", zero).where(F.col("__z").isNotNull()).withColumn(
        "r", F.when(F.col("__z") == 0, F.lit(0.0)).otherwise((F.col("value") - F.col("__z")) / F.nullif(F.col("__z"), F.lit(0.0)))
    ).drop("__z")


def first_abnormal(df: DataFrame, theta: float) -> DataFrame:
    """First checkpoint with |r| >= theta, and flags by 24 / 96 / 168 h."""
    hit = F.min(F.when(F.abs("r") >= theta, F.col("elapsed_hours")))
    out = relative_deviation(df).groupBy(*SERIES).agg(hit.alias("first_abnormal_hour"))
    return out.withColumns(
        {f"abnormal_by_{h}h": F.coalesce(F.col("first_abnormal_hour") <= h, F.lit(False)) for h in (24, 96, 168)}
    )
