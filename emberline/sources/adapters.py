"""Views that turn the star-schema test tables into telemetry, sensor and label tables.

Repeated readings of one (component, checkpoint) are collapsed by their mean, computed
from integer sums: exact, order-free, and a constant-size mergeable state - a component
holding a third of all rows costs one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.sources.schemas import TELEMETRY_COLUMNS

EPOCH = "1995-01-01"
BUCKET_DAYS = 625


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hours(bucket: Column) -> Column:
    return F.when(bucket <= 0, 0).when(bucket == 1, 24).when(bucket == 2, 96).otherwise(168).cast("int")


def _constants(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "temperature_C": F.lit(150.0),
            "test_condition": F.lit("HTRB"),
            "measurement_quality": F.lit("VALID"),
            "rework_count": F.lit(0),
            "absolute_limit_low": F.lit(None).cast("double"),
            "absolute_limit_high": F.lit(None).cast("double"),
            "source_type": F.lit("real"),
        }
    )


def telemetry_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-parameter telemetry of parts: lot = brand, checkpoint = ship-date bucket."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    bucket = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit(EPOCH).cast("date")) / BUCKET_DAYS)

    def cents(c):
        return F.round(F.col(c) * 100).cast("bigint")

    cells = (
        li.select(
            "l_partkey",
            _hours(bucket).alias("elapsed_hours"),
            cents("l_extendedprice").alias("p"),
            cents("l_discount").alias("d"),
            F.round("l_quantity").cast("bigint").alias("q"),
            cents("l_tax").alias("x"),
        )
        .groupBy("l_partkey", "elapsed_hours")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("p").alias("p"),
            F.sum("d").alias("d"),
            F.sum("q").alias("q"),
            F.sum("x").alias("x"),
        )
    )

    def mean(c):
        return F.col(c).cast("double") / F.col("n").cast("double")

    values = F.array(
        F.struct(F.lit("IDSS").alias("k"), (mean("p") / 1000000.0).alias("v"), F.lit("uA").alias("u")),
        F.struct(F.lit("VGS(th)").alias("k"), (1.95 + mean("d") * 0.2).alias("v"), F.lit("V").alias("u")),
        F.struct(F.lit("RDS(on)").alias("k"), (18.25 + mean("q")).alias("v"), F.lit("mOhm").alias("u")),
        F.struct(F.lit("IGSS").alias("k"), ((mean("x") - 4.0) * 26.0 + 0.5).alias("v"), F.lit("nA").alias("u")),
    )
    long = cells.join(part, cells.l_partkey == part.p_partkey, "inner").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("component_id"),
        F.col("p_brand").alias("lot_id"),
        F.concat(F.lit("CH_"), F.pmod("l_partkey", F.lit(8)).cast("string")).alias("channel_id"),
        F.concat(F.lit("ATE_"), F.pmod("p_size", F.lit(2)).cast("string")).alias("instrument_id"),
        "elapsed_hours",
        F.explode(values).alias("s"),
    )
    long = long.select(
        "component_id", "lot_id", F.col("s.k").alias("parameter_name"), "elapsed_hours",
        F.col("s.v").alias("value"), F.col("s.u").alias("unit"), "instrument_id", "channel_id",
    )
    return _constants(long).select(*TELEMETRY_COLUMNS)


EVENT_PARAMETER = {"click": "IDSS", "view": "VGS(th)", "purchase": "RDS(on)", "signup": "IGSS", "error": "ERR"}


def event_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw, uncollapsed readings from events (repeats, gaps, an unknown parameter), with ``ts``."""
    ev = table(spark, sf_dir, "events")
    return event_rows(ev)


def event_rows(ev: DataFrame) -> DataFrame:
    """Column mapping of the events table; works on a stream as well. Readings arrive in the order of time and event."""
    kind = F.col("event_type")
    param, unit = F.lit("ERR"), F.lit("?")
    for k, v in EVENT_PARAMETER.items():
        param = F.when(kind == k, v).otherwise(param)
    units = {"IDSS": "uA", "VGS(th)": "V", "RDS(on)": "mOhm", "IGSS": "nA"}
    for k, v in EVENT_PARAMETER.items():
        if v in units:
            unit = F.when(kind == k, units[v]).otherwise(unit)
    hours = F.floor((F.unix_timestamp("ts") - F.lit(1704067200)) / 3600)
    bucket = F.least(F.lit(3), F.floor(hours / 180))
    return ev.select(
        "event_id",
        "ts",
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("component_id"),
        F.concat(F.lit("LOT_"), F.floor(F.col("user_id") / 15).cast("string")).alias("lot_id"),
        param.alias("parameter_name"),
        _hours(bucket).alias("elapsed_hours"),
        "value",
        unit.alias("unit"),
        F.struct("ts", "event_id").alias("arrival_seq"),
    )


def telemetry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed, naturally gappy telemetry of users."""
    ev = event_readings(spark, sf_dir)
    cells = ev.groupBy("component_id", "lot_id", "parameter_name", "elapsed_hours", "unit").agg(
        (F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double") / F.count("value").cast("double") / 100.0)
        .alias("value")
    )
    cells = cells.withColumn("instrument_id", F.lit(None).cast("string")).withColumn(
        "channel_id", F.lit(None).cast("string")
    )
    return _constants(cells).select(*TELEMETRY_COLUMNS)


def sensor_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, sensor_id, value) from embeddings, with missing cells by a fixed rule."""
    em = table(spark, sf_dir, "embeddings")
    long = em.select(F.col("vec_id").alias("row_id"), F.posexplode("embedding").alias("sensor_id", "v"))
    hole = (F.col("row_id") * 31 + F.col("sensor_id")) % 17 == 0
    return long.select("row_id", "sensor_id", F.when(~hole, F.col("v").cast("double")).alias("value"))


def row_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = table(spark, sf_dir, "embeddings")
    return em.select(F.col("vec_id").alias("row_id"), (F.col("label") == 0).cast("int").alias("is_failure"))
