"""Telemetry sources and sinks: files in, result tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import finite
from emberline.operators.quality import assert_columns, assert_no_labels
from emberline.sources.schemas import KEY, TELEMETRY_DDL


def arrival() -> Column:
    """Order in which rows of files arrived: by time and name of the file, then by place in it.

    A task reads a block of a file from top to bottom, so block start and row number are the place, whatever the split.
    """
    at = F.col("_metadata")
    return F.struct(at["file_modification_time"].alias("time"), at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row"))


def read_csv(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    """CSV telemetry with the fixed schema; malformed lines are kept in ``_corrupt_record``.

    ``arrival_seq`` says in which order readings came, so that of one read again the last counts.
    """
    header = spark.read.option("header", True).csv(path).columns
    if any(c not in TELEMETRY_DDL for c in header):
        assert_no_labels(spark.read.option("header", True).csv(path))
    ddl = {c.strip().split(" ")[0]: c.strip() for c in TELEMETRY_DDL.split(",")}
    schema = ", ".join(ddl.get(c, f"`{c}` STRING") for c in header)
    df = (
        spark.read.schema(schema + ", _corrupt_record STRING")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .csv(path)
    )
    return tag_source(assert_columns(_numbered(df)), source_type)


def _numbered(df: DataFrame) -> DataFrame:
    return df if "arrival_seq" in df.columns else df.withColumn("arrival_seq", arrival())


def read_parquet(spark: SparkSession, path: str, source_type: str | None = None) -> DataFrame:
    return tag_source(assert_no_labels(assert_columns(_numbered(spark.read.parquet(path)))), source_type)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded records, every field as text; coercion and rejection happen in :func:`coerce`."""
    cols = [c.strip().split(" ")[0] for c in TELEMETRY_DDL.split(",")]
    return _numbered(spark.read.schema(", ".join(f"{c} STRING" for c in cols)).json(path))


def tag_source(df: DataFrame, source_type: str | None) -> DataFrame:
    return df if source_type is None else df.withColumn("source_type", F.lit(source_type))


def coerce(records: DataFrame) -> DataFrame:
    """A2: numeric coercion of text fields; ``reject_reason`` is NULL for accepted rows."""
    num = records.withColumns(
        {
            "elapsed_hours_num": F.expr("try_cast(elapsed_hours AS INT)"),
            "value_num": finite(F.expr("try_cast(value AS DOUBLE)")),
        }
    )
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    reason = (
        F.when(blank("component_id") | blank("lot_id") | blank("parameter_name"), "MISSING_FIELD")
        .when(F.col("elapsed_hours_num").isNull(), "BAD_ELAPSED_HOURS")
        .when(F.col("value_num").isNull(), "NON_NUMERIC_VALUE")
    )
    return num.withColumn("reject_reason", reason)


def upload_profile(df: DataFrame, key=KEY) -> DataFrame:
    """A3: one row: totals, missing, duplicate and invalid rows, distinct entities, readiness."""
    bad = F.isnan("value") | (F.abs("value") == float("inf"))
    base = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("value").isNull()).alias("n_missing"),
        F.count_if(bad).alias("n_invalid"),
        F.array_join(F.sort_array(F.collect_set(F.col("elapsed_hours"))).cast("array<string>"), ",").alias("checkpoints"),
        F.array_join(F.sort_array(F.collect_set("parameter_name")), ",").alias("parameters"),
    )
    dup = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(
        F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("n_duplicate")
    )
    comps = df.select("component_id").distinct().agg(F.count(F.lit(1)).alias("n_components"))
    lots = df.select("lot_id").distinct().agg(F.count(F.lit(1)).alias("n_lots"))
    out = base.crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(comps)).crossJoin(F.broadcast(lots))
    ready = (
        F.when(F.col("n_rows") == 0, "EMPTY")
        .when((F.col("n_invalid") > 0) | (F.col("n_duplicate") > 0), "NEEDS_REVIEW")
        .when(F.col("n_missing") > 0, "READY_WITH_GAPS")
        .otherwise("READY")
    )
    return out.withColumn("readiness", ready)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, line) of text files: row_id is the line number, files one after the other by path.

    A split reads its lines in order, so a line's number is its place in the split plus the lines of the splits
    before; only one row per split is counted and summed.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__id"), F.col("value").alias("line")
    )
    splits = lines.groupBy("__path", "__start").agg(F.min("__id").alias("__base"), F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__path", "__start").rowsBetween(Window.unboundedPreceding, -1))
    placed = splits.select("__path", "__start", "__base", F.coalesce(before, F.lit(0)).alias("__before"))
    return lines.join(placed, ["__path", "__start"]).select((F.col("__id") - F.col("__base") + F.col("__before")).alias("row_id"), "line")


def sensor_rows(spark: SparkSession, path: str) -> DataFrame:
    """A4: space-delimited wide matrix -> (row_id, sensor_id, value); NaN becomes NULL. row_id is the line number."""
    lines = numbered_lines(spark, path).select("row_id", F.split(F.trim("line"), r"\s+").alias("c"))
    long = lines.select("row_id", F.posexplode("c").alias("sensor_id", "text"))
    return long.select("row_id", "sensor_id", finite(F.expr("try_cast(text AS DOUBLE)")).alias("value"))


def label_rows(spark: SparkSession, path: str) -> DataFrame:
    """A4: one label per line, -1 good and 1 failed, then an optional time -> (row_id, is_failure); joins to sensor_rows."""
    first = F.expr("try_cast(element_at(split(trim(line), '[ ,]+'), 1) AS INT)")
    return numbered_lines(spark, path).select("row_id", (first == 1).cast("int").alias("is_failure"))


def component_metadata(df: DataFrame) -> DataFrame:
    """A5: per component: lot, sorted checkpoints and parameters."""
    return df.groupBy("component_id", "lot_id").agg(
        F.array_join(F.sort_array(F.collect_set("elapsed_hours")).cast("array<string>"), ",").alias("checkpoints"),
        F.array_join(F.sort_array(F.collect_set("parameter_name")), ",").alias("parameters"),
    )


def union_dedup(first: DataFrame, second: DataFrame, key=KEY, keep: str = "first", order: str = "value") -> DataFrame:
    """Union of two sources; on a repeated key the first (or last) source wins.

    Inside one source the row with the smallest (or largest) ``order`` wins - a column both sources have, such as
    an arrival number - and among equals the one whose other columns come first (or last).
    A mergeable ``min_by`` / ``max_by`` instead of a window: repeats collapse before the shuffle.
    """
    both = first.withColumn("__src", F.lit(0)).unionByName(second.withColumn("__src", F.lit(1)))
    rest = [c for c in first.columns if c not in key]
    pick = (F.min_by if keep == "first" else F.max_by)(F.struct(*rest), F.struct("__src", order, *[c for c in rest if c != order]))
    return both.groupBy(*key).agg(pick.alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest]).select(*first.columns)


def collapse_last(df: DataFrame, order: Column | str, key=("component_id", "lot_id", "parameter_name", "elapsed_hours")) -> DataFrame:
    """A10: last value per key in the given order (mergeable, no window)."""
    order = F.col(order) if isinstance(order, str) else order
    return df.groupBy(*key).agg(F.max_by("value", order).alias("value"))


def write_results(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = "lot_id") -> None:
    """Result sink, partitioned by lot; parquet, json or csv (nested columns as JSON text)."""
    if fmt == "csv":
        df = df.select(
            *[
                F.to_json(F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("struct", "array", "map") else F.col(f.name)
                for f in df.schema.fields
            ]
        )
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(partition) if partition and partition in df.columns else w).save(path)
