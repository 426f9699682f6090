"""Structured Streaming forms of the batch operators: same schema, same expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.scalars import transform
from emberline.operators.prognostics import locked_score
from emberline.operators.quality import KEY, row_errors
from emberline.plans.screening import screen_components
from emberline.registry import REGISTRY, Registry
from emberline.sources.schemas import TELEMETRY_DDL


def read_stream(spark: SparkSession, path: str, fmt: str = "json", files_per_trigger: int = 1) -> DataFrame:
    """Telemetry files as a stream with the fixed schema, an event time ``ts`` and ``arrival_seq``, by which of a
    reading that comes again the last counts."""
    rows = (
        spark.readStream.schema(TELEMETRY_DDL + ", ts TIMESTAMP")
        .option("maxFilesPerTrigger", files_per_trigger)
        .format(fmt)
        .load(path)
    )
    file = F.col("_metadata")
    return rows.withColumn("arrival_seq", F.struct("ts", file["file_modification_time"].alias("time"), file["file_path"].alias("file")))


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without rule violations, and the violations (one row per rule)."""
    marked = batch.withColumn("__id", F.monotonically_increasing_id())
    bad = row_errors(marked)
    good = marked.join(bad.select("__id").distinct(), "__id", "left_anti").drop("__id")
    return good, bad.drop("__id")


def start_validated(stream: DataFrame, good_path: str, bad_path: str, checkpoint: str):
    """Two sinks of one stream; a replayed batch overwrites its own folder, so it counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from emberline.session import cut

        fixed = cut(batch)
        good, bad = split_valid(fixed)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deduplicated(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One reading per key within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(KEY)


def lot_windows(stream: DataFrame, delay: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """Per lot, parameter and event-time window, once it closes: readings, members, checkpoints, exact median.

    Two chained aggregations: a member's readings first, then the window's members, so a member counts once and the
    state of a window is what it holds. Empty values count as readings and not in the median.
    """
    member = (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", width), "lot_id", "parameter_name", "component_id")
        .agg(F.count(F.lit(1)).alias("n"), F.collect_list("value").alias("xs"), F.collect_set("elapsed_hours").alias("hours"))
    )
    lot = member.groupBy(F.window("window", width), "lot_id", "parameter_name").agg(
        F.sum("n").alias("n_readings"),
        F.count("component_id").alias("n_components"),
        F.sort_array(F.flatten(F.collect_list("xs"))).alias("xs"),
        F.size(F.array_distinct(F.flatten(F.collect_list("hours")))).alias("n_checkpoints"),
    )
    n = F.size("xs")
    low, high = (F.get("xs", F.floor((n - 1 + k) / 2).cast("int")) for k in (0, 1))
    return lot.withColumn("median_value", F.when(n > 0, (low + high) / 2.0)).drop("xs")


def chamber_sessions(stream: DataFrame, delay: str = "1 hour", gap: str = "2 hours") -> DataFrame:
    """Uninterrupted measuring sessions of an instrument."""
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap), "instrument_id")
        .agg(F.count(F.lit(1)).alias("n_readings"))
    )


STATE_DDL = "u0 DOUBLE, last_u DOUBLE, last_t INT, pos DOUBLE, neg DOUBLE, n INT"
OUT_DDL = "component_id STRING, parameter_name STRING, elapsed_hours INT, u DOUBLE, step DOUBLE, cusum DOUBLE, n INT"


def running_cusum(stream: DataFrame, reg: Registry = REGISTRY, slack: float = 0.25) -> DataFrame:
    """Per series, the step to the last reading and the two-sided CUSUM of departures from the
    first reading in noise-floor units.  State is six numbers per series."""
    rows = stream.withColumns({"u": transform("parameter_name", "value", reg), "floor": reg.floor()}).where("u IS NOT NULL")
    rows = rows.select("component_id", "parameter_name", "elapsed_hours", "u", "floor")

    def step(key, frames: Iterator, state):
        import pandas as pd

        pdf = pd.concat(list(frames)).sort_values("elapsed_hours")
        u0, last_u, last_t, pos, neg, n = state.get if state.exists else (None, None, -1, 0.0, 0.0, 0)
        out = []
        for t, u, fl in zip(pdf["elapsed_hours"], pdf["u"], pdf["floor"]):
            if t <= last_t:  # late or repeated reading: handled by the re-screen, not by this state
                continue
            if u0 is None:
                u0, jump = u, 0.0
            else:
                e, jump = (u - u0) / fl, abs(u - last_u)
                pos, neg = max(0.0, pos + e - slack), max(0.0, neg - e - slack)
            last_u, last_t, n = u, int(t), n + 1
            out.append((key[0], key[1], int(t), float(u), float(jump), float(max(pos, neg)), int(n)))
        if u0 is not None:
            state.update((float(u0), float(last_u), int(last_t), float(pos), float(neg), int(n)))
        yield pd.DataFrame(out, columns=[c.strip().split(" ")[0] for c in OUT_DDL.split(",")])

    return rows.groupBy("component_id", "parameter_name").applyInPandasWithState(step, OUT_DDL, STATE_DDL, "append", "NoTimeout")


LOT_BUCKETS = 256
COMPACT_EVERY = 100  # batches between two rewrites of a re-screen store


def lot_bucket(lot: str = "lot_id"):
    return F.pmod(F.xxhash64(lot), F.lit(LOT_BUCKETS)).cast("int")


def compact(spark: SparkSession, store: str, target: str) -> None:
    """Rewrite a re-screen store into ``target`` with one reading per key and few files per bucket."""
    rows = spark.read.option("basePath", store).parquet(f"{store}/part=*")
    _latest(rows).withColumn("part", F.lit(0)).withColumn("lot_bucket", lot_bucket()).repartition("lot_bucket").write.mode("overwrite").partitionBy("part", "lot_bucket").parquet(target)


def _parts(spark: SparkSession, store: str) -> DataFrame:
    """All rows of a store: its compacted base, if any, and the batches since."""
    rows = spark.read.option("basePath", store).parquet(f"{store}/part=*")
    base = rows.where("part < 0").agg(F.max(-F.col("part"))).first()[0]
    return rows if base is None else rows.where((F.col("part") == -base) | (F.col("part") >= base))


def compact_store(spark: SparkSession, store: str) -> None:
    """Writes a store's rows once more as the base of all batches so far: one reading per key, few files per bucket.

    The base is part -n, where n is the first batch it does not hold; readers take the latest base and batches from n on,
    so a crash halfway leaves the batches in use. Superseded folders may be deleted at leisure.
    """
    rows = _parts(spark, store)
    n = (rows.where("part >= 0").agg(F.max("part")).first()[0] or 0) + 1
    whole = _latest(rows).withColumn("lot_bucket", lot_bucket()).repartition("lot_bucket")
    whole.write.mode("overwrite").partitionBy("lot_bucket").parquet(f"{store}/part=-{n}")


def _latest(rows: DataFrame) -> DataFrame:
    """A key read again keeps its latest batch, inside a batch the reading that arrived last."""
    keep = [c for c in rows.columns if c not in (*KEY, "part", "lot_bucket")]
    order = ["batch", *(["arrival_seq"] if "arrival_seq" in keep else []), "ts"]
    return rows.groupBy(*KEY).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("r")).select(*KEY, "r.*")


def rescreen_on_batch(store: str, out: str, as_of: int) -> Callable[[DataFrame, int], None]:
    """Append the batch, find the lots it touched, screen those lots whole, overwrite them.

    A late reading of one member changes every peer's reference, so a lot is always redone as a
    whole. The store is partitioned by a hash bucket of the lot and the batch's buckets (at most
    LOT_BUCKETS numbers) are literals of the read, so other buckets are pruned, not scanned.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        from emberline.session import cut

        fixed = cut(batch)
        fixed.withColumn("batch", F.lit(batch_id)).withColumn("lot_bucket", lot_bucket()).write.mode("overwrite").partitionBy("lot_bucket").parquet(f"{store}/part={batch_id}")
        touched = fixed.select("lot_id").distinct()
        buckets = [r[0] for r in touched.select(lot_bucket()).distinct().collect()]
        rows = _parts(spark, store).where(F.col("lot_bucket").isin(buckets)).join(touched, "lot_id", "left_semi")
        result = screen_components(_latest(rows).drop("batch"), as_of, evidence=False).select("component_id", "lot_id", "final.state", "final.reason")
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lot_id").parquet(out)

    return run


def late_rows(batch: DataFrame, watermark) -> tuple[DataFrame, DataFrame]:
    """Rows at or after the watermark, and those before it for the side output; without one all are in time."""
    if watermark is None:
        return batch, batch.limit(0)
    edge = F.lit(watermark).cast("timestamp")
    return batch.where(F.coalesce(F.col("ts") >= edge, F.lit(True))), batch.where(F.col("ts") < edge)


def watermark_before(spark: SparkSession, place: str, batch_id: int, delay: str):
    """The watermark a batch starts with: the latest event time of all batches before it, less ``delay``; None at first.

    Event times are kept per batch in ``place``, so a batch that is replayed is judged by the same watermark.
    """
    seen = spark.createDataFrame([], "latest TIMESTAMP, batch LONG")
    if batch_id > 0:
        seen = spark.read.schema("latest TIMESTAMP, batch LONG").option("basePath", place).parquet(place)
    edge = seen.where(F.col("batch") < batch_id).agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("edge")).first()
    return edge[0]


def rescreen_with_late_output(store: str, out: str, late: str, as_of: int, delay: str = "1 hour") -> Callable[[DataFrame, int], None]:
    """``rescreen_on_batch`` of all rows, late ones too, which mark their lots for it; late rows are also written
    to ``late``, one folder per batch."""
    screen = rescreen_on_batch(store, out, as_of)

    def run(batch: DataFrame, batch_id: int) -> None:
        from emberline.session import cut

        spark, fixed = batch.sparkSession, cut(batch)
        place = f"{store}_watermark"
        edge = watermark_before(spark, place, batch_id, delay)
        beyond = late_rows(fixed, edge)[1]
        beyond.write.mode("overwrite").parquet(f"{late}/batch={batch_id}")
        fixed.agg(F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{place}/batch={batch_id}")
        screen(fixed, batch_id)
        if batch_id and batch_id % COMPACT_EVERY == 0:
            compact_store(spark, store)

    return run


def score_stream(stream: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """Stream-static enrichment: coefficients of the registry on triad rows (u0, u24)."""
    coef = reg.to_df(stream.sparkSession).select("parameter_name", "unit", "spec_low", "spec_high")
    return locked_score(stream, reg).join(F.broadcast(coef), "parameter_name", "left")
