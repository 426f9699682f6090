"""Ridge against NumPy, safety-slope equivalence, stream = batch."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.operators import prognostics as P
from emberline.operators import regression as G
from emberline.registry import REGISTRY
from emberline.sources.adapters import telemetry_parts
from emberline.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_ridge_and_folds_match_numpy(spark):
    tri = P.training_triads(telemetry_parts(spark, SF)).persist()
    pdf = tri.toPandas()

    def fit(d):
        x = np.column_stack([np.ones(len(d)), d.u0, d.u24])
        return np.linalg.solve(x.T @ x + np.diag([0, 1.0, 1.0]), x.T @ d.u168)

    for r in G.ridge_fit(tri).collect():
        assert [r["b0"], r["b1"], r["b2"]] == pytest.approx(fit(pdf[pdf.parameter_name == r["parameter_name"]]), abs=1e-8)
    for r in G.lolo_coefficients(tri).where("parameter_name = 'RDS(on)'").collect():
        d = pdf[(pdf.parameter_name == "RDS(on)") & (pdf.lot_id != r["lot_id"])]
        assert [r["b0"], r["b1"], r["b2"]] == pytest.approx(fit(d), abs=1e-7)


def test_safety_slope_equivalence(spark):
    rows = [("RDS(on)", 50.0, 60.0), ("RDS(on)", 50.0, 60.1), ("IGSS", 5.0, -101.0), ("IGSS", 5.0, 5.0), ("VGS(th)", 3.0, 4.2), ("IDSS", 1.0, None)]
    out = P.safety_slope(spark.createDataFrame(rows, "parameter_name STRING, v24 DOUBLE, predicted DOUBLE")).collect()
    assert [r["decision"] for r in out] == ["CONTINUE", "EARLY_REJECT", "EARLY_REJECT", "CONTINUE", "EARLY_REJECT", "INSUFFICIENT_DATA"]
    for r in out[:2]:
        assert (r["drift_rate"] > r["slope_limit"]) == (r["decision"] == "EARLY_REJECT")


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    tel = telemetry_parts(spark, SF).where("lot_id IN ('Brand#1', 'Brand#2')").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    bad = tel.limit(3).withColumn("measurement_quality", F.lit("NOMINAL"))
    for t in (0, 24, 96, 168):
        tel.where(F.col("elapsed_hours") == t).coalesce(1).write.mode("append").json(f"{base}/in")
    bad.coalesce(1).write.mode("append").json(f"{base}/in")
    jobs.start_validated(jobs.read_stream(spark, f"{base}/in"), f"{base}/good", f"{base}/bad", f"{base}/ck").awaitTermination()
    assert spark.read.parquet(f"{base}/good").count() == tel.count()
    assert spark.read.parquet(f"{base}/bad").count() == 3
    clean = spark.readStream.schema(spark.read.parquet(f"{base}/good").schema).option("recursiveFileLookup", True).parquet(f"{base}/good")
    q = jobs.running_cusum(clean).writeStream.format("parquet").option("path", f"{base}/cu").option("checkpointLocation", f"{base}/ck2").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{base}/cu")
    last = {(r["component_id"], r["parameter_name"]): r for r in got.groupBy("component_id", "parameter_name").agg(F.max("n").alias("n"), F.max_by("cusum", "n").alias("c")).collect()}
    from emberline.functions.series import cusum
    from emberline.operators.represent import trajectories, with_u
    from emberline.registry import REGISTRY

    tr = trajectories(with_u(tel)).withColumn("f", REGISTRY.floor())
    ex = F.expr("transform(slice(pts, 2, 10), p -> (p.u - pts[0].u) / f)")
    want = tr.select("component_id", "parameter_name", F.size("pts").alias("n"), cusum(ex).alias("c")).collect()
    for r in want:
        s = last[(r["component_id"], r["parameter_name"])]
        assert s["n"] == r["n"] and s["c"] == pytest.approx(r["c"], abs=1e-9)


def test_rescreen_touched_lots(spark):
    from emberline.plans.screening import screen_components

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    tel = telemetry_parts(spark, SF).where("lot_id IN ('Brand#3', 'Brand#4') AND elapsed_hours <= 24").withColumn("ts", F.to_timestamp(F.lit("2024-01-01")))
    run = jobs.rescreen_on_batch(f"{base}/store", f"{base}/out", 24)
    run(tel.where("elapsed_hours = 0"), 0)
    run(tel.where("elapsed_hours = 24"), 1)
    want = {r["component_id"]: r["state"] for r in screen_components(tel, 24).select("component_id", "final.state").collect()}
    got = {r["component_id"]: r["state"] for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == want


def test_line_numbers_join_matrix_and_labels(spark, tmp_path):
    from emberline.sources.ingest import label_rows, sensor_rows

    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.data").write_text("".join(f"{i} {'NaN' if i % 3 == 0 else i * 2}\n" for i in range(5000)))
    (tmp_path / "m/b.data").write_text("9000 1\n")
    (tmp_path / "labels").write_text("".join(f'{1 if i % 7 == 0 else -1} "19/07/2008 11:55:00"\n' for i in range(5001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        cells = sensor_rows(spark, str(tmp_path / "m")).where("sensor_id = 0").collect()
        labels = {r.row_id: r.is_failure for r in label_rows(spark, str(tmp_path / "labels")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.row_id: r.value for r in cells} == {**{i: float(i) for i in range(5000)}, 5000: 9000.0}
    assert labels == {i: int(i % 7 == 0) for i in range(5001)}


def test_union_dedup_follows_the_order_column(spark):
    from emberline.sources.ingest import union_dedup

    ddl = "component_id string, lot_id string, parameter_name string, elapsed_hours int, value double, seq int"
    a = spark.createDataFrame([("C1", "L", "IDSS", 0, 5.0, 1), ("C1", "L", "IDSS", 0, 3.0, 2)], ddl)
    b = spark.createDataFrame([("C1", "L", "IDSS", 0, 9.0, 0), ("C2", "L", "IDSS", 0, 4.0, 0)], ddl)
    got = {r.component_id: r.value for r in union_dedup(a, b, order="seq").collect()}
    assert got == {"C1": 5.0, "C2": 4.0}
    assert {r.component_id: r.value for r in union_dedup(b, a, keep="last", order="seq").collect()} == {"C1": 3.0, "C2": 4.0}


def test_gbt_residual_of_all_parameters(spark):
    """Every registered parameter is fitted and predicted for itself; a row without features has no prediction."""
    from emberline.operators.regression import gbt_residual
    from emberline.registry import REGISTRY

    rows = [(f"c{i}", p, float(i % 10), (k + 1.0) * (i % 10)) for k, p in enumerate(REGISTRY.names) for i in range(60)]
    rows.append(("none", "IGSS", None, 1.0))
    df = spark.createDataFrame(rows, "component_id string, parameter_name string, x double, y double")
    found = gbt_residual(df, ["x"], "y", REGISTRY.names, iterations=20).collect()
    assert len(found) == len(rows) and [r.component_id for r in found if r.delta_hat is None] == ["none"]
    for k, p in enumerate(REGISTRY.names):
        assert max(r.delta_hat for r in found if r.parameter_name == p and r.delta_hat is not None) > 6 * (k + 1)


def test_a_reading_read_again_from_csv(spark, tmp_path):
    """The last reading of a key in the file counts, however the file is split: here it breaches its limit."""
    from emberline.plans.screening import screen_components
    from emberline.sources.ingest import read_csv

    head = "component_id,lot_id,parameter_name,elapsed_hours,value,unit"
    lines = [f"C{i},L1,{p},0,{v},{u}" for i in range(40) for p, v, u in (("IDSS", 1 + i % 3 / 10, "uA"), ("VGS(th)", 3 + i % 3 / 100, "V"), ("RDS(on)", 45, "mOhm"), ("IGSS", 1, "nA"))]
    lines += ["C1,L1,IDSS,0,99.0,uA", "C2,L1,IDSS,0,99.0,uA", "C2,L1,IDSS,0,1.0,uA"]
    (tmp_path / "t.csv").write_text("\n".join([head, *lines]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = {r.component_id: r.state for r in screen_components(read_csv(spark, str(tmp_path / "t.csv")), 0).select("component_id", "final.state").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 40 and got["C1"] == "FAIL" and got["C2"] != "FAIL"


def stream_rows(spark):
    ts = F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(hours=F.col("elapsed_hours") % F.lit(25))
    return telemetry_parts(spark, SF).where("lot_id IN ('Brand#3', 'Brand#4')").withColumn("ts", ts)


def test_lot_windows_equal_batch(spark):
    """Members and medians of closed windows are exact."""
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = stream_rows(spark)
    end = rows.limit(1).withColumn("ts", F.to_timestamp(F.lit("2024-03-01")))
    rows.write.json(f"{base}/in")
    end.write.mode("append").json(f"{base}/in2")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    stream = jobs.read_stream(spark, f"{base}/in*", files_per_trigger=100)
    q = jobs.lot_windows(stream).writeStream.format("memory").queryName("windows").outputMode("append").option("checkpointLocation", f"{base}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start, r.lot_id, r.parameter_name): (r.n_readings, r.n_components, r.n_checkpoints, r.median_value) for r in spark.table("windows").collect()}
    whole = rows.groupBy(F.window("ts", "6 hours"), "lot_id", "parameter_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("component_id").alias("m"), F.count_distinct("elapsed_hours").alias("h"), F.median("value").alias("v"))
    want = {(r.window.start, r.lot_id, r.parameter_name): (r.n, r.m, r.h, pytest.approx(r.v)) for r in whole.collect()}
    assert want and {k: got.get(k) for k in want} == want


def test_dedup_and_static_join(spark):
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = stream_rows(spark).where("elapsed_hours = 0")
    rows.unionByName(rows).write.json(f"{base}/in")
    stream = jobs.deduplicated(jobs.read_stream(spark, f"{base}/in", files_per_trigger=100))
    scored = jobs.score_stream(stream.withColumns({"u0": F.col("value"), "u24": F.col("value")}))
    q = scored.writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{base}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("scored")
    assert got.count() == rows.count() == got.select("component_id", "parameter_name").distinct().count()
    one = got.where("parameter_name = 'IDSS'").first()
    p = next(p for p in REGISTRY.parameters if p.name == "IDSS")
    assert one.spec_high == p.spec_high and one.u_hat == pytest.approx(p.beta0 + (p.beta1 + p.beta2) * one.value)


def test_late_rows_go_aside_and_mark_their_lots(spark):
    from emberline.plans.screening import screen_components

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    day = lambda d: F.to_timestamp(F.lit(f"2024-01-0{d}"))
    tel = telemetry_parts(spark, SF).where("lot_id IN ('Brand#3', 'Brand#4') AND elapsed_hours <= 24")
    early = tel.where("elapsed_hours = 0").withColumn("ts", day(1))
    today = tel.where("elapsed_hours = 24 AND lot_id = 'Brand#3'").withColumn("ts", day(3))
    late = tel.where("elapsed_hours = 24 AND lot_id = 'Brand#4'").withColumn("ts", day(2))
    run = jobs.rescreen_with_late_output(f"{base}/store", f"{base}/out", f"{base}/late", 24)
    for i, batch in enumerate((early, today, late)):
        run(batch, i)
    run(late, 2)  # a replay changes nothing
    assert [spark.read.parquet(f"{base}/late/batch={i}").count() for i in range(3)] == [0, 0, late.count()]
    want = {r.component_id: r.state for r in screen_components(tel, 24).select("component_id", "final.state").collect()}
    assert {r.component_id: r.state for r in spark.read.parquet(f"{base}/out").collect()} == want
    jobs.compact_store(spark, f"{base}/store")
    run(late.withColumn("ts", day(4)), 3)
    assert {r.component_id: r.state for r in spark.read.parquet(f"{base}/out").collect()} == want
