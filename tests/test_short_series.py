"""Series of up to four points are written out in columns: same values as the general form, which longer ones still take."""

import random

from pyspark.sql import functions as F

from emberline.functions import series as S
from emberline.operators.detectors import step_layers
from emberline.operators.layers import layered
from emberline.plans.screening import screen_parameters
from emberline.session import HUGE_CONF, compiled

HOURS = [0, 24, 96, 168, 240, 300, 400]


def drawn(seed, n=300):
    rnd = random.Random(seed)
    return [(i, [(t, rnd.choice([rnd.gauss(0, 3), 1.0, 2.0])) for t in sorted(rnd.sample(HOURS, rnd.randrange(0, 7)))]) for i in range(n)]


def test_slopes_and_cusum_equal_the_general_form(spark):
    rows = spark.createDataFrame(drawn(1), "id INT, pts ARRAY<STRUCT<t: INT, u: DOUBLE>>")
    rows = rows.withColumn("s", S.short_slopes(F.col("pts"))).withColumn("e", F.transform("pts", lambda p: p["u"]))
    few = F.slice("e", 1, 3)
    got = rows.select(
        S.theil_sen(F.col("pts")).alias("a"), S.theil_sen_short(F.col("pts"), F.col("s")).alias("b"),
        S.cusum(few).alias("c"), S.cusum_short(F.least(F.size("e"), F.lit(3)), [F.get("e", F.lit(i)) for i in range(3)]).alias("d"),
    ).collect()
    assert all(r["a"] == r["b"] and r["c"] == r["d"] for r in got) and sum(r["a"] is not None for r in got) > 100


def largest(obs):
    """d, a, b of the first of the largest jumps, the last one of jumps that are all zero."""
    best = (-1.0, 0, 0)
    for (a, x), (b, y) in zip(obs, obs[1:]):
        if x is not None and y is not None and (abs(y - x) > best[0] or best[0] <= 0):
            best = (abs(y - x), a, b)
    return best


def test_steps_with_gaps_equal_a_plain_loop(spark):
    rnd = random.Random(2)
    rows = [(i, [(t, None if rnd.random() < 0.2 else u) for t, u in o]) for i, o in drawn(3) if len(o) > 1]
    df = spark.createDataFrame(rows, "id INT, obs ARRAY<STRUCT<elapsed_hours: INT, u: DOUBLE>>")
    df = df.withColumns({"lvl_before": F.expr("CAST(NULL AS STRUCT<n: BIGINT, dev: ARRAY<ARRAY<DOUBLE>>>)"), "has_now": F.lit(True), "as_of_hours": F.lit(400), "lot_size": F.lit(9), "floor": F.lit(1.0), "t_before": F.lit(7)})
    got = {r["id"]: r["step"] for r in layered(df, step_layers()).select("id", "step").collect()}
    for i, obs in rows:
        d, a, b = largest(obs)
        if d < 0:
            assert got[i]["reason"] == "INVALID_TRANSFORM_AT_INTERVAL"
        else:
            assert (got[i]["magnitude"], got[i]["t_prev"], got[i]["t_curr"]) == (d, a, b)


def test_methods_the_jvm_would_interpret_are_not_generated(spark):
    spark.conf.unset(HUGE_CONF)
    tel = [(f"C{i}", "L", "IDSS", t, 0.5 + 0.01 * i, "uA", "A", "CH", "VALID") for i in range(9) for t in (0, 24, 96, 168)]
    ddl = "component_id STRING, lot_id STRING, parameter_name STRING, elapsed_hours INT, value DOUBLE, unit STRING, instrument_id STRING, channel_id STRING, measurement_quality STRING"
    assert screen_parameters(spark.createDataFrame(tel, ddl), 168).count() == 36
    assert spark.conf.get(HUGE_CONF) == "8000"
    spark.conf.set(HUGE_CONF, "9000")  # a session's own choice stays
    compiled(spark)
    assert spark.conf.get(HUGE_CONF) == "9000"
    spark.conf.unset(HUGE_CONF)
