"""The SQL functions give what the column functions give."""

import pytest
from pyspark.sql import functions as F

from emberline.functions import scalars as S

PAIRS = [(None, None), (0.0, 0.0), (0.3, -1.0), (-2.5, 3.0), (8.0, 9.0), (float("nan"), 4.0), (1.5, float("inf")), (4.0, None)]


def test_sql_functions_equal_columns(spark):
    names = S.register_sql_functions(spark)
    assert len(names) == 9
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, a double, b double")
    both = df.select(
        "i",
        F.expr("el_score_drift(a, b)").alias("drift"), S.score_drift("a", "b").alias("drift_"),
        F.expr("el_score_equipment(a, b, 0.05)").alias("equipment"), S.score_equipment("a", "b", F.lit(0.05)).alias("equipment_"),
        F.expr("el_score_peer(a)").alias("peer"), S.score_peer("a").alias("peer_"),
        F.expr("el_transform('IGSS', a)").alias("u"), S.transform(F.lit("IGSS"), "a").alias("u_"),
    )
    for r in both.collect():
        for c in ("drift", "equipment", "peer", "u"):
            if c == "drift" and r.drift is None:
                assert r.drift_ is None
            else:
                assert r[c] == (None if r[f"{c}_"] is None else pytest.approx(r[f"{c}_"], abs=1e-9)), (r.i, c)


def test_sql_wilson(spark):
    S.register_sql_functions(spark)
    df = spark.createDataFrame([(0, 10), (10, 10), (3, 10), (0, 0), (499, 1000)], "k long, n long")
    low, high = S.wilson("k", "n")
    for r in df.select(F.expr("el_wilson_low(k, n)").alias("a"), F.expr("el_wilson_high(k, n)").alias("b"), low.alias("c"), high.alias("d")).collect():
        assert (r.a, r.b) == (pytest.approx(r.c, abs=1e-12), pytest.approx(r.d, abs=1e-12))
