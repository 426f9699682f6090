"""Scalar expressions against the standard library."""

import math

import pytest
from pyspark.sql import functions as F

from emberline.functions import scalars as SC


def test_negative_readings_transform_as_exactly_as_positive_ones(spark):
    xs = [(-4.0 + k / 7) * 26.0 + 0.5 for k in range(57)] + [-1e200, -1e8, -1e-9, 0.0, 1e-9, 1e200]
    df = spark.createDataFrame([("IGSS", x) for x in xs], "p string, x double")
    for r in df.select("x", SC.transform("p", "x").alias("u"), SC.transform("p", -F.col("x")).alias("m")).collect():
        assert r["u"] == pytest.approx(math.asinh(r["x"]), rel=3e-16)
        assert r["m"] == -r["u"]


def test_erf_of_all_magnitudes(spark):
    df = spark.createDataFrame([(k / 37,) for k in range(-240, 241)], "x double")
    for r in df.select("x", SC.erf_abs("x").alias("e")).collect():
        assert r["e"] == pytest.approx(math.erf(abs(r["x"])), abs=1e-9)  # 60 terms at |x| = 5
