"""Signs of differences that are zero but for the last bit of a logarithm."""

import math
from types import SimpleNamespace

import pytest

from emberline.operators.represent import with_u
from emberline.operators.trend import trend_screen, trend_statistics
from emberline.plans import trend_queries as Q

SCHEMA = "component_id string, lot_id string, parameter_name string, elapsed_hours int, value double"


def test_signs_of_ratio_ties_are_those_of_the_c_library(spark, monkeypatch):
    """A reading as many times its peers' at 24 h as at 0 h has no excess drift: what is left is the rounding of the logarithms."""
    ratios = [(a, b, m, k) for a in range(3, 11) for b in range(3, 11) for m in (1.7, 2.3, 4.1) for k in (3, 5, 7) if a != b]
    rows, tau = [], {}
    for i, (a, b, m, k) in enumerate(ratios):
        readings = {0: (a * m, b * m), 24: (k * a * m, k * b * m)}
        e = [math.log(v) - math.log(peer) for v, peer in readings.values()]
        tau[f"c{i}"] = float((e[1] > e[0]) - (e[1] < e[0]))
        for h, (v, peer) in readings.items():
            rows += [(c, f"l{i}", "RDS(on)", h, x) for c, x in ((f"c{i}", v), (f"p{i}", peer), (f"q{i}", peer))]
    monkeypatch.setattr(Q, "A", SimpleNamespace(telemetry_parts=lambda s, d: spark.createDataFrame(rows, SCHEMA)))
    got = {r.component_id: r.tau for r in Q.kendall_tau(spark, "").collect() if r.component_id in tau}
    assert got == tau


def test_last_bit_values_and_domain(spark):
    xs = [-1e200, -3.5, -0.0, 0.0, 1e-9, 0.7, 44.25, 1e200]
    rows = [(f"{p}{i}", "l", p, 0, x) for p in ("IDSS", "IGSS", "VGS(th)", "other") for i, x in enumerate([*xs, float("nan"), float("inf"), None])]
    exact = {"IDSS": lambda x: math.log(x) if x > 0 else None, "IGSS": math.asinh, "VGS(th)": lambda x: x, "other": lambda x: None}
    for r in with_u(spark.createDataFrame(rows, SCHEMA), last_bit=True).collect():
        sound = r.value is not None and math.isfinite(r.value)
        assert r.u == (exact[r.parameter_name](r.value) if sound else None) and r.domain_ok == (r.u is not None)


def test_ols_t_of_a_level_series(spark):
    """0 / 0 where all excesses are equal, as the SQL has it; a number where they are not."""
    u = {"level": [0.1] * 4, "three": [0.1] * 3, "two": [0.1] * 2, "moved": [0.1, 0.1, 0.2, 0.1]}
    rows = [(c, "l", "VGS(th)", h, x) for c, xs in u.items() for h, x in zip((0, 24, 96, 168), xs)]
    df = spark.createDataFrame(rows, "component_id string, lot_id string, parameter_name string, elapsed_hours int, excess double")
    got = {r.component_id: r.ols_t for r in trend_statistics(df).collect()}
    assert math.isnan(got["level"]) and math.isnan(got["three"]) and got["two"] is None
    assert got["moved"] == pytest.approx(0.304997, abs=1e-6)


def test_a_series_without_reference_stays_in_the_screen(spark):
    """No reference series has two points: p is (1 + 0) / (1 + 0), and the series keeps its row."""
    rows = [(f"{lot}{c}", lot, "VGS(th)", h, 2.0 + 0.01 * ((c * (h + 7)) % 5)) for lot in ("cal", "obs") for c in range(5) for h in (0, 24, 96)]
    rows = [(c, lot, p, h, v, v) for c, lot, p, h, v in rows if not (c == "obs3" and h == 96)]
    df = spark.createDataFrame(rows, "component_id string, lot_id string, parameter_name string, elapsed_hours int, value double, u double")
    got = {r.component_id: r for r in trend_screen(df, spark.createDataFrame([("cal",)], "lot_id string")).collect()}
    assert sorted(got) == [f"obs{c}" for c in range(5)]
    assert (got["obs3"].k, got["obs3"].p, got["obs3"].reject) == (2, 1.0, False)
