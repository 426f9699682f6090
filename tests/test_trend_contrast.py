"""Breach rates on the raw coordinate against those on the leave-one-out excess."""

import random

from emberline.operators.trend import excess_versus_raw, loo_excess

HOURS = [0, 24, 96, 168]


def test_common_drift_breaches_raw_only(spark):
    """A drift all members of a lot share is in the raw slopes alone; one part's own drift is in both."""
    rng, rows = random.Random(4), []
    for lot in range(30):
        for c in range(5):
            rows += [(f"c{lot}_{c}", f"cal{lot}", "IDDQ", h, rng.gauss(0, 0.01)) for h in HOURS]
    for c in range(9):
        rows += [(f"s{c}", "shared", "IDDQ", h, 0.01 * h + rng.gauss(0, 0.001)) for h in HOURS]
        rows += [(f"o{c}", "own", "IDDQ", h, (0.01 * h if c == 0 else 0) + rng.gauss(0, 0.001)) for h in HOURS]
    df = spark.createDataFrame(rows, "component_id string, lot_id string, parameter_name string, elapsed_hours int, u double")
    lots = spark.createDataFrame([(f"cal{i}",) for i in range(30)], "lot_id string")
    (row,) = excess_versus_raw(loo_excess(df), lots, 0.05).collect()
    assert (row.n, row.k_excess, row.k_raw, row.k_both) == (18, 1, 10, 1)
    assert abs(row.gap - 9 / 18) < 1e-12 and row.low_raw < row.rate_raw < row.high_raw


def test_without_rows_or_reference(spark):
    empty = spark.createDataFrame([], "component_id string, lot_id string, parameter_name string, elapsed_hours int, u double")
    lots = spark.createDataFrame([], "lot_id string")
    assert excess_versus_raw(loo_excess(empty), lots).count() == 0
    rows = [(f"c{c}", "l", "IDDQ", h, float(c * h)) for c in range(3) for h in HOURS]
    (row,) = excess_versus_raw(loo_excess(spark.createDataFrame(rows, empty.schema)), lots).collect()
    assert (row.n, row.k_excess, row.k_raw) == (3, 0, 0)
