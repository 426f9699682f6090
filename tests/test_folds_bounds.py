"""Fits that hardly differ: rows are taken fit by fit only where their interval meets what a pass looks for."""

import numpy as np
import pytest

from emberline.operators import folds


def drawn(rng, n, lots, fits, apart):
    lot = rng.integers(0, lots, n).astype(np.int32)
    x = np.stack([np.ones(n), rng.normal(3, 1, n), rng.normal(3, 1, n)], 1)
    y = x[:, 1] + rng.standard_t(2, n)
    coef = np.array([0.1, 0.9, 0.05]) + apart * rng.normal(0, 1, (1, fits, 3))
    return lot, x, y, coef


@pytest.mark.parametrize("apart", [0.0, 1e-3, 1.0])
def test_bounds_hold_every_value(apart):
    rng = np.random.default_rng(3)
    lot, x, y, coef = drawn(rng, 2000, 6, 15, apart)
    pairs = np.stack(np.triu_indices(6, 1), 1)
    at = np.zeros((6, 6), np.int64)
    at[pairs[:, 0], pairs[:, 1]] = at[pairs[:, 1], pairs[:, 0]] = np.arange(15)
    for values in (folds.FitResiduals(coef, pairs, 6), folds.NestedResiduals(coef, at)):
        for v in (values, folds.Distances(values, rng.normal(0, 0.1, (1, values.seen.shape[1])))):
            found = v(0, lot, x, y)
            low, high = v.bounds(0, x, y)
            assert (np.isnan(found) == ~v.seen[lot]).all()
            assert ((found >= low[:, None]) & (found <= high[:, None]) | np.isnan(found)).all()


def test_few_rows_are_taken_fit_by_fit():
    rng = np.random.default_rng(4)
    lot, x, y, coef = drawn(rng, 20_000, 6, 15, 1e-4)
    values = folds.FitResiduals(coef, np.stack(np.triu_indices(6, 1), 1), 6)
    v, m = values(0, lot, x, y), np.ones(20_000, np.int64)
    middle = np.nanmedian(v, 0)
    near, below = folds._asked(values, 0, lot, x, y, m, middle - 1e-3, middle + 1e-3)
    assert 0 < len(near) < 300
    assert (below + (v[near] < middle - 1e-3).sum(0) == (v < middle - 1e-3).sum(0)).all()


@pytest.mark.parametrize("shift", [0.0, 5.0])
def test_medians_of_all_fits(spark, shift):
    """Also where lots differ so much that leaving two out moves the median far, and where readings come again."""
    rng = np.random.default_rng(5)
    rows = [("a", f"L{i % 5}", float(a), float(b), float(np.round(a + shift * (i % 5) ** 2 + e, 2))) for i, (a, b, e) in enumerate(rng.normal(3, 1, (4000, 3)))]
    rows += rows[:700] * 2
    d = folds.design(spark.createDataFrame(rows, "parameter_name string, lot_id string, u0 double, u24 double, u168 double"))
    values = folds.FitResiduals(np.array([0.1, 0.9, 0.05]) + 1e-3 * rng.normal(0, 1, (1, 10, 3)), d.pairs, 5)
    lot = np.array([int(r[1][1:]) for r in rows])
    x, y = np.array([(1.0, r[2], r[3]) for r in rows]), np.array([r[4] for r in rows])
    v = values(0, lot, x, y)
    n = (~np.isnan(v)).sum(0)[None]
    first = folds._medians(d, values, n)
    assert first.value[0] == pytest.approx(np.nanmedian(v, 0), abs=1e-13)
    moved = folds.FitResiduals(values.coef + 1e-2, d.pairs, 5)
    again = folds._medians(d, folds.Distances(moved, first.value), n, first)
    assert again.value[0] == pytest.approx(np.nanmedian(np.abs(moved(0, lot, x, y) - first.value[0]), 0), abs=1e-13)
    s = folds._sums(d, moved, np.full((1, 10), 0.8), (1, 10))
    r = np.abs(moved(0, lot, x, y))
    w = np.where(np.isnan(r), 0, np.minimum(1, 0.8 / r))
    assert s[0, :, 0] == pytest.approx(w.sum(0)) and s[0, :, 8] == pytest.approx((w * (x[:, 2] * y)[:, None]).sum(0))
