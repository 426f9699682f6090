"""Boosted trees from cells: rows of equal bins once, and a pass that does not begin with the first tree."""

import numpy as np
import pytest

from emberline.operators import boosting as B


def test_rows_of_equal_bins_are_one_cell(spark):
    rows = [(i, 0, i % 2, bytes([i % 3, 1]), float(i)) for i in range(600)] + [(600, 0, 0, bytes([0, 1]), float("nan"))]
    df = spark.createDataFrame(rows, "__id long, p int, grp int, codes binary, y double")
    got = {(r.grp, bytes(r.codes)): (r.n, r.s) for r in B._cells(df).collect()}
    assert got == {(g, bytes([c, 1])): (100, float(sum(i for i in range(600) if i % 2 == g and i % 3 == c))) for g in range(2) for c in range(3)}


@pytest.mark.parametrize("depth", [1, 3, 5])
def test_scores_are_those_of_walked_trees(depth):
    rng = np.random.default_rng(depth)
    codes = rng.integers(0, B.BINS, (3, 500)).astype(np.uint8)
    trees = []
    for _ in range(23):
        feature = rng.integers(-1, 3, (1, 1, 2 << depth))
        trees.append(B.Tree(feature, rng.integers(0, B.BINS, feature.shape), rng.standard_normal(feature.shape)))
    walked = sum(t.value[0, 0, B._node(t, 0, 0, codes, depth)] for t in trees)
    assert B._scorer(trees, 0, 0, depth, 3)(codes) == pytest.approx(walked, abs=1e-12)


def test_a_pass_evaluates_the_trees_since_the_last_rest(spark, monkeypatch):
    """Far fewer trees are evaluated in a pass than were grown, and the forecasts are the same."""
    rows = [("a", f"L{i % 9}", float(i % 17), float(i % 5), float(i % 17 % 4 + i % 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "parameter_name string, lot_id string, f double, g double, y double")
    seen, summer = [], B._summer

    def told(recent, *rest):
        seen.append(len(recent))
        return summer(recent, *rest)

    monkeypatch.setattr(B, "_summer", told)
    got = []
    for rest in (2, 100):
        seen.clear()
        monkeypatch.setattr(B, "REST", rest)
        got.append({(r.lot_id, r.f, r.g): r.delta_hat for r in B.cross_fitted(df, ["f", "g"], "y", folds=3, iterations=7).collect()})
        assert max(seen) == min(rest - 1, 6) and len(seen) == 7 * 3
    assert got[0] == pytest.approx(got[1], abs=1e-9)
