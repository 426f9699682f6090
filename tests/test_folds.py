"""Fits without lots, model selection and cross-fitted trees against plain single-machine versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.functions.scalars import MAD_SCALE
from emberline.operators import boosting, evaluation, folds, regression
from emberline.plans.prognostic_queries import FEATS, residual_rows
from emberline.registry import REGISTRY

FLOOR = {p.name: p.floor for p in REGISTRY.parameters}


@pytest.fixture(scope="module")
def triads(spark):
    rng = np.random.default_rng(3)
    rows = []
    for p, n in (("VGS(th)", 60), ("IGSS", 40)):
        for i in range(n):
            u0 = rng.normal(3, 1)
            u24 = u0 + rng.normal(0, 0.2)
            u168 = 0.3 + 0.4 * u0 + 0.6 * u24 + rng.standard_t(2) * 0.1
            rows.append((f"c{i}", f"L{i % 5}" if i % 31 else "alone", p, u0, u24, u168, u0, u24, u168))
    rows.append(("bad", "L1", "IGSS", float("nan"), 1.0, 1.0, 1.0, 1.0, 1.0))
    rows.append(("none", None, "IGSS", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0))
    return spark.createDataFrame(rows, "component_id string, lot_id string, parameter_name string, u0 double, u24 double, u168 double, v0 double, v24 double, v168 double")


def huber(x, y, floor):
    a = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([0.0, 1.0, 1.0])
    b = np.linalg.solve(a.T @ a + penalty, a.T @ y)
    for _ in range(50):
        r = y - a @ b
        delta = 1.345 * max(MAD_SCALE * np.median(abs(r - np.median(r))), floor)
        w = np.where(abs(r) <= delta, 1, delta / np.maximum(abs(r), 1e-12))
        new = np.linalg.solve((a.T * w) @ a + penalty, a.T @ (w * y))
        moved, b = np.abs(new - b).max(), new
        if moved < 1e-6:
            break
    return b


def test_huber_without_a_lot(spark, triads, monkeypatch):
    """Coefficients, and interval scales from the models without two lots, equal a loop over lots and pairs of lots."""
    monkeypatch.setattr(folds, "LEFT", 8)  # so that brackets are narrowed
    monkeypatch.setattr(folds, "STEPS", 8)
    found = {(r.parameter_name, r.lot_id): r for r in folds.held_out_coefficients(folds.design(triads), "huber").collect()}
    t = triads.where("lot_id IS NOT NULL AND NOT isnan(u0)").toPandas()
    assert len(found) == t.groupby(["parameter_name"]).ngroups * t.lot_id.nunique()
    for (p, lot), r in found.items():
        rest = t[(t.parameter_name == p) & (t.lot_id != lot)]
        assert (r.b0, r.b1, r.b2) == pytest.approx(tuple(huber(rest[["u0", "u24"]].to_numpy(), rest.u168.to_numpy(), FLOOR[p])), abs=1e-8)
        residuals = []
        for inner in rest.lot_id.unique():
            fit, judged = rest[rest.lot_id != inner], rest[rest.lot_id == inner]
            b = huber(fit[["u0", "u24"]].to_numpy(), fit.u168.to_numpy(), FLOOR[p])
            residuals += list(judged.u168 - b[0] - b[1] * judged.u0 - b[2] * judged.u24)
        scale = max(MAD_SCALE * np.median(np.abs(np.array(residuals) - np.median(residuals))), FLOOR[p])
        assert r.sigma_eff == pytest.approx(scale, abs=1e-9) and r.converged


def test_diverged_forecasts_have_no_width(spark):
    rows = [("IGSS", 1.0, 2.0, 7.0, 0.0, 1.0, 1.0, 0.1), ("IGSS", 1.0, 2.0, 7.0, 50.0, 1.0, 1.0, 0.1), ("IDSS", 1.0, 2.0, 7.0, float("nan"), 1.0, 1.0, 0.1)]
    df = spark.createDataFrame(rows, "parameter_name string, u0 double, u24 double, v24 double, b0 double, b1 double, b2 double, sigma_eff double")
    a, b, c = folds.bounded_forecast(df).collect()
    assert a.predicted == pytest.approx(np.sinh(3)) and a.lower < a.predicted < a.upper and not a.divergent
    assert [(r.predicted, r.lower, r.upper, r.divergent) for r in (b, c)] == [(7.0, 7.0, 7.0, True)] * 2


def test_tiers(spark):
    rows = [
        ("a", "ridge", 1.0, 5.0, 0.1), ("a", "huber", 1.2, 1.0, 0.1), ("a", "third", 1.1, 1.0, 0.1),
        ("b", "ridge", 1.0, 5.0, 0.1), ("b", "huber", 1.001, 4.0, 0.1), ("b", "third", 1.002, 4.5, 0.1),
        ("c", "ridge", 1.0, 5.0, 0.2), ("c", "huber", 1.001, 5.01, 0.1), ("c", "third", 3.0, 1.0, 0.0),
        ("d", "ridge", 1.0, 5.0, 0.1), ("d", "huber", 1.0, 5.0, 0.1), ("d", "third", 2.0, 5.0, 0.1),
        ("e", "ridge", 0.0, None, 0.0), ("e", "huber", 0.0, None, 0.0), ("e", "third", 0.0, None, 0.0),
    ]
    got = {r.parameter_name: r for r in evaluation.select_by_tiers(spark.createDataFrame(rows, "parameter_name string, model string, mae double, winkler double, mae_std double"), "ridge").collect()}
    assert {k: (r.choice, r.tier[:6]) for k, r in got.items()} == {"a": ("ridge", "TIER_1"), "b": ("huber", "TIER_2"), "c": ("huber", "TIER_3"), "d": ("ridge", "TIER_4"), "e": ("ridge", "TIER_4")}
    assert got["a"].relative_gap == pytest.approx(0.1) and got["b"].relative_gap == pytest.approx(0.125) and got["a"].consensus == "ridge"
    split = evaluation.select_by_tiers(spark.createDataFrame(rows[3:9], "parameter_name string, model string, mae double, winkler double, mae_std double"), "ridge").collect()
    assert {r.consensus for r in split} == {"SPLIT"}


def test_variants_against_a_loop(spark):
    rng = np.random.default_rng(8)
    features = sorted({f for fs, _ in regression.VARIANTS.values() for f in fs})
    rows = [("VGS(th)", f"L{i % 4}", *map(float, rng.normal(size=len(features))), float(rng.normal())) for i in range(60)]
    df = spark.createDataFrame(rows, "parameter_name string, lot_id string, " + ", ".join(f"{f} double" for f in features) + ", u168 double")
    df = df.withColumns({"delta_u": F.col("u168") - F.col("u24"), "v24": F.col("u24"), "v168": F.col("u168")})
    got = {r.variant: (r.n, r.mae) for r in regression.variant_errors(df).collect()}
    t = df.toPandas()
    for name, (fs, target) in regression.VARIANTS.items():
        errors = []
        for lot in t.lot_id.unique():
            fit, held = t[t.lot_id != lot], t[t.lot_id == lot]
            a = np.column_stack([np.ones(len(fit)), fit[list(fs)]])
            b = np.linalg.solve(a.T @ a + np.diag([0.0] + [1.0] * len(fs)), a.T @ fit[target])
            u = b[0] + held[list(fs)] @ b[1:] + (held.u24 if target == "delta_u" else 0)
            errors += list(abs(u - held.u168))
        assert got[name] == (60, pytest.approx(np.mean(errors), abs=1e-9))


def grown(codes, y, iterations, depth, rate, least, l2):
    """Boosted trees by plain recursion over binned features; returns a predictor."""
    trees, start = [], y.mean()

    def build(at, r, level):
        leaf = rate * r[at].sum() / (at.sum() + l2)
        best = (1e-12, None)
        if level < depth:
            for j in range(codes.shape[1]):
                for b in range(boosting.BINS):
                    left, right = at & (codes[:, j] <= b), at & (codes[:, j] > b)
                    if min(left.sum(), right.sum()) >= least:
                        gain = sum(r[s].sum() ** 2 / (s.sum() + l2) for s in (left, right)) - r[at].sum() ** 2 / (at.sum() + l2)
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (j, b))
        if best[1] is None:
            return leaf
        j, b = best[1]
        return j, b, build(at & (codes[:, j] <= b), r, level + 1), build(at & (codes[:, j] > b), r, level + 1)

    def value(tree, row):
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    now = np.full(len(y), start)
    for _ in range(iterations):
        trees.append(build(np.ones(len(y), bool), y - now, 0))
        now = now + [value(trees[-1], row) for row in codes]
    return lambda row: start + sum(value(t, row) for t in trees)


def test_trees_against_recursion(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    y = np.where(x[:, 0] > 0.3, 2.0, -1.0) + 0.5 * x[:, 1] + rng.normal(size=240) * 0.1
    rows = [("a", f"L{i % 12}", *map(float, x[i]), float(y[i])) for i in range(240)]
    rows += [("a", "L1", None, 1.0, 1.0), ("a", "L2", 0.1, 0.2, None), ("a", None, 0.1, 0.2, 1.0)]
    df = spark.createDataFrame(rows, "parameter_name string, lot_id string, f double, g double, y double")
    got = boosting.cross_fitted(df, ["f", "g"], "y", folds=3, iterations=4, least=5).collect()
    assert len(got) == len(rows)
    by = {(r.f, r.g): r.delta_hat for r in got if r.lot_id is not None and r.f is not None}
    assert all(r.delta_hat is None for r in got if r.f is None or r.lot_id is None) and by[0.1, 0.2] is not None
    every = np.vstack([x, [0.1, 0.2]])
    edges = [np.quantile(every[:, j], [i / boosting.BINS for i in range(1, boosting.BINS)]) for j in range(2)]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(2)], 1)
    group = {r.lot_id: r.g3 for r in df.where("lot_id IS NOT NULL").select("lot_id", F.pmod(F.xxhash64("lot_id"), F.lit(3)).alias("g3")).distinct().collect()}
    own = np.array([group[f"L{i % 12}"] for i in range(240)])
    for m in range(3):
        model = grown(codes[own != m], y[own != m], 4, 3, 0.05, 5, 1.0)
        for i in np.flatnonzero(own == m):
            assert by[tuple(x[i])] == pytest.approx(model(codes[i]), abs=1e-9)


def test_trees_beat_carry_forward(spark):
    """Held-out trees are no worse than carrying the 24 h reading forward, in representation space."""
    rows = residual_rows(spark, "/root/testdata/sf0.01")
    got = boosting.cross_fitted(rows, FEATS, "delta_u", iterations=10)
    for r in got.groupBy("parameter_name").agg(F.avg(F.abs(F.col("delta_hat") - F.col("delta_u"))).alias("trees"), F.avg(F.abs("delta_u")).alias("carry")).collect():
        assert r.trees < r.carry


def test_median_between_two_often_repeated_values(spark):
    """Equal rows are kept once, and the search ends where both middle ranks lie in values with more rows than a bracket may hold."""
    rows = [("IGSS", f"L{i % 2}", 0.0, 0.0, float(v)) for v, n in ((0.0, 10), (1.0, 190), (2.0, 190), (9.0, 10)) for i in range(n)]
    d = folds.design(spark.createDataFrame(rows, "parameter_name string, lot_id string, u0 double, u24 double, u168 double"))

    def plain(p, lot, x, y):
        return y[:, None]

    assert d.rows.count() == 8
    found = folds._medians(d, plain, np.array([[400]]))
    assert found.value[0, 0] == 1.5 and found.width[0, 0] > 0
