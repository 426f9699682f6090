"""Evaluation of forecasts and screens against labels (offline only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions.scalars import MAD_SCALE, inverse_transform
from emberline.operators.ranks import group_median, group_median_mad, group_quantiles
from emberline.operators.regression import SUMS, ridge_fit, ridge_sql, score, sums
from emberline.registry import REGISTRY, Registry

WINKLER_ALPHA = 0.1


def metric_aggs(y: str = "v168", p: str = "predicted", lo: str | None = "lower", hi: str | None = "upper") -> list:
    """H1, H2: counts, MAE, RMSE, bias and - with an interval - coverage, width, Winkler score."""
    e = F.col(p) - F.col(y)
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(p).isNotNull() & F.col(y).isNotNull()).alias("n_valid"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(e).alias("bias"),
    ]
    if lo and hi:
        l, h, t = F.col(lo), F.col(hi), F.col(y)
        miss = F.when(t < l, l - t).when(t > h, t - h).otherwise(0.0)
        aggs += [
            F.avg(((t >= l) & (t <= h)).cast("int")).alias("coverage"),
            F.avg(h - l).alias("width"),
            F.avg(h - l + 2.0 / WINKLER_ALPHA * miss).alias("winkler"),
        ]
    return aggs


def forecast_metrics(df: DataFrame, keys: Sequence[str] = (), **cols) -> DataFrame:
    return df.groupBy(*keys).agg(*metric_aggs(**cols))


def metrics_by(df: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]], **cols) -> DataFrame:
    """The same metrics over several grouping sets in one pass."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(*metric_aggs(**cols))


def fold_summary(scored: DataFrame, model: str = "model", fold: str = "lot_id") -> DataFrame:
    """H4: MAE per fold, then mean / population std / min / max over folds."""
    per = scored.groupBy("parameter_name", model, fold).agg(F.avg(F.abs(F.col("predicted") - F.col("v168"))).alias("m"))
    return per.groupBy("parameter_name", model).agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("m").alias("mae_mean"), F.stddev_pop("m").alias("mae_std"), F.min("m").alias("mae_min"), F.max("m").alias("mae_max")
    )


TIERS = (("TIER_1_POINT_MAE", "mae"), ("TIER_2_UNCERTAINTY_WINKLER", "winkler"), ("TIER_3_FOLD_STABILITY", "mae_std"))
LAST_TIER = "TIER_4_DETERMINISTIC_DEFAULT"


def model_evidence(scored: DataFrame, model: str = "model", fold: str = "lot_id") -> DataFrame:
    """parameter_name, model, mae and winkler over all held-out rows, mae_std over folds; combined per task."""
    per = scored.groupBy("parameter_name", model, fold).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(F.col("predicted") - F.col("v168"))).alias("e"), F.sum(_winkler()).alias("w")
    )
    return per.groupBy("parameter_name", F.col(model).alias("model")).agg(
        (F.sum("e") / F.sum("n")).alias("mae"), (F.sum("w") / F.sum("n")).alias("winkler"), F.stddev_pop(F.col("e") / F.col("n")).alias("mae_std")
    )


def _winkler() -> Column:
    y, lo, hi = F.col("v168"), F.col("lower"), F.col("upper")
    return hi - lo + 20.0 * F.when(y < lo, lo - y).when(y > hi, y - hi).otherwise(0.0)


def select_by_tiers(evidence: DataFrame, default: str, tolerance: float = 0.005, quorum: int = 3) -> DataFrame:
    """H6: one model per parameter by a cascade over any number of models, and the family they agree on.

    At each tier the models whose metric is within ``tolerance`` of the best one stay; the first tier that leaves one
    decides, and what is still tied after the last goes to ``default``. relative_gap is that of the best two at the
    deciding tier. consensus is the model that ``quorum`` parameters chose, else SPLIT. A model without a metric is out
    at that tier unless none has it.
    """
    metrics = [m for _, m in TIERS]
    c = evidence.groupBy("parameter_name").agg(F.array_sort(F.collect_list(F.struct("model", *metrics))).alias("c0"))
    for k, m in enumerate(metrics):
        best = f"array_min(transform(c{k}, x -> x.{m}))"
        c = c.withColumn(f"b{k}", F.expr(best))
        c = c.withColumn(f"c{k + 1}", F.expr(f"IF(b{k} IS NULL OR b{k} <= 1e-12, c{k}, filter(c{k}, x -> x.{m} <= b{k} * (1 + {tolerance}D)))"))
        c = c.withColumn(f"g{k}", F.expr(f"IF(b{k} > 1e-12, get(array_sort(transform(filter(c{k}, x -> x.{m} IS NOT NULL), x -> x.{m})), 1) / b{k} - 1, 0D)"))
    left = f"c{len(metrics)}"
    choice = F.expr(f"IF(exists({left}, x -> x.model = '{default}'), '{default}', {left}[0].model)")
    tier, gap = F.lit(LAST_TIER), F.lit(0.0)
    for k in reversed(range(len(metrics))):
        sole = F.size(f"c{k + 1}") == 1
        choice, tier, gap = F.when(sole, F.col(f"c{k + 1}")[0]["model"]).otherwise(choice), F.when(sole, TIERS[k][0]).otherwise(tier), F.when(sole, F.coalesce(f"g{k}", F.lit(0.0))).otherwise(gap)
    out = c.select("parameter_name", choice.alias("choice"), tier.alias("tier"), gap.alias("relative_gap"))
    wins = out.groupBy("choice").agg(F.count(F.lit(1)).alias("n"))
    agreed = wins.agg(F.coalesce(F.max(F.when(F.col("n") >= quorum, F.col("choice"))), F.lit("SPLIT")).alias("consensus"))
    return out.crossJoin(F.broadcast(agreed))  # one row


def confusion(pred: DataFrame, labels: DataFrame) -> DataFrame:
    """Flagged components against component labels (any over rows)."""
    lab = labels.groupBy("component_id").agg(F.bool_or("is_defective").alias("defective"))
    flg = pred.groupBy("component_id").agg(F.bool_or("flagged").alias("flagged"))
    j = lab.join(flg, "component_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    out = j.agg(
        F.count_if(F.col("flagged") & F.col("defective")).alias("tp"),
        F.count_if(F.col("flagged") & ~F.col("defective")).alias("fp"),
        F.count_if(~F.col("flagged") & F.col("defective")).alias("fn"),
        F.count_if(~F.col("flagged") & ~F.col("defective")).alias("tn"),
    )
    return with_rates(out)


def with_rates(df: DataFrame) -> DataFrame:
    def ratio(a, b):
        return F.when(b > 0, a / b)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns(
        {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn)}
    )


def cost_curve(counts: DataFrame, ratios=(1, 2, 5, 10, 20, 50)) -> DataFrame:
    """L(r) = r FN + FP of the screen and of the limits alone, per component, and their quotient.

    ``counts``: tp, fp, fn, tn of the screen and static_fp, static_fn of the absolute limits on the same components.
    A screen without cost has no quotient.
    """
    r = counts.withColumn("ratio", F.explode(F.array(*[F.lit(int(x)) for x in ratios])))
    n = F.greatest(F.lit(1), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    r = r.withColumns({"cost": F.col("ratio") * F.col("fn") + F.col("fp"), "static_cost": F.col("ratio") * F.col("static_fn") + F.col("static_fp")})
    return r.withColumns({"normalised": F.col("cost") / n, "static_normalised": F.col("static_cost") / n, "reduction": F.try_divide("static_cost", "cost")})


def residual_quantiles(df: DataFrame, keys, value: str, probs=(0.25, 0.5, 0.75, 0.9, 0.95, 0.99), skewed: bool | None = None) -> DataFrame:
    q = group_quantiles(df, keys, value, probs, skewed)
    return q.select(*keys, "n", *[F.col("q")[i].alias(f"q{round(p * 100)}") for i, p in enumerate(probs)])


def top_errors(df: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """H9: the k largest errors per key; the rank limit is applied in every task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc("abs_error"), "component_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lot_part(parts: int, lot: str = "lot_id") -> Column:
    """Part 0 .. parts - 1 of a lot by its name's hash: no ranking of lots, and a new lot moves no other."""
    return (F.conv(F.substring(F.md5(F.col(lot).cast("binary")), 1, 8), 16, 10).cast("bigint") % parts).cast("int")


def held_out_target(tri: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """Level and drift as ridge targets, fitted on the calibration lots and scored in units on the others.

    Both fits penalise the intercept. Columns: MAE, RMSE and median error of either target, the relative difference
    of the MAE in percent and the better target.
    """
    t = tri.withColumns({"dy": F.col("u168") - F.col("u24"), "part": lot_part(2)})
    fit, rest = t.where("part = 0"), t.where("part = 1")
    drift = ridge_fit(fit, penalise_intercept=True, y="dy").select("parameter_name", *[F.col(c).alias(f"r{c}") for c in ("b0", "b1", "b2")])
    j = score(rest, ridge_fit(fit, penalise_intercept=True)).join(drift, "parameter_name")
    j = j.withColumn("u_drift", F.expr("u24 + rb0 + rb1 * u0 + rb2 * u24"))
    j = j.withColumns({n: F.abs(inverse_transform("parameter_name", u, reg) - F.col("v168")) for n, u in (("e_direct", "u_hat"), ("e_relative", "u_drift"))})
    out = j.groupBy("parameter_name").agg(
        F.count(F.lit(1)).alias("n"),
        *[f(F.col(f"e_{k}")).alias(f"{m}_{k}") for k in ("direct", "relative") for m, f in (("mae", F.avg), ("rmse", lambda c: F.sqrt(F.avg(c * c))))],
    )
    for k in ("direct", "relative"):
        out = out.join(group_median(j, ["parameter_name"], f"e_{k}", f"medae_{k}").drop("n"), "parameter_name")
    gap = 100.0 * F.try_divide(F.col("mae_relative") - F.col("mae_direct"), F.greatest(F.col("mae_direct"), F.lit(1e-9)))
    return out.withColumn("mae_gap_pct", gap).withColumn("better", F.when(F.col("mae_gap_pct") <= 0, "relative_delta").otherwise("direct_level"))


def lambda_sweep(tri: DataFrame, folds: int = 5, points: int = 50, low: float = -3.0, high: float = 3.0, reg: Registry = REGISTRY, extra: Sequence[float] = ()) -> DataFrame:
    """Held-out MAE in units per parameter and lambda, averaged over lot-grouped folds; the intercept is penalised.

    Coefficients come from the sums of the other folds: parameters x folds x points rows, a bounded table that is
    broadcast; each task reduces its rows to one error sum per coefficient row before the shuffle.
    """
    t = tri.withColumn("fold", lot_part(folds))
    per = t.groupBy("parameter_name", "fold").agg(*sums())
    tot = per.groupBy("parameter_name").agg(*[F.sum(c).alias(f"t_{c}") for c in SUMS])
    step = (high - low) / (points - 1)
    rest = per.join(tot, "parameter_name").select("parameter_name", "fold", *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in SUMS]).where("n > 0")
    grid = rest.withColumn("lam", F.explode(F.array(*[F.lit(10.0 ** (low + i * step)) for i in range(points)], *map(F.lit, extra))))
    coef = grid.withColumns({k: F.expr(v) for k, v in ridge_sql("lam", True).items()}).select("parameter_name", "fold", "lam", "b0", "b1", "b2")
    j = t.select("parameter_name", "fold", "u0", "u24", "v168").join(F.broadcast(coef), ["parameter_name", "fold"])
    e = F.abs(inverse_transform("parameter_name", F.expr("b0 + b1 * u0 + b2 * u24"), reg) - F.col("v168"))
    per_fold = j.groupBy("parameter_name", "lam", "fold").agg(F.avg(e).alias("mae"))
    return per_fold.groupBy("parameter_name", "lam").agg(F.avg("mae").alias("cv_mae"), F.count(F.lit(1)).alias("folds"))


def lambda_choice(tri: DataFrame, locked: float = 1.0, **grid) -> DataFrame:
    """Per parameter the best lambda of the sweep (the smallest of equals), its error, that of the locked one, and
    the gap between them in per cent."""
    sweep = lambda_sweep(tri, extra=(locked,), **grid)
    own = F.col("lam") == locked
    best = sweep.groupBy("parameter_name").agg(
        F.min(F.when(~own, F.struct(F.col("cv_mae"), F.col("lam")))).alias("b"), F.max(F.when(own, F.col("cv_mae"))).alias("locked_mae")
    )
    gap = 100.0 * (F.col("locked_mae") - F.col("b.cv_mae")) / F.greatest(F.lit(1e-9), F.col("b.cv_mae"))
    return best.select(
        "parameter_name", F.col("b.lam").alias("optimal_lambda"), F.col("b.cv_mae").alias("optimal_mae"), "locked_mae", gap.alias("gap_pct"), (gap <= 0.5).alias("within_half_percent")
    )


def separation(df: DataFrame, distance: str, defective: str, flagged: str) -> DataFrame:
    """One row: mean distance of nominal and defective rows, their ratio, the contingency, precision and recall."""
    d, bad, hit = F.col(distance), F.col(defective), F.col(flagged)
    g = df.where(d.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.avg(F.when(~bad, d)), F.lit(0.0)).alias("mean_nominal"),
        F.coalesce(F.avg(F.when(bad, d)), F.lit(0.0)).alias("mean_defective"),
        *[F.count_if(c).alias(n) for n, c in (("tp", bad & hit), ("fp", ~bad & hit), ("fn", bad & ~hit), ("tn", ~bad & ~hit))],
    )
    none = F.lit(0.0)
    return g.withColumns(
        {
            "separation_ratio": F.col("mean_defective") / F.greatest(F.lit(1e-9), F.col("mean_nominal")),
            "precision": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), none),
            "recall": F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), none),
        }
    )


def regime_coverage(tri: DataFrame, target: float = 0.9, skewed: bool | None = None) -> DataFrame:
    """One quantile for all against one per regime, calibrated on one half of the lots, covered on the other.

    Regimes split at the calibration median of |u24 - u0|. Coverage is over all held-out rows and over the moving
    ones; without moving rows the latter is null.
    """
    t = tri.withColumns({"part": lot_part(2), "move": F.abs(F.col("u24") - F.col("u0"))})
    cal = t.where("part = 0")
    t = score(t, ridge_fit(cal, penalise_intercept=True)).withColumn("e", F.abs(F.col("u168") - F.col("u_hat")))
    tau = group_median(cal, ["parameter_name"], "move", "tau", skewed).drop("n")
    t = t.join(tau, "parameter_name").withColumn("regime", F.when(F.col("move") <= F.col("tau"), "QUIET").otherwise("MOVING"))
    fit = t.where("part = 0")
    every = group_quantiles(fit, ["parameter_name"], "e", [target], skewed).select("parameter_name", F.col("q")[0].alias("q_global"))
    own = group_quantiles(fit, ["parameter_name", "regime"], "e", [target], skewed).groupBy("parameter_name").agg(
        *[F.max(F.when(F.col("regime") == r, F.col("q")[0])).alias(f"q_{r.lower()}") for r in ("QUIET", "MOVING")]
    )
    j = t.where("part = 1").join(every, "parameter_name").join(own, "parameter_name")
    moving = F.col("regime") == "MOVING"
    hit = lambda q: (F.col("e") <= q).cast("int")
    mine = F.when(moving, F.col("q_moving")).otherwise(F.col("q_quiet"))
    return j.groupBy("parameter_name").agg(
        F.count(F.lit(1)).alias("n"), F.max("tau").alias("tau"), *[F.max(c).alias(c) for c in ("q_global", "q_quiet", "q_moving")],
        F.avg(hit(F.col("q_global"))).alias("uniform_all"), F.avg(F.when(moving, hit(F.col("q_global")))).alias("uniform_moving"),
        F.avg(hit(mine)).alias("regime_all"), F.avg(F.when(moving, hit(F.col("q_moving")))).alias("regime_moving"),
    )


def sensor_enrichment(cells: DataFrame, labels: DataFrame, cuts=(10, 20, 50, 100, 150), z_limit: float = 3.5, max_missing: float = 0.5, min_mad: float = 1e-6, skewed: bool | None = None) -> DataFrame:
    """Rows ranked by robust sensor excess; failures among the top k and their lift.

    Missing cells take the sensor median, i.e. Z = 0: they are counted in the row's mean but need
    no imputed row.
    """
    size = cells.groupBy("sensor_id").agg(F.count(F.lit(1)).alias("rows"), F.count("value").alias("have"))
    stat = group_median_mad(cells, ["sensor_id"], "value", skewed)
    good = stat.join(size, "sensor_id").where((F.col("mad") > min_mad) & (1.0 - F.col("have") / F.col("rows") <= max_missing))
    n_sensors = good.agg(F.count(F.lit(1)).alias("n_sensors"))
    z = F.abs(F.coalesce("value", "median") - F.col("median")) / (MAD_SCALE * F.col("mad"))
    rows = cells.join(good.select("sensor_id", "median", "mad"), "sensor_id").withColumn("z", z).groupBy("row_id").agg(
        F.count_if(F.col("z") >= z_limit).alias("n_excess"), F.sum(F.col("z") * F.col("z")).alias("zz")
    )
    rows = rows.crossJoin(F.broadcast(n_sensors)).withColumn("rms", F.round(F.sqrt(F.col("zz") / F.col("n_sensors")), 9))
    lab = rows.join(labels, "row_id")
    base = lab.agg(F.count(F.lit(1)).alias("total"), F.sum("is_failure").alias("failures"))
    top = lab.orderBy(F.desc("n_excess"), F.desc("rms"), "row_id").limit(max(cuts))
    ranked = top.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n_excess"), F.desc("rms"), "row_id")))
    hits = ranked.withColumn("k", F.explode(F.array(*[F.lit(int(c)) for c in cuts]))).where("rk <= k").groupBy("k").agg(F.sum("is_failure").alias("hits"))
    return hits.crossJoin(F.broadcast(base)).select(
        "k", "hits", (F.col("hits") / F.col("k")).alias("precision"), F.try_divide(F.col("hits") / F.col("k"), F.try_divide("failures", "total")).alias("lift")
    )


def regime_occupancy(df: DataFrame, by: str, regimes: Sequence[str]) -> DataFrame:
    """Members of each regime per group, and their share."""
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("regime") == r).alias(r.lower()) for r in regimes])
    return out.withColumns({f"{r.lower()}_pct": 100.0 * F.col(r.lower()) / F.col("n") for r in regimes})
