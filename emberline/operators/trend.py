"""Null-calibrated trend inference over leave-one-out excess coordinates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.functions import series as S
from emberline.functions.scalars import MAD_SCALE, wilson
from emberline.operators.loo import with_loo
from emberline.operators.ranks import count_at_least, group_median_mad, group_quantiles, pick_ranks
from emberline.operators.represent import SERIES, trajectories
from emberline.registry import REGISTRY, Registry
from emberline.session import cut

LOT_T = ["lot_id", "parameter_name", "elapsed_hours"]


def loo_excess(df: DataFrame, skewed: bool | None = None) -> DataFrame:
    """K1: ``excess`` = u minus the median of the other members of its lot at that checkpoint."""
    out = with_loo(df.where(F.col("u").isNotNull()), LOT_T, "u", skewed=skewed)
    return out.withColumn("excess", F.col("u") - F.col("loo_med")).where(F.col("excess").isNotNull())


def trend_statistics(df: DataFrame, value: str = "excess") -> DataFrame:
    """K2-K4: Kendall tau, Theil-Sen slope and OLS t of each series against time."""
    t = trajectories(df, value).where(F.size("pts") >= 2)
    pts = F.col("pts")
    return t.select(
        *SERIES, F.size("pts").alias("k"), S.kendall_tau(pts).alias("tau"), S.theil_sen(pts).alias("slope"), S.ols_t(pts).alias("ols_t")
    )


def endpoint_drift(df: DataFrame, reg: Registry = REGISTRY, limit: float = 2.5, skewed: bool | None = None) -> DataFrame:
    """K5: (u_last - u_first) over the lot's 0 h robust scale; breach at |g| >= limit."""
    ends = df.where(F.col("u").isNotNull()).groupBy(*SERIES).agg(
        F.min_by("u", "elapsed_hours").alias("a"), F.max_by("u", "elapsed_hours").alias("b"), F.count(F.lit(1)).alias("k")
    )
    lot = group_median_mad(df.where("elapsed_hours = 0"), ["lot_id", "parameter_name"], "u", skewed).select("lot_id", "parameter_name", "mad")
    out = ends.where("k >= 2").join(lot, ["lot_id", "parameter_name"])
    g = (F.col("b") - F.col("a")) / F.greatest(MAD_SCALE * F.col("mad"), reg.floor())
    return out.withColumn("g", g).withColumn("breach", F.abs("g") >= limit).select(*SERIES, "g", "breach")


def empirical_p(obs: DataFrame, ref: DataFrame, keys: Sequence[str], stat: str, folded: bool = True) -> DataFrame:
    """K6: p = (1 + #{reference >= s}) / (N + 1), on |s| without doubling when folded; 1 where there is no reference."""
    score = F.abs(stat) if folded else F.col(stat)
    o = obs.withColumn("__score", score)
    r = ref.withColumn("__score", score)
    out = count_at_least(o, r, keys, "__score")
    p = (1.0 + F.coalesce("n_ge", F.lit(0)).cast("double")) / (F.col("n_ref").cast("double") + 1.0)
    return out.withColumn("p", F.when(F.col("__score").isNotNull(), p)).drop("__score")


def critical_threshold(ref: DataFrame, keys: Sequence[str], stat: str, alpha: float, skewed: bool | None = None) -> DataFrame:
    """K7: smallest reference value whose empirical p is still <= alpha (NULL when N is too small)."""
    rows = ref.withColumn("__s", F.abs(stat))

    def ranks(n: Column) -> Column:
        # alpha (N + 1) - 1 counts the reference values allowed at or above; rank from the top
        top = F.floor(F.lit(alpha) * (n + 1) - 1 + 1e-9).cast("bigint") + 1
        return F.array(F.when(top >= 1, n - top + 1))

    got = pick_ranks(rows, keys, "__s", ranks, skewed)
    return got.select(*keys, "n", F.col("picks")[0].alias("threshold"))


def holm(df: DataFrame, alpha: float, unit: Sequence[str] = ("component_id",), p: str = "p") -> DataFrame:
    """K8: step-down over the parameters of one unit; adds ``step`` (1-based) and ``reject``.

    The window spans one component's parameters - a handful of rows.
    """
    w = Window.partitionBy(*unit).orderBy(p, "parameter_name")
    m = F.count(p).over(Window.partitionBy(*unit))
    out = df.where(F.col(p).isNotNull()).withColumn("step", F.row_number().over(w)).withColumn("__m", m)
    ok = F.col(p) <= F.lit(alpha) / (F.col("__m") - F.col("step") + 1)
    out = out.withColumn("__ok", ok.cast("int"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("reject", F.min("__ok").over(run) == 1).drop("__m", "__ok")


def holm_steps(df: DataFrame, alpha: float, unit: Sequence[str] = ("component_id",), p: str = "p") -> DataFrame:
    """K9: per unit, rejections by strict-rank thresholds alpha / (m - #smaller)."""
    w = Window.partitionBy(*unit).orderBy(p)
    out = df.where(F.col(p).isNotNull()).withColumn("__r", F.rank().over(w) - 1).withColumn(
        "__m", F.count(p).over(Window.partitionBy(*unit))
    )
    hit = F.col(p) <= F.lit(alpha) / (F.col("__m") - F.col("__r"))
    per = out.groupBy(*unit).agg(F.count_if(hit).alias("n_hits"), F.min(F.when(~hit, F.col("__r"))).alias("first_miss"))
    return per.withColumn("n_reject", F.coalesce(F.least("n_hits", "first_miss"), F.col("n_hits")))


def reference_table(ref: DataFrame, keys: Sequence[str], stat: str, probs=(0.5, 0.9, 0.95, 0.99), skewed: bool | None = None) -> DataFrame:
    """Size, distinct values, moments and exact quantiles of a supplied null cohort."""
    base = ref.where(F.col(stat).isNotNull())
    moments = base.groupBy(*keys).agg(
        F.min(stat).alias("min"), F.max(stat).alias("max"), F.avg(stat).alias("mean"), F.stddev_pop(stat).alias("std")
    )
    distinct = base.groupBy(*keys, stat).agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("n_tied")
    )
    q = group_quantiles(base, keys, stat, probs, skewed)
    q = q.select(*keys, "n", *[F.col("q")[i].alias(f"q{int(round(p * 100))}") for i, p in enumerate(probs)])
    return q.join(moments, list(keys)).join(distinct, list(keys))


def rate_rollup(df: DataFrame, dims: Sequence[str], hit: str) -> DataFrame:
    """Rate of ``hit`` with Wilson bounds per cell, per first dimension and overall."""
    out = df.rollup(*dims).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"))
    low, high = wilson("k", "n")
    return out.withColumns({"rate": F.col("k") / F.col("n"), "low": low, "high": high})


def excess_versus_raw(excess: DataFrame, reference_lots: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Breach rates of slopes on the leave-one-out excess and on the raw coordinate, per parameter.

    Both slopes come from the same points (rows of ``loo_excess``) and are held against the same reference lots. A
    series counts once: n series, breaches of either coordinate and of both, rates with Wilson bounds and their gap.
    """
    points = cut(excess)
    slopes = [
        trend_statistics(points, value).select(*SERIES, "k", F.round("slope", 10).alias("slope"), F.lit(name).alias("coordinate"))
        for name, value in (("excess", "excess"), ("raw", "u"))
    ]
    both = slopes[0].unionByName(slopes[1])
    lots = reference_lots.select("lot_id")
    p = empirical_p(both.join(lots, "lot_id", "left_anti"), both.join(lots, "lot_id", "left_semi"), ["coordinate", "parameter_name", "k"], "slope")
    hit = F.coalesce(F.col("p") <= alpha, F.lit(False))
    wide = p.groupBy(*SERIES).agg(*[F.coalesce(F.bool_or(hit & (F.col("coordinate") == c)), F.lit(False)).alias(c) for c in ("excess", "raw")])
    out = wide.groupBy("parameter_name").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("excess").alias("k_excess"), F.count_if("raw").alias("k_raw"), F.count_if(F.col("excess") & F.col("raw")).alias("k_both")
    )
    for c in ("excess", "raw"):
        low, high = wilson(f"k_{c}", "n")
        out = out.withColumns({f"rate_{c}": F.col(f"k_{c}") / F.col("n"), f"low_{c}": low, f"high_{c}": high})
    return out.withColumn("gap", F.col("rate_raw") - F.col("rate_excess"))


def trend_screen(df: DataFrame, reference_lots: DataFrame, alpha: float = 0.001, skewed: bool | None = None) -> DataFrame:
    """Excess -> tau -> empirical p against the reference lots -> Holm per component."""
    st = trend_statistics(loo_excess(df, skewed))
    ref = st.join(reference_lots.select("lot_id"), "lot_id", "left_semi")
    obs = st.join(reference_lots.select("lot_id"), "lot_id", "left_anti")
    return holm(empirical_p(obs, ref, ["parameter_name", "k"], "tau"), alpha)


def lag1_autocorrelation(df: DataFrame) -> DataFrame:
    """corr(u_t, u_{t-1}) over all series of a parameter."""
    w = Window.partitionBy(*SERIES).orderBy("elapsed_hours")
    return df.withColumn("__p", F.lag("u").over(w)).groupBy("parameter_name").agg(
        F.count("__p").alias("n_pairs"), F.corr("u", "__p").alias("rho")
    )
