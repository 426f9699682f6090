"""Early-to-terminal forecasts, intervals, attributions and safety decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import series as S
from emberline.functions.scalars import MAD_SCALE, Z90, finite, inverse_transform, transform
from emberline.operators.loo import with_loo
from emberline.operators.ranks import group_median_mad, pick_ranks
from emberline.operators.represent import SERIES, triads
from emberline.registry import CONFORMAL_QUANTILES, REGIME_GATE, REGISTRY, TARGET_HOURS, Registry

LOT = ["lot_id", "parameter_name"]


def training_triads(df: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """v0, v24, v168 and u0, u24, u168 of complete series inside the transform domain."""
    t = triads(df.where(reg.known()), (0, 24, TARGET_HOURS))
    t = t.withColumns({f"u{h}": transform("parameter_name", f"v{h}", reg) for h in (0, 24, TARGET_HOURS)})
    return t.dropna(subset=["u0", "u24", f"u{TARGET_HOURS}"])


def prognostic_inputs(df: DataFrame, as_of: int, reg: Registry = REGISTRY) -> DataFrame:
    """Ordered as-of history text, sufficiency and input digest per series."""
    pts = F.array_sort(F.collect_list(F.struct("elapsed_hours", "value")))
    out = df.where((F.col("elapsed_hours") <= as_of) & reg.known()).groupBy(*SERIES).agg(pts.alias("pts"), F.min("unit").alias("unit"))
    text = F.array_join(F.transform("pts", lambda p: F.concat(p["elapsed_hours"].cast("string"), F.lit(":"), F.round(p["value"] * 1000000).cast("bigint").cast("string"))), ",")
    out = out.withColumns({"history": text, "sufficient": F.exists("pts", lambda p: p["elapsed_hours"] == 0)})
    return out.withColumn(
        "digest", F.sha2(F.concat_ws("|", "component_id", "lot_id", "parameter_name", "unit", F.lit(str(as_of)), "history"), 256)
    ).drop("pts")


def features(df: DataFrame, as_of: int, reg: Registry = REGISTRY, skewed: bool | None = None) -> DataFrame:
    """U at 0 h and T, raw and Theil-Sen slope, and the lot's slope median and scale."""
    rows = df.where((F.col("elapsed_hours") <= as_of) & F.col("u").isNotNull()).groupBy(*SERIES).agg(
        F.array_sort(F.collect_list(F.struct(F.col("elapsed_hours").alias("t"), "u"))).alias("pts"),
        F.max(F.when(F.col("elapsed_hours") == 0, F.col("u"))).alias("u_0"),
        F.max(F.when(F.col("elapsed_hours") == as_of, F.col("u"))).alias("u_t"),
    )
    rows = rows.where(F.col("u_0").isNotNull() & F.col("u_t").isNotNull())
    rows = rows.withColumns(
        {
            "raw_slope": (F.col("u_t") - F.col("u_0")) / float(max(as_of, 1)),
            "theil_sen": F.when(F.size("pts") >= 3, S.theil_sen(F.col("pts"))),
        }
    )
    lot = group_median_mad(rows, LOT, "raw_slope", skewed)
    out = rows.join(lot, LOT, "left").withColumns(
        {
            "lot_slope": F.when(F.col("n") >= 3, F.col("median")).otherwise(F.col("raw_slope")),
            "lot_slope_scale": F.when(F.col("n") >= 3, MAD_SCALE * F.col("mad")).otherwise(0.0),
        }
    )
    return out.drop("pts", "n", "median", "mad")


def lot_context(df: DataFrame, reg: Registry = REGISTRY, skewed: bool | None = None) -> DataFrame:
    """LOO lot medians at 0 h and 24 h, lot drift, excess drift, LOO scale at 0 h."""
    w = triads(df.where(reg.known()), (0, 24))
    w = w.withColumns({f"u{h}": transform("parameter_name", f"v{h}", reg) for h in (0, 24)}).dropna(subset=["u0", "u24"])
    long = w.select(*SERIES, "v0", "v24", "u0", "u24", F.explode(F.array(F.struct(F.lit(0).alias("h"), F.col("u0").alias("x")), F.struct(F.lit(24).alias("h"), F.col("u24").alias("x")))).alias("e"))
    long = long.select(*SERIES, "v0", "v24", "u0", "u24", "e.h", "e.x")
    loo = with_loo(long, [*LOT, "h"], "x", reg.floor(), "p", skewed)

    def at(h, c):
        return F.max(F.when(F.col("h") == h, F.col(c)))

    out = loo.groupBy(*SERIES, "v0", "v24", "u0", "u24").agg(at(0, "p_med").alias("m0"), at(24, "p_med").alias("m24"), at(0, "p_scale").alias("s0"))
    alone = F.col("m0").isNull()
    return out.select(
        *SERIES, "v0", "v24", "u0", "u24",
        F.coalesce("m0", "u0").alias("loo_median_0"),
        F.coalesce("m24", "u24").alias("loo_median_24"),
        (F.col("u24") - F.col("u0")).alias("component_drift"),
        F.when(alone, 0.0).otherwise(F.col("m24") - F.col("m0")).alias("lot_drift"),
        (F.col("u24") - F.col("u0") - F.when(alone, 0.0).otherwise(F.col("m24") - F.col("m0"))).alias("excess_drift"),
        F.coalesce("s0", reg.floor()).alias("loo_scale_0"),
    )


def carry_forward(df: DataFrame, as_of: int) -> DataFrame:
    """The last reading is the forecast."""
    return df.where(F.col("elapsed_hours") <= as_of).groupBy(*SERIES).agg(F.max_by("value", "elapsed_hours").alias("predicted"))


def _extrapolate(df: DataFrame, as_of: int, slope: Column, reg: Registry) -> DataFrame:
    u = F.col("u_t") + slope * float(TARGET_HOURS - as_of)
    return df.withColumn("predicted", F.coalesce(inverse_transform("parameter_name", u, reg), inverse_transform("parameter_name", "u_t", reg)))


def two_point(feats: DataFrame, as_of: int, reg: Registry = REGISTRY) -> DataFrame:
    """P5: straight line through 0 h and T in representation space."""
    return _extrapolate(feats, as_of, F.col("raw_slope"), reg)


def theil_sen_forecast(feats: DataFrame, as_of: int, reg: Registry = REGISTRY) -> DataFrame:
    """Theil-Sen slope from the last reading."""
    return _extrapolate(feats, as_of, F.coalesce("theil_sen", "raw_slope"), reg)


def interval(df: DataFrame, u: str, sigma: str, reg: Registry = REGISTRY, width: float = Z90) -> DataFrame:
    """Inverse-transformed u +/- z sigma, ordered; a diverged forecast (``guarded``) has no width."""
    a = inverse_transform("parameter_name", F.col(u) - width * F.col(sigma), reg)
    b = inverse_transform("parameter_name", F.col(u) + width * F.col(sigma), reg)
    low, high = F.least(a, b), F.greatest(a, b)
    if "divergent" in df.columns:
        low, high = (F.when(F.col("divergent"), F.col("predicted")).otherwise(c) for c in (low, high))
    return df.withColumns({"lower": low, "upper": high})


def locked_score(df: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """Forecast with the locked coefficients of the registry (adds u_hat, b0..b2, sigma_eff)."""
    df = df.withColumns({"b0": reg.lookup("beta0"), "b1": reg.lookup("beta1"), "b2": reg.lookup("beta2"), "sigma_eff": reg.lookup("sigma_eff")})
    return df.withColumn("u_hat", F.expr("b0 + b1 * u0 + b2 * u24"))


def regime_threshold(ctx: DataFrame, reg: Registry = REGISTRY, skewed: bool | None = None) -> DataFrame:
    """Half the robust scale of the excess drift per parameter."""
    g = group_median_mad(ctx, ["parameter_name"], "excess_drift", skewed)
    scale = F.greatest(MAD_SCALE * F.col("mad"), reg.floor())
    return g.select("parameter_name", "n", scale.alias("scale"), (0.5 * scale).alias("tau"))


def _constant(values: dict, param="parameter_name") -> Column:
    out = None
    for k, v in values.items():
        out = F.when(F.col(param) == k, F.lit(v)) if out is None else out.when(F.col(param) == k, F.lit(v))
    return out


def zero_anchored(df: DataFrame, delta: str = "delta_hat", tau: Column | None = None) -> DataFrame:
    """Inside the gate the drift is zero, outside it the model speaks."""
    gate = _constant(REGIME_GATE) if tau is None else tau
    quiet = F.abs("excess_drift") <= gate
    return df.withColumns(
        {
            "regime": F.when(quiet, "ZERO_ANCHORED").otherwise("DRIFT_MODEL"),
            "u_hat": F.when(quiet, F.col("u24")).otherwise(F.col("u24") + F.col(delta)),
        }
    )


def drift_gated(df: DataFrame, as_of: int, k_sigma: float = 2.0, reg: Registry = REGISTRY) -> DataFrame:
    """Soft-thresholded extrapolation steered by the screening evidence.

    Rows carry u_t, v_t, slope, floor, sufficient, step_status, suspected, drift_status, g_excess.
    """
    lead, obs = float(TARGET_HOURS - as_of), float(max(as_of, 1))
    df = df.withColumn("theta", F.lit(k_sigma) * (2.0**0.5) * F.col("floor") / obs)
    soft = F.signum("slope") * F.greatest(F.abs("slope") - F.col("theta"), F.lit(0.0))
    moving = F.col("suspected") & F.coalesce(F.abs("g_excess") >= 2.5, F.lit(False))
    branch = (
        F.when(~F.col("sufficient"), "EXCLUDED")
        .when(F.col("step_status") == "ABRUPT_JUMP_ALERT", "STEP_CANDIDATE_UNVERIFIED_PERSISTENCE")
        .when(moving, "CANDIDATE_EXCESS_DRIFT_CONFOUNDED")
        .when(F.col("suspected"), "NO_SIGNIFICANT_EXCESS_MOTION_DETECTED")
        .when((F.col("drift_status") == "STATIONARY") | (F.abs("slope") <= F.col("theta")), "STATIONARY_NOISE_BOUNDED")
        .otherwise("ACTIVE_DRIFT_EXTRAPOLATED")
    )
    df = df.withColumn("flag", branch)
    used = F.when(F.col("flag").isin("CANDIDATE_EXCESS_DRIFT_CONFOUNDED", "ACTIVE_DRIFT_EXTRAPOLATED"), soft).otherwise(0.0)
    df = df.withColumn("shrunk_slope", F.when(F.col("flag") != "EXCLUDED", used))
    df = df.withColumn("u_hat", F.col("u_t") + F.col("shrunk_slope") * lead)
    y = F.coalesce(inverse_transform("parameter_name", "u_hat", reg), F.when(F.col("u_hat").isNotNull(), F.col("v_t")))
    df = df.withColumn("predicted", y)
    breach = F.when(F.col("predicted") > reg.lookup("spec_high"), "PREDICTED_SPEC_BREACH_POSITIVE").when(
        F.col("predicted") < reg.lookup("spec_low"), "PREDICTED_SPEC_BREACH_NEGATIVE"
    )
    return df.withColumns({"predicted_breach": breach, "interval_inflation": F.when(F.col("suspected"), 2.0**0.5).otherwise(1.0)})


def lot_shrunk(feats: DataFrame, as_of: int, reg: Registry = REGISTRY) -> DataFrame:
    """Slope shrunk toward the lot's median slope by its signal-to-noise share."""
    obs = float(max(as_of, 1))
    s = F.coalesce("theil_sen", "raw_slope")
    df = feats.withColumns({"__s": s, "__f": reg.floor()})
    df = df.withColumns(
        {
            "__sig": F.expr("lot_slope_scale * lot_slope_scale + (__s - lot_slope) * (__s - lot_slope)"),
            "__noise": 2.0 * F.col("__f") * F.col("__f") / (obs * obs),
        }
    )
    lam = F.col("__sig") / (F.col("__sig") + F.col("__noise"))
    quiet = (F.abs("lot_slope") < F.col("__f") / obs) & (F.abs(F.col("__s") - F.col("lot_slope")) < F.col("__f") / obs)
    df = df.withColumn("shrunk_slope", F.when(quiet, 0.0).otherwise(F.col("lot_slope") + lam * (F.col("__s") - F.col("lot_slope"))))
    return _extrapolate(df, as_of, F.col("shrunk_slope"), reg).drop("__s", "__f", "__sig", "__noise")


def conformal_quantiles(scores: DataFrame, keys, value: str, alphas=(0.1, 0.05), skewed: bool | None = None) -> DataFrame:
    """P20: per key, the ceil((N+1)(1-a))/N quantile of the scores, linearly interpolated."""

    def position(n: Column, a: float) -> Column:
        level = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(1.0 - a) - 1e-9) / n)
        return level * (n - 1)

    def ranks(n: Column) -> Column:
        out = []
        for a in alphas:
            out += [F.floor(position(n, a)).cast("bigint") + 1, F.ceil(position(n, a)).cast("bigint") + 1]
        return F.array(*out)

    got = pick_ranks(scores, keys, value, ranks, skewed)
    n, picks = F.col("n"), F.col("picks")
    cols = []
    for i, a in enumerate(alphas):
        pos = position(n, a)
        cols.append((picks[2 * i] + (picks[2 * i + 1] - picks[2 * i]) * (pos - F.floor(pos))).alias(f"q{round((1 - a) * 100)}"))
    return got.select(*keys, "n", *cols)


def conformal_intervals(df: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """90 and 95 % intervals around u_hat from the frozen quantiles; log parameters stay >= 0."""
    key = F.concat("parameter_name", F.lit("|"), "regime")
    out = df.withColumn("__key", key)
    for i, name in enumerate(("90", "95")):
        q = _constant({f"{p}|{r}": v[i] for (p, r), v in CONFORMAL_QUANTILES.items()}, "__key")
        for side, sign in (("low", -1.0), ("high", 1.0)):
            y = F.coalesce(inverse_transform("parameter_name", F.col("u_hat") + sign * q, reg), F.col("v24"))
            y = F.when(reg.lookup("transform") == "log", F.greatest(F.lit(0.0), y)).otherwise(y)
            out = out.withColumn(f"{side}_{name}", y)
        out = out.withColumn(f"width_{name}", F.col(f"high_{name}") - F.col(f"low_{name}"))
    return out.drop("__key")


def threshold_class(low: Column | str, high: Column | str, threshold: float) -> Column:
    """Strictly below, strictly above, or crossing."""
    low, high = (F.col(c) if isinstance(c, str) else c for c in (low, high))
    return F.when(high < threshold, "BELOW").when(low > threshold, "ABOVE").otherwise("CROSSES")


def safety_slope(df: DataFrame, reg: Registry = REGISTRY, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """Needs v24 and predicted; adds drift rate, slope, margin, decision, interval status."""
    span = float(TARGET_HOURS - 24)
    df = df.withColumns(
        {
            "__lo": reg.lookup("safe_low"),
            "__hi": reg.lookup("safe_high"),
            "__y": finite("predicted"),
            "__v": finite("v24"),
            "__l": F.lit(None).cast("double") if lower is None else F.col(lower),
            "__h": F.lit(None).cast("double") if upper is None else F.col(upper),
            "__dir": reg.lookup("safe_direction"),
        }
    )
    df = df.withColumn(
        "direction",
        F.expr(
            "CASE WHEN __y IS NULL OR __v IS NULL THEN 'none' WHEN __dir <> 'two_sided' THEN __dir "
            "WHEN __y - __v > 0 THEN 'upper' WHEN __y - __v < 0 THEN 'lower' ELSE 'none' END"
        ),
    )
    df = df.withColumns(
        {
            "threshold": F.expr("CASE direction WHEN 'upper' THEN __hi WHEN 'lower' THEN __lo ELSE IF(__y IS NULL OR __v IS NULL, NULL, __hi) END"),
            "drift_rate": F.expr(f"(__y - __v) / {span}D"),
        }
    )
    df = df.withColumns(
        {
            "slope_limit": F.expr(f"IF(direction = 'none', IF(__y IS NULL OR __v IS NULL, NULL, 0D), (threshold - __v) / {span}D)"),
            "margin": F.expr(
                "CASE direction WHEN 'upper' THEN threshold - __y WHEN 'lower' THEN __y - threshold ELSE least(__hi - __y, __y - __lo) END"
            ),
            "decision": F.expr(
                "CASE WHEN __y IS NULL OR __v IS NULL THEN 'INSUFFICIENT_DATA' "
                "WHEN (direction = 'upper' AND __y > threshold) OR (direction = 'lower' AND __y < threshold) THEN 'EARLY_REJECT' ELSE 'CONTINUE' END"
            ),
            "interval_status": F.expr(
                "CASE WHEN __l IS NULL OR __h IS NULL OR __y IS NULL OR __v IS NULL THEN 'NO_INTERVAL' "
                "WHEN direction = 'upper' THEN CASE WHEN __h <= threshold THEN 'WITHIN_BOUNDARY' WHEN __l > threshold THEN 'BEYOND_BOUNDARY' ELSE 'BOUNDARY_CROSSED' END "
                "WHEN direction = 'lower' THEN CASE WHEN __l >= threshold THEN 'WITHIN_BOUNDARY' WHEN __h < threshold THEN 'BEYOND_BOUNDARY' ELSE 'BOUNDARY_CROSSED' END "
                "WHEN __l < __lo OR __h > __hi THEN 'BOUNDARY_CROSSED' ELSE 'WITHIN_BOUNDARY' END"
            ),
        }
    )
    return df.drop("__lo", "__hi", "__y", "__v", "__l", "__h", "__dir")


def linear_attribution(df: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """Exact attributions of a linear forecast against the population baseline."""
    df = df.withColumn("__m", reg.lookup("population_u"))
    df = df.withColumns(
        {
            "phi_base_value": F.expr("b0 + (b1 + b2) * __m"),
            "phi_baseline": F.expr("(b1 + b2) * (u0 - __m)"),
            "phi_slope": F.expr("b2 * (u24 - u0)"),
        }
    ).drop("__m")
    return df.withColumns(
        {
            "primary_driver": F.expr("IF(abs(phi_slope) >= abs(phi_baseline), 'slope_0_24', 'baseline_0h')"),
            "driver_share": F.expr("greatest(abs(phi_slope), abs(phi_baseline)) / (abs(phi_slope) + abs(phi_baseline) + 1e-9) * 100"),
        }
    )


def contributions(df: DataFrame, names, betas: str = "beta") -> DataFrame:
    """Map feature -> beta * x, their sum, and the additivity error against u_hat."""
    xs = F.array(*[F.col(n) for n in names])
    b = F.slice(F.col(betas), 2, len(names))
    prod = F.zip_with(b, xs, lambda p, x: p * x)
    df = df.withColumn("contributions", F.map_from_arrays(F.array(*[F.lit(n) for n in names]), prod))
    total = F.aggregate(F.map_values("contributions"), F.col(betas)[0], lambda s, x: s + x)
    direct = F.col(betas)[0]
    for i, n in enumerate(names):
        direct = direct + F.col(betas)[i + 1] * F.col(n)
    return df.withColumns({"delta_hat": direct, "additivity_error": F.abs(total - direct)})


def counterfactual(df: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """The 24 h reading at which the linear forecast would meet the limit."""
    df = df.withColumns({"__lo": reg.lookup("spec_low"), "__hi": reg.lookup("spec_high")})
    df = df.withColumn(
        "limit_side",
        F.expr(
            "CASE WHEN __lo IS NOT NULL AND __hi IS NOT NULL THEN IF(predicted > __hi OR v24 > (__hi + __lo) / 2, 'upper', 'lower') "
            "WHEN __hi IS NOT NULL THEN 'upper' WHEN __lo IS NOT NULL THEN 'lower' END"
        ),
    )
    df = df.withColumn("target_limit", F.expr("IF(limit_side = 'upper', __hi, __lo)"))
    df = df.withColumn("__ul", transform("parameter_name", "target_limit", reg))
    df = df.withColumn("u24_boundary", F.expr("IF(abs(b2) < 1e-12, NULL, (__ul - b0 - b1 * u0) / b2)"))
    df = df.withColumn("v24_boundary", inverse_transform("parameter_name", "u24_boundary", reg))
    return df.withColumns(
        {
            "delta_from_observed": F.expr("v24_boundary - v24"),
            "headroom": F.expr("abs(v24_boundary - v24)"),
            "breaching": F.expr(
                "IF(limit_side = 'upper', v24 > target_limit OR predicted > target_limit, v24 < target_limit OR predicted < target_limit)"
            ),
        }
    ).drop("__lo", "__hi", "__ul")


def production_forecast(df: DataFrame, delta: str | None = None, reg: Registry = REGISTRY) -> DataFrame:
    """P25: batch forecast with refusals.  ``df``: one row per series with v0, v24 (NULL if absent),
    excess_drift (NULL without a lot) and optionally a residual-model column ``delta``."""
    df = df.withColumns({"u0": transform("parameter_name", "v0", reg), "u24": transform("parameter_name", "v24", reg)})
    log = reg.lookup("transform") == "log"
    bad = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    df = df.withColumn(
        "refusal",
        F.when(~reg.known(), "UNKNOWN_PARAMETER")
        .when(F.col("v0").isNull(), "MISSING_0H")
        .when(F.col("v24").isNull(), "MISSING_24H")
        .when(bad("v0") | bad("v24"), "NON_FINITE")
        .when(log & ((F.col("v0") <= 0) | (F.col("v24") <= 0)), "NON_POSITIVE")
        .when((F.abs("u0") > 10) | (F.abs("u24") > 10), "OUT_OF_RANGE"),
    )
    if delta is None:
        df = locked_score(df, reg).withColumn("delta_hat", F.col("u_hat") - F.col("u24")).drop("u_hat", "sigma_eff")
        delta = "delta_hat"
    df = df.withColumn("excess_drift", F.coalesce("excess_drift", F.col("u24") - F.col("u0")))
    df = conformal_intervals(zero_anchored(df, delta), reg)
    # a zero-anchored forecast is the reading itself, not its way through the transform and back
    y = F.when(F.col("regime") == "ZERO_ANCHORED", F.col("v24")).otherwise(F.coalesce(inverse_transform("parameter_name", "u_hat", reg), F.col("v24")))
    ok = F.col("refusal").isNull()
    df = df.withColumn("predicted", F.when(ok, y))
    for c in ("low_90", "high_90", "low_95", "high_95", "regime"):
        df = df.withColumn(c, F.when(ok, F.col(c)))
    df = safety_slope(df, reg, "low_90", "high_90")
    # a parameter with a screening margin warns at the margin and at its limit, any parameter at its safety boundary
    margin, limit = reg.lookup("margin_high"), reg.lookup("spec_high")
    near = margin.isNotNull() & ~(F.col("high_90") < F.least(margin, limit))
    warn = F.coalesce(near, F.lit(False)) | (F.col("decision") == "EARLY_REJECT") | F.coalesce(F.col("interval_status") == "BOUNDARY_CROSSED", F.lit(False))
    return df.withColumn("advisory", F.when(~ok, "INSUFFICIENT_DATA").when(warn, "EARLY_WARNING").otherwise("CONTINUE"))


def unified_advisory(components: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Screening state first, then the forecasts; neither side overwrites the other."""
    b = forecasts.groupBy("component_id").agg(
        F.bool_or(F.col("advisory") == "EARLY_WARNING").alias("any_warning"),
        F.bool_or(F.col("advisory") == "INSUFFICIENT_DATA").alias("any_insufficient"),
    )
    j = components.join(b, "component_id", "left")
    state = F.col("state")
    return j.withColumn(
        "unified",
        F.when(state.isin("FAIL", "ALERT"), F.concat(F.lit("SCREENING_"), state, F.lit("_WITH_PROGNOSTIC_CONTEXT")))
        .when(state == "EQUIPMENT_SUSPECTED", "EQUIPMENT_INVESTIGATION_REQUIRED")
        .when(F.col("any_warning"), "PROGNOSTIC_EARLY_WARNING")
        .when(F.col("any_insufficient"), "INSUFFICIENT_TELEMETRY")
        .otherwise("NOMINAL_CONTINUE"),
    )


def breach_interpretation(df: DataFrame, measured: str, reg: Registry = REGISTRY) -> DataFrame:
    """Measured failure and predicted breach side by side; the forecast never feeds back."""
    lo, hi, m = reg.lookup("spec_low"), reg.lookup("spec_high"), F.col(measured)
    f = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns(
        {
            "measured_failure": f(m > hi) | f(m < lo),
            "predicted_upper": f(F.col("predicted") > hi),
            "predicted_lower": f(F.col("predicted") < lo),
        }
    ).withColumn("predicted_breach", F.col("predicted_upper") | F.col("predicted_lower"))


def early_reject_components(decisions: DataFrame) -> DataFrame:
    """A component is rejected early when any of its parameters is."""
    return decisions.groupBy("component_id").agg(
        F.bool_or(F.col("decision") == "EARLY_REJECT").alias("early_reject"), F.count_if(F.col("decision") == "EARLY_REJECT").alias("n_parameters")
    )
