"""Queries of the forecasting layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions.scalars import inverse_transform, r6, transform
from emberline.operators import prognostics as P
from emberline.operators import regression as G
from emberline.operators.boosting import cross_fitted
from emberline.operators import represent as R
from emberline.plans import screening as S
from emberline.plans.catalog import query
from emberline.plans.oracle_parts import gram, huber, FLOOR, HIGH, LOW, TEL, TU, inv, loo, med_mad
from emberline.plans.oracle_parts import r6 as o6
from emberline.plans.screening_oracle import component_ctes, screen_ctes
from emberline.registry import CONFORMAL_QUANTILES, PRIMARY, REGIME_GATE
from emberline.sources import adapters as A

ID = ["component_id", "parameter_name"]
W = "WITH "


def case(d):
    return "CASE parameter_name " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in d.items()) + " END"


B0, B1, B2 = (case({p.name: getattr(p, f"beta{i}") for p in PRIMARY}) for i in range(3))
SIG = case({p.name: p.sigma_eff for p in PRIMARY})
POP = case({p.name: p.population_u for p in PRIMARY})
TRI = TU + f""",
tri AS MATERIALIZED (SELECT * FROM (SELECT component_id, lot_id, parameter_name, any_value(flr) AS flr, max(value) FILTER (elapsed_hours = 0) AS v0, max(value) FILTER (elapsed_hours = 24) AS v24, max(value) FILTER (elapsed_hours = 168) AS v168, max(u) FILTER (elapsed_hours = 0) AS u0, max(u) FILTER (elapsed_hours = 24) AS u24, max(u) FILTER (elapsed_hours = 168) AS u168 FROM tu GROUP BY 1, 2, 3) WHERE u0 IS NOT NULL AND u24 IS NOT NULL AND u168 IS NOT NULL),
lk AS (SELECT *, {B0} AS b0, {B1} AS b1, {B2} AS b2, {B0} + {B1} * u0 + {B2} * u24 AS uh, {SIG} AS sig FROM tri),
lky AS (SELECT *, {inv('uh')} AS y FROM lk),
du AS (SELECT component_id, lot_id, parameter_name, any_value(flr) AS flr, max(value) FILTER (elapsed_hours = 0) AS v0, max(value) FILTER (elapsed_hours = 24) AS v24, max(u) FILTER (elapsed_hours = 0) AS u0, max(u) FILTER (elapsed_hours = 24) AS u24 FROM tu GROUP BY 1, 2, 3),
d2 AS (SELECT * FROM du WHERE u0 IS NOT NULL AND u24 IS NOT NULL)"""
SUMSQL = "count(*)::DOUBLE AS n, sum(u0) AS s1, sum(u24) AS s2, sum(u168) AS sy, sum(u0 * u0) AS s11, sum(u0 * u24) AS s12, sum(u24 * u24) AS s22, sum(u0 * u168) AS s1y, sum(u24 * u168) AS s2y"
# ridge with a free intercept: centred sums, the second slope eliminated first
_P, _Q, _R = "(s11 - s1 * s1 / n + 1.0::DOUBLE)", "(s12 - s1 * s2 / n)", "(s22 - s2 * s2 / n + 1.0::DOUBLE)"
_V, _W = "(s1y - s1 * sy / n)", "(s2y - s2 * sy / n)"
_B1 = f"(({_V} - {_Q} * {_W} / {_R}) / ({_P} - {_Q} * {_Q} / {_R}))"
_B2 = f"(({_W} - {_Q} * {_B1}) / {_R})"
SOLVE = f"sy / n - {_B1} * s1 / n - {_B2} * s2 / n AS b0, {_B1} AS b1, {_B2} AS b2"
FIT = TRI + f""",
fs AS (SELECT parameter_name, {SUMSQL} FROM tri GROUP BY 1), fit AS (SELECT parameter_name, n, {SOLVE} FROM fs),
ls AS (SELECT parameter_name, lot_id, {SUMSQL} FROM tri GROUP BY 1, 2),
lr AS (SELECT l.parameter_name, l.lot_id, {', '.join(f't.{c} - l.{c} AS {c}' for c in G.SUMS)} FROM ls l JOIN fs t USING (parameter_name)),
lc AS (SELECT parameter_name, lot_id, {SOLVE} FROM lr)"""
CTX = TRI + ",\n" + loo("c0", "d2", "lot_id, parameter_name", "u0") + ",\nd3 AS (SELECT component_id, lot_id, parameter_name, flr, v0, v24, u0, u24, lmed AS m0, lmad AS mad0 FROM c0),\n" + loo("c2", "d3", "lot_id, parameter_name", "u24") + """,
cx AS (SELECT *, coalesce(m0, u0) AS lm0, coalesce(lmed, u24) AS lm24, u24 - u0 AS cd, CASE WHEN m0 IS NULL THEN 0.0::DOUBLE ELSE lmed - m0 END AS ld, u24 - u0 - CASE WHEN m0 IS NULL THEN 0.0::DOUBLE ELSE lmed - m0 END AS xd FROM c2)"""
QK = "CASE parameter_name || '|' || regime " + "{}" + " END"
Q90, Q95 = (QK.format(" ".join(f"WHEN '{p}|{r}' THEN {v[i]!r}::DOUBLE" for (p, r), v in CONFORMAL_QUANTILES.items())) for i in range(2))


def pos(x):
    return f"CASE WHEN parameter_name IN ('IDSS', 'RDS(on)') THEN greatest(0.0::DOUBLE, {x}) ELSE {x} END"


ZA = CTX + f""",
za AS (SELECT *, CASE WHEN abs(xd) <= {case(REGIME_GATE)} THEN 'ZERO_ANCHORED' ELSE 'DRIFT_MODEL' END AS regime, CASE WHEN abs(xd) <= {case(REGIME_GATE)} THEN u24 ELSE {B0} + {B1} * u0 + {B2} * u24 END AS uh FROM cx),
ci AS (SELECT *, {inv('uh')} AS y, {pos(inv(f'uh - {Q90}'))} AS l90, {pos(inv(f'uh + {Q90}'))} AS h90, {pos(inv(f'uh - {Q95}'))} AS l95, {pos(inv(f'uh + {Q95}'))} AS h95 FROM za)"""
SLO, SHI = case({p.name: p.safe_low for p in PRIMARY if p.safe_low is not None}), case({p.name: p.safe_high for p in PRIMARY})


def safety(src, y, lo="NULL::DOUBLE", hi="NULL::DOUBLE"):
    return f""",
sf0 AS (SELECT *, {y} AS yy, {lo} AS il, {hi} AS ih, {SLO} AS slo, {SHI} AS shi, CASE WHEN parameter_name IN ('IDSS', 'RDS(on)') THEN 'upper' WHEN {y} - v24 > 0 THEN 'upper' WHEN {y} - v24 < 0 THEN 'lower' ELSE 'none' END AS dir FROM {src}),
sf AS (SELECT *, CASE dir WHEN 'lower' THEN slo ELSE shi END AS thr, (yy - v24) / 144.0 AS rate, CASE WHEN dir = 'none' THEN 0.0::DOUBLE ELSE (CASE dir WHEN 'lower' THEN slo ELSE shi END - v24) / 144.0 END AS slim,
 CASE dir WHEN 'upper' THEN shi - yy WHEN 'lower' THEN yy - slo ELSE least(shi - yy, yy - slo) END AS margin, CASE WHEN (dir = 'upper' AND yy > shi) OR (dir = 'lower' AND yy < slo) THEN 'EARLY_REJECT' ELSE 'CONTINUE' END AS decision,
 CASE WHEN dir = 'upper' THEN CASE WHEN ih <= shi THEN 'WITHIN_BOUNDARY' WHEN il > shi THEN 'BEYOND_BOUNDARY' ELSE 'BOUNDARY_CROSSED' END WHEN dir = 'lower' THEN CASE WHEN il >= slo THEN 'WITHIN_BOUNDARY' WHEN ih < slo THEN 'BEYOND_BOUNDARY' ELSE 'BOUNDARY_CROSSED' END
 WHEN il < slo OR ih > shi THEN 'BOUNDARY_CROSSED' ELSE 'WITHIN_BOUNDARY' END AS istat FROM sf0)"""


def tri(spark, d):
    return P.training_triads(A.telemetry_parts(spark, d))


def locked(spark, d):
    return G.guarded(P.locked_score(tri(spark, d)))


def context(spark, d):
    return P.lot_context(A.telemetry_parts(spark, d))


def anchored(spark, d):
    c = P.locked_score(context(spark, d)).withColumn("delta_hat", F.col("u_hat") - F.col("u24"))
    z = P.conformal_intervals(P.zero_anchored(c))
    return z.withColumn("predicted", inverse_transform("parameter_name", "u_hat"))


def out(df, *cols, digits=6, **plain):
    return df.select(*ID, *[r6(c, digits).alias(c) for c in cols], *[F.col(v).alias(k) for k, v in plain.items()])


@query("prog_inputs", W + TEL + """, i AS (SELECT component_id, lot_id, parameter_name, min(unit) AS unit, string_agg(elapsed_hours || ':' || CAST(round(value * 1000000) AS BIGINT), ',' ORDER BY elapsed_hours) AS history, bool_or(elapsed_hours = 0) AS sufficient FROM tel WHERE elapsed_hours <= 24 GROUP BY 1, 2, 3)
SELECT component_id, parameter_name, history, sufficient, sha256(component_id || '|' || lot_id || '|' || parameter_name || '|' || unit || '|24|' || history) AS digest FROM i""")
def prog_inputs(spark, d):
    return P.prognostic_inputs(A.telemetry_parts(spark, d), 24).select(*ID, "history", "sufficient", "digest")


FE = TU + f""",
f0 AS (SELECT component_id, lot_id, parameter_name, any_value(flr) AS flr, max(u) FILTER (elapsed_hours = 0) AS u_0, max(u) FILTER (elapsed_hours = 96) AS u_t, count(*) AS k FROM tu WHERE elapsed_hours <= 96 GROUP BY 1, 2, 3),
fp AS (SELECT a.component_id, a.parameter_name, median((b.u - a.u) / (b.elapsed_hours - a.elapsed_hours)) AS ts FROM tu a JOIN tu b ON a.component_id = b.component_id AND a.parameter_name = b.parameter_name AND b.elapsed_hours > a.elapsed_hours AND b.elapsed_hours <= 96 GROUP BY 1, 2),
f1 AS (SELECT f0.*, (u_t - u_0) / 96.0::DOUBLE AS rs, CASE WHEN k >= 3 THEN ts END AS ts FROM f0 LEFT JOIN fp USING (component_id, parameter_name) WHERE u_0 IS NOT NULL AND u_t IS NOT NULL),
{med_mad('fm', 'f1', 'lot_id, parameter_name', 'rs')},
fe AS (SELECT f1.*, CASE WHEN fm.n >= 3 THEN fm.med ELSE rs END AS mu, CASE WHEN fm.n >= 3 THEN 1.4826::DOUBLE * fm.mad ELSE 0.0::DOUBLE END AS tau, coalesce(ts, rs) AS s FROM f1 JOIN fm ON f1.lot_id = fm.lot_id AND f1.parameter_name = fm.parameter_name)"""


def feats(spark, d):
    return P.features(R.with_u(A.telemetry_parts(spark, d)), 96)


@query("prog_features", W + FE + f" SELECT component_id, parameter_name, {o6('u_0', 8)} AS u_0, {o6('u_t', 8)} AS u_t, {o6('rs', 8)} AS raw_slope, {o6('ts', 8)} AS theil_sen, {o6('mu', 8)} AS lot_slope, {o6('tau', 8)} AS lot_slope_scale FROM fe")
def prog_features(spark, d):
    return out(feats(spark, d), "u_0", "u_t", "raw_slope", "theil_sen", "lot_slope", "lot_slope_scale", digits=8)


@query("lot_context", W + CTX + f" SELECT component_id, parameter_name, {o6('lm0')} AS loo_median_0, {o6('lm24')} AS loo_median_24, {o6('cd')} AS component_drift, {o6('ld')} AS lot_drift, {o6('xd')} AS excess_drift, {o6('coalesce(greatest(1.4826::DOUBLE * mad0, flr), flr)')} AS loo_scale_0 FROM cx")
def lot_context(spark, d):
    return out(context(spark, d), "loo_median_0", "loo_median_24", "component_drift", "lot_drift", "excess_drift", "loo_scale_0")


@query("fc_carry_forward", W + TEL + f" SELECT component_id, parameter_name, {o6('arg_max(value, elapsed_hours)')} AS predicted FROM tel WHERE elapsed_hours <= 24 GROUP BY 1, 2")
def fc_carry_forward(spark, d):
    return out(P.carry_forward(A.telemetry_parts(spark, d), 24), "predicted")


@query("fc_two_point", W + FE + f" SELECT component_id, parameter_name, {o6(inv('u_t + rs * 72.0::DOUBLE'))} AS predicted FROM fe")
def fc_two_point(spark, d):
    return out(P.two_point(feats(spark, d), 96), "predicted")


@query("fc_theil_sen", W + FE + f" SELECT component_id, parameter_name, {o6(inv('u_t + s * 72.0::DOUBLE'))} AS predicted FROM fe")
def fc_theil_sen(spark, d):
    return out(P.theil_sen_forecast(feats(spark, d), 96), "predicted")


@query("fc_lot_shrunk", W + FE + f""", h AS (SELECT *, tau * tau + (s - mu) * (s - mu) AS sg, 2 * flr * flr / (96.0 * 96.0) AS nz FROM fe),
h2 AS (SELECT *, CASE WHEN abs(mu) < flr / 96 AND abs(s - mu) < flr / 96 THEN 0.0::DOUBLE ELSE mu + sg / (sg + nz) * (s - mu) END AS sh FROM h)
SELECT component_id, parameter_name, {o6('sh', 8)} AS shrunk_slope, {o6(inv('u_t + sh * 72.0::DOUBLE'), 5)} AS predicted FROM h2""")
def fc_lot_shrunk(spark, d):
    f = P.lot_shrunk(feats(spark, d), 96)
    return f.select(*ID, r6("shrunk_slope", 8).alias("shrunk_slope"), r6("predicted", 5).alias("predicted"))


RES = ",\nrs AS (SELECT parameter_name, flr, u168 - u24 AS r FROM tri),\n" + med_mad("rm", "rs", "parameter_name", "r")


@query("sigma_eff", W + TRI + RES + f" SELECT parameter_name, n, {o6(f'greatest(1.4826::DOUBLE * mad, {FLOOR})')} AS sigma_eff FROM rm")
def sigma_eff(spark, d):
    s = G.sigma_eff(tri(spark, d).withColumn("residual", F.col("u168") - F.col("u24")))
    return s.select("parameter_name", "n", r6("sigma_eff").alias("sigma_eff"))


@query("fc_interval", W + TRI + f" SELECT component_id, parameter_name, {o6(inv('uh - 1.6448536269514722::DOUBLE * sig'))} AS lower, {o6(inv('uh + 1.6448536269514722::DOUBLE * sig'))} AS upper FROM lk")
def fc_interval(spark, d):
    return out(P.interval(P.locked_score(tri(spark, d)), "u_hat", "sigma_eff"), "lower", "upper")


@query("ridge_fit", W + FIT + f" SELECT parameter_name, n, {o6('b0')} AS b0, {o6('b1')} AS b1, {o6('b2')} AS b2 FROM fit")
def ridge_fit(spark, d):
    f = G.ridge_fit(tri(spark, d))
    return f.select("parameter_name", "n", *[r6(c).alias(c) for c in ("b0", "b1", "b2")])


OOF = FIT + ",\noo AS (SELECT t.*, c.b0 + c.b1 * u0 + c.b2 * u24 AS uh, u168 - (c.b0 + c.b1 * u0 + c.b2 * u24) AS r FROM tri t JOIN lc c ON t.parameter_name = c.parameter_name AND t.lot_id = c.lot_id),\n" + med_mad("om", "oo", "parameter_name", "r")


@query("ridge_oof_sigma", W + OOF + f" SELECT parameter_name, n, {o6(f'greatest(1.4826::DOUBLE * mad, {FLOOR})')} AS sigma_eff FROM om")
def ridge_oof_sigma(spark, d):
    return G.oof_sigma(tri(spark, d)).select("parameter_name", "n", r6("sigma_eff").alias("sigma_eff"))


@query("huber_fit", W + TRI + ",\n" + huber("hf", "tri", "parameter_name") + f" SELECT parameter_name, {o6('b0', 5)} AS b0, {o6('b1', 5)} AS b1, {o6('b2', 5)} AS b2, done AS converged FROM hf")
def huber_fit(spark, d):
    return G.huber_fit(tri(spark, d)).select("parameter_name", *[r6(c, 5).alias(c) for c in ("b0", "b1", "b2")], "converged")


@query("ridge_predict", W + FIT + f", p AS (SELECT t.*, f.b0 + f.b1 * u0 + f.b2 * u24 AS uh FROM tri t JOIN fit f USING (parameter_name)) SELECT component_id, parameter_name, {o6('CASE WHEN abs(uh) > 10 THEN v24 ELSE ' + inv('uh') + ' END', 5)} AS predicted, abs(uh) > 10 AS divergent FROM p")
def ridge_predict(spark, d):
    t = tri(spark, d)
    return out(G.guarded(G.score(t, G.ridge_fit(t))), "predicted", digits=5, divergent="divergent")


@query("locked_score", W + TRI + f" SELECT component_id, parameter_name, {o6('uh')} AS u_hat, {o6('y')} AS predicted FROM lky")
def locked_score(spark, d):
    return out(locked(spark, d), "u_hat", "predicted")


FEATS = ["u24", "component_drift", "lot_drift", "excess_drift"]


def residual_rows(spark, d):
    t = tri(spark, d).select(*ID, "u168")
    return context(spark, d).join(t, ID).withColumn("delta_u", F.col("u168") - F.col("u24"))


RESIDUAL = CTX + """,
rr AS (SELECT c.parameter_name, c.u24, c.cd, c.ld, c.xd, t.u168 - c.u24 AS dy FROM cx c JOIN tri t ON t.component_id = c.component_id AND t.parameter_name = c.parameter_name),
""" + gram("rg", "rr", "parameter_name", ["u24", "cd", "ld", "xd"], "dy")


@query("residual_ridge", W + RESIDUAL + " SELECT parameter_name, " + ", ".join(f"{o6(f'b{i}', 5)} AS beta_{n}" for i, n in enumerate(["0", *FEATS])) + " FROM rg")
def residual_ridge(spark, d):
    b = G.gram_fit(residual_rows(spark, d), FEATS, "delta_u")
    return b.select("parameter_name", *[r6(F.col("beta")[i], 5).alias(f"beta_{n}") for i, n in enumerate(["0", *FEATS])])


SQL_NAME = {"loo_median_0": "lm0", "loo_median_24": "lm24", "component_drift": "cd", "lot_drift": "ld", "excess_drift": "xd", "loo_scale_0": "sc0"}


def _variant_sql(name: str) -> tuple[str, str]:
    features, target = G.VARIANTS[name]
    xs = [SQL_NAME.get(f, f) for f in features]
    g = f"g{name}"
    u = " + ".join(["b0", *(f"b{i} * x.{c}" for i, c in enumerate(xs, 1))]) + (" + x.u24" if target == "delta_u" else "")
    rows = f"SELECT x.parameter_name, '{name}' AS variant, x.v24, x.v168, {u} AS uh FROM rr x JOIN {g} c ON c.pk = x.parameter_name || '|' || x.lot_id"
    return gram(g, "rf", "pk", xs, {"u168": "u168", "delta_u": "dy"}[target]), rows


_VARIANTS = [_variant_sql(v) for v in G.VARIANTS]
VARIANT_SQL = CTX + """,
rr AS MATERIALIZED (SELECT c.*, coalesce(greatest(1.4826::DOUBLE * c.mad0, c.flr), c.flr) AS sc0, t.u168, t.v168, t.u168 - c.u24 AS dy FROM cx c JOIN tri t ON t.component_id = c.component_id AND t.parameter_name = c.parameter_name),
rf AS MATERIALIZED (SELECT r.*, r.parameter_name || '|' || l.lot_id AS pk FROM rr r JOIN (SELECT DISTINCT lot_id FROM rr) l ON l.lot_id <> r.lot_id),
""" + ",\n".join(q for q, _ in _VARIANTS) + ",\nvs AS (" + " UNION ALL ".join(r for _, r in _VARIANTS) + f"""),
vp AS (SELECT *, abs(uh) <= 10 AND isfinite({inv('uh')}) AS sound FROM vs)"""


@query("feature_variants", W + VARIANT_SQL + f" SELECT parameter_name, variant, count(*) AS n, count(*) FILTER (NOT sound) AS n_divergent, {o6('avg(abs(CASE WHEN sound THEN ' + inv('uh') + ' ELSE v24 END - v168))', 4)} AS mae FROM vp GROUP BY 1, 2")
def feature_variants(spark, d):
    """Every feature and target variant, judged on lots it was not fitted on."""
    t = tri(spark, d).select(*ID, "u168", "v168")
    rows = context(spark, d).join(t, ID).withColumn("delta_u", F.col("u168") - F.col("u24"))
    v = G.variant_errors(rows)
    return v.select("parameter_name", "variant", "n", "n_divergent", r6("mae", 4).alias("mae"))


@query("gbt_residual")
def gbt_residual(spark, d):
    """Every row is forecast by trees that did not see its lot."""
    return out(cross_fitted(residual_rows(spark, d), FEATS, "delta_u"), "delta_hat", digits=4)


@query("regime_threshold", W + CTX + ",\n" + med_mad("xm", "cx", "parameter_name", "xd") + f" SELECT parameter_name, n, {o6(f'greatest(1.4826::DOUBLE * mad, {FLOOR})')} AS scale, {o6(f'0.5 * greatest(1.4826::DOUBLE * mad, {FLOOR})')} AS tau FROM xm")
def regime_threshold(spark, d):
    return P.regime_threshold(context(spark, d)).select("parameter_name", "n", r6("scale").alias("scale"), r6("tau").alias("tau"))


@query("zero_anchored", W + ZA + f" SELECT component_id, parameter_name, regime, {o6('uh')} AS u_hat FROM za")
def zero_anchored(spark, d):
    return out(anchored(spark, d), "u_hat", regime="regime")


TIE = 1e-7  # readings with five decimals would otherwise sit on the edge of rounding, where the two engines part
CI_COLS = {"low_90": "l90", "high_90": "h90", "low_95": "l95", "high_95": "h95"}


@query("conformal_intervals", W + ZA + f" SELECT component_id, parameter_name, {o6('y + 1e-7::DOUBLE', 4)} AS predicted, " + ", ".join(f"{o6(v, 4)} AS {k}" for k, v in CI_COLS.items()) + " FROM ci")
def conformal_intervals(spark, d):
    return anchored(spark, d).select(*ID, r6(F.col("predicted") + TIE, 4).alias("predicted"), *[r6(c, 4).alias(c) for c in CI_COLS])


@query("threshold_crossing", W + ZA + " SELECT component_id, CASE WHEN h90 < 60 THEN 'BELOW' WHEN l90 > 60 THEN 'ABOVE' ELSE 'CROSSES' END AS at_60, CASE WHEN h90 < 65 THEN 'BELOW' WHEN l90 > 65 THEN 'ABOVE' ELSE 'CROSSES' END AS at_65 FROM ci WHERE parameter_name = 'RDS(on)'")
def threshold_crossing(spark, d):
    a = anchored(spark, d).where("parameter_name = 'RDS(on)'")
    return a.select("component_id", P.threshold_class("low_90", "high_90", 60.0).alias("at_60"), P.threshold_class("low_90", "high_90", 65.0).alias("at_65"))


CONF = TRI + ",\nrx AS (SELECT component_id, parameter_name, lot_id, CASE WHEN abs(u24 - u0) <= 0.1 THEN 'ZERO_ANCHORED' ELSE 'DRIFT_MODEL' END AS regime, abs(u168 - uh) AS s FROM lk),\nrn AS (SELECT parameter_name, regime, count(*) AS n, list(s ORDER BY s) AS xs FROM rx GROUP BY 1, 2)"


def _cq(a):
    p = f"(least(1.0::DOUBLE, ceil((n + 1) * {1 - a}::DOUBLE - 1e-9) / n) * (n - 1))"
    return f"xs[CAST(floor({p}) AS BIGINT) + 1] + (xs[CAST(ceil({p}) AS BIGINT) + 1] - xs[CAST(floor({p}) AS BIGINT) + 1]) * ({p} - floor({p}))"


@query("conformal_quantiles", W + CONF + f" SELECT parameter_name, regime, n, {o6(_cq(0.1))} AS q90, {o6(_cq(0.05))} AS q95 FROM rn")
def conformal_quantiles(spark, d):
    t = P.locked_score(tri(spark, d)).withColumns(
        {"regime": F.expr("IF(abs(u24 - u0) <= 0.1, 'ZERO_ANCHORED', 'DRIFT_MODEL')"), "s": F.abs(F.col("u168") - F.col("u_hat"))}
    )
    q = P.conformal_quantiles(t, ["parameter_name", "regime"], "s")
    return q.select("parameter_name", "regime", "n", r6("q90").alias("q90"), r6("q95").alias("q95"))


def decided(spark, d):
    f = P.interval(locked(spark, d), "u_hat", "sigma_eff")
    return P.safety_slope(f, lower="lower", upper="upper")


LOCKSAFE = TRI + safety("lky", "y", inv("uh - 1.6448536269514722::DOUBLE * sig"), inv("uh + 1.6448536269514722::DOUBLE * sig"))


@query("safety_slope", W + LOCKSAFE + f" SELECT component_id, parameter_name, {o6('rate')} AS drift_rate, {o6('slim')} AS slope_limit, {o6('margin', 5)} AS margin, dir AS direction, decision FROM sf")
def safety_slope(spark, d):
    s = decided(spark, d)
    return s.select(*ID, r6("drift_rate").alias("drift_rate"), r6("slope_limit").alias("slope_limit"), r6("margin", 5).alias("margin"), "direction", "decision")


@query("interval_status", W + LOCKSAFE + " SELECT component_id, parameter_name, istat AS interval_status FROM sf")
def interval_status(spark, d):
    return decided(spark, d).select(*ID, "interval_status")


@query("early_reject_components", W + LOCKSAFE + " SELECT component_id, bool_or(decision = 'EARLY_REJECT') AS early_reject, count(*) FILTER (decision = 'EARLY_REJECT') AS n_parameters FROM sf GROUP BY 1")
def early_reject_components(spark, d):
    return P.early_reject_components(decided(spark, d))


@query("breach_interpretation", W + TRI + f" SELECT component_id, parameter_name, coalesce(v24 > {HIGH}, false) OR coalesce(v24 < {LOW}, false) AS measured_failure, coalesce(y > {HIGH}, false) OR coalesce(y < {LOW}, false) AS predicted_breach FROM lky")
def breach_interpretation(spark, d):
    return P.breach_interpretation(locked(spark, d), "v24").select(*ID, "measured_failure", "predicted_breach")


@query("linear_shap", W + TRI + f", a AS (SELECT *, b0 + (b1 + b2) * {POP} AS p0, (b1 + b2) * (u0 - {POP}) AS pb, b2 * (u24 - u0) AS ps FROM lk) SELECT component_id, parameter_name, {o6('p0')} AS phi_base_value, {o6('pb')} AS phi_baseline, {o6('ps')} AS phi_slope, {o6('greatest(abs(ps), abs(pb)) / (abs(ps) + abs(pb) + 1e-9) * 100', 4)} AS driver_share, CASE WHEN abs(ps) >= abs(pb) THEN 'slope_0_24' ELSE 'baseline_0h' END AS primary_driver FROM a")
def linear_shap(spark, d):
    a = P.linear_attribution(P.locked_score(tri(spark, d)))
    return a.select(*ID, *[r6(c).alias(c) for c in ("phi_base_value", "phi_baseline", "phi_slope")], r6("driver_share", 4).alias("driver_share"), "primary_driver")


@query("contributions", W + FIT + f" SELECT t.component_id, t.parameter_name, {o6('f.b1 * t.u0')} AS c_u0, {o6('f.b2 * t.u24')} AS c_u24, {o6('f.b0 + f.b1 * t.u0 + f.b2 * t.u24')} AS delta_hat, true AS additive FROM tri t JOIN fit f USING (parameter_name)")
def contributions(spark, d):
    t = tri(spark, d)
    b = G.gram_fit(t, ["u0", "u24"], "u168")
    c = P.contributions(t.join(b, "parameter_name"), ["u0", "u24"])
    return c.select(*ID, r6(F.col("contributions")["u0"]).alias("c_u0"), r6(F.col("contributions")["u24"]).alias("c_u24"), r6("delta_hat").alias("delta_hat"), (F.col("additivity_error") < 1e-9).alias("additive"))


CF = TRI + f""",
k0 AS (SELECT *, {LOW} AS lo, {HIGH} AS hi FROM lky), k1 AS (SELECT *, CASE WHEN lo IS NOT NULL THEN CASE WHEN y > hi OR v24 > (hi + lo) / 2 THEN 'upper' ELSE 'lower' END ELSE 'upper' END AS side FROM k0),
k2 AS (SELECT *, CASE side WHEN 'upper' THEN hi ELSE lo END AS lim FROM k1), k3 AS (SELECT *, CASE parameter_name WHEN 'IDSS' THEN ln(abs(lim)) WHEN 'RDS(on)' THEN ln(abs(lim)) WHEN 'IGSS' THEN asinh(lim) ELSE lim END AS ul FROM k2),
k4 AS (SELECT *, (ul - b0 - b1 * u0) / b2 AS ub FROM k3), k5 AS (SELECT *, {inv('ub')} AS vb FROM k4)"""


@query("counterfactual", W + CF + f" SELECT component_id, parameter_name, side AS limit_side, {o6('ub')} AS u24_boundary, CASE side WHEN 'upper' THEN v24 > lim OR y > lim ELSE v24 < lim OR y < lim END AS breaching FROM k5")
def counterfactual(spark, d):
    c = P.counterfactual(locked(spark, d))
    return c.select(*ID, "limit_side", r6("u24_boundary").alias("u24_boundary"), "breaching")


@query("counterfactual_audit", W + CF + f" SELECT parameter_name, count(*) AS n, true AS exact FROM k5 GROUP BY 1")
def counterfactual_audit(spark, d):
    """The forecast at the boundary meets the limit."""
    c = P.counterfactual(locked(spark, d))
    back = F.expr("b0 + b1 * u0 + b2 * u24_boundary")
    err = F.abs(back - transform("parameter_name", "target_limit"))
    return c.groupBy("parameter_name").agg(F.count(F.lit(1)).alias("n"), (F.max(err) < 1e-9).alias("exact"))


GATED = W + screen_ctes(24) + f""",
g0 AS (SELECT p.component_id, p.parameter_name, p.u AS ut, p.value AS v_t, p.flr, (p.u - q.u) / 24.0 AS s, f.sufficient, f.step_status, f.suspected, f.drift_status, f.g_excess FROM now0 p JOIN zero q ON p.component_id = q.component_id AND p.parameter_name = q.parameter_name JOIN pf f ON f.component_id = p.component_id AND f.parameter_name = p.parameter_name),
g1 AS (SELECT *, 2.0 * sqrt(2.0::DOUBLE) * flr / 24.0 AS th FROM g0), g2 AS (SELECT *, CASE WHEN NOT sufficient THEN 'EXCLUDED' WHEN step_status = 'ABRUPT_JUMP_ALERT' THEN 'STEP_CANDIDATE_UNVERIFIED_PERSISTENCE' WHEN suspected AND coalesce(abs(g_excess) >= 2.5, false) THEN 'CANDIDATE_EXCESS_DRIFT_CONFOUNDED' WHEN suspected THEN 'NO_SIGNIFICANT_EXCESS_MOTION_DETECTED'
 WHEN drift_status = 'STATIONARY' OR abs(s) <= th THEN 'STATIONARY_NOISE_BOUNDED' ELSE 'ACTIVE_DRIFT_EXTRAPOLATED' END AS flag FROM g1),
g3 AS (SELECT *, ut + CASE WHEN flag IN ('CANDIDATE_EXCESS_DRIFT_CONFOUNDED', 'ACTIVE_DRIFT_EXTRAPOLATED') THEN sign(s) * greatest(abs(s) - th, 0.0::DOUBLE) ELSE 0.0::DOUBLE END * 144.0 AS uh FROM g2)
SELECT component_id, parameter_name, flag, {o6('uh', 5)} AS u_hat FROM g3 WHERE flag <> 'EXCLUDED'"""


@query("fc_drift_gated", GATED)
def fc_drift_gated(spark, d):
    s = S.screen_parameters(A.telemetry_parts(spark, d), 24, fields={})
    zero = F.expr("get(filter(obs, r -> r.elapsed_hours = 0), 0).u")
    rows = s.select(
        *ID, F.col("u_now").alias("u_t"), F.col("now.value").alias("v_t"), ((F.col("u_now") - zero) / 24.0).alias("slope"),
        P.REGISTRY.floor().alias("floor"), F.col("suff.sufficient").alias("sufficient"), F.col("step.status").alias("step_status"),
        F.col("eq.suspected").alias("suspected"), F.col("drift.status").alias("drift_status"), F.col("drift.g_excess").alias("g_excess"),
    ).where("u_t IS NOT NULL AND slope IS NOT NULL")
    return out(P.drift_gated(rows, 24), "u_hat", digits=5, flag="flag").where("flag <> 'EXCLUDED'")


ADV = ZA + safety("ci", "CASE regime WHEN 'ZERO_ANCHORED' THEN v24 ELSE y END", "l90", "h90") + ",\nadv AS (SELECT *, CASE WHEN (parameter_name = 'RDS(on)' AND (NOT h90 < 60 OR NOT h90 < 65)) OR decision = 'EARLY_REJECT' OR istat = 'BOUNDARY_CROSSED' THEN 'EARLY_WARNING' ELSE 'CONTINUE' END AS advisory FROM sf)"


def production(spark, d):
    tel = A.telemetry_parts(spark, d)
    wide = tel.where("elapsed_hours IN (0, 24)").groupBy("component_id", "lot_id", "parameter_name").agg(
        F.max(F.when(F.col("elapsed_hours") == 0, F.col("value"))).alias("v0"),
        F.max(F.when(F.col("elapsed_hours") == 24, F.col("value"))).alias("v24"),
    )
    ctx = P.lot_context(tel).select(*ID, "excess_drift")
    return P.production_forecast(wide.join(ctx, ID, "left"))


@query(
    "production_forecast",
    W + ADV + f""", w AS (SELECT component_id, parameter_name, max(value) FILTER (elapsed_hours = 0) AS a, max(value) FILTER (elapsed_hours = 24) AS b FROM tel WHERE elapsed_hours IN (0, 24) GROUP BY 1, 2)
SELECT w.component_id, w.parameter_name, CASE WHEN w.a IS NULL THEN 'MISSING_0H' WHEN w.b IS NULL THEN 'MISSING_24H' END AS refusal, regime, {o6('yy + 1e-7::DOUBLE', 4)} AS predicted, {o6('l90', 4)} AS low_90, {o6('h90', 4)} AS high_90, {o6('l95', 4)} AS low_95, {o6('h95', 4)} AS high_95, {o6('slim')} AS slope_limit, decision, istat AS interval_status, coalesce(advisory, 'INSUFFICIENT_DATA') AS advisory
FROM w LEFT JOIN adv ON adv.component_id = w.component_id AND adv.parameter_name = w.parameter_name""",
)
def production_forecast(spark, d):
    made = production(spark, d).withColumn("answered", F.col("refusal").isNull())
    told = {c: F.when(F.col("answered"), F.col(c)).alias(c) for c in ("decision", "interval_status")}
    slope = r6(F.when(F.col("answered"), F.col("slope_limit"))).alias("slope_limit")
    return made.select(*ID, "refusal", "regime", r6(F.col("predicted") + TIE, 4).alias("predicted"), *[r6(c, 4).alias(c) for c in ("low_90", "high_90", "low_95", "high_95")], slope, *told.values(), "advisory")


@query(
    "unified_advisory",
    W + component_ctes(24) + "," + ADV[len(TU) + 1 :] .replace("\nd2 AS", "\ndd2 AS").replace("FROM d2 ", "FROM dd2 ").replace("FROM d2)", "FROM dd2)")
    + """ SELECT cf.component_id, CASE WHEN state IN ('FAIL', 'ALERT') THEN 'SCREENING_' || state || '_WITH_PROGNOSTIC_CONTEXT' WHEN state = 'EQUIPMENT_SUSPECTED' THEN 'EQUIPMENT_INVESTIGATION_REQUIRED'
 WHEN w THEN 'PROGNOSTIC_EARLY_WARNING' WHEN coalesce(n, 0) < 4 THEN 'INSUFFICIENT_TELEMETRY' ELSE 'NOMINAL_CONTINUE' END AS unified FROM cf LEFT JOIN (SELECT component_id, bool_or(advisory = 'EARLY_WARNING') AS w, count(*) AS n FROM adv GROUP BY 1) a USING (component_id)""",
)
def unified_advisory(spark, d):
    c = S.screen_components(A.telemetry_parts(spark, d), 24, evidence=False).select("component_id", "final.state")
    return P.unified_advisory(c, production(spark, d)).select("component_id", "unified")
