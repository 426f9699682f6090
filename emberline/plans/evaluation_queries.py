"""Queries of the evaluation layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions.scalars import inverse_transform, r6
from emberline.operators import decomposition as DC
from emberline.operators import evaluation as V
from emberline.operators import folds as FO
from emberline.operators import prognostics as P
from emberline.operators import regression as G
from emberline.plans import screening as S
from emberline.plans.catalog import query
from emberline.plans.oracle_parts import FLOOR, HIGH, LOW, huber, inv, med_mad, part, ridge
from emberline.plans.oracle_parts import r6 as o6
from emberline.plans.prognostic_queries import FIT, ID, SOLVE, SUMSQL, TRI, W, ZA, anchored, locked, tri
from emberline.plans.quality_queries import PARTS_SQL, lot_partitions
from emberline.plans.screening_oracle import component_ctes
from emberline.session import cut
from emberline.registry import REGISTRY
from emberline.sources import adapters as A

FC = TRI + f""",
fc AS (SELECT *, {inv('uh - 1.6448536269514722::DOUBLE * sig')} AS lower, {inv('uh + 1.6448536269514722::DOUBLE * sig')} AS upper, CASE WHEN v168 < 0 THEN 'NEG' ELSE 'POS' END AS sgn FROM lky)"""
MET = {
    "mae": "avg(abs(y - v168))", "rmse": "sqrt(avg((y - v168) * (y - v168)))", "bias": "avg(y - v168)", "coverage": "avg((v168 >= lower AND v168 <= upper)::INT)", "width": "avg(upper - lower)",
    "winkler": "avg(upper - lower + 20.0 * CASE WHEN v168 < lower THEN lower - v168 WHEN v168 > upper THEN v168 - upper ELSE 0.0 END)",
}
METSQL = "count(*) AS n, count(*) AS n_valid, " + ", ".join(f"{o6(v, 5)} AS {k}" for k, v in MET.items())
LAB = """ab AS (SELECT parameter_name, quantile_cont(abs(u168 - u0), 0.9) AS cut FROM tri GROUP BY 1),
lab AS (SELECT component_id, bool_or(abs(u168 - u0) > cut) AS defective FROM tri JOIN ab USING (parameter_name) GROUP BY 1)"""


def forecasts(spark, d):
    f = P.interval(locked(spark, d), "u_hat", "sigma_eff")
    return f.withColumn("sgn", F.when(F.col("v168") < 0, "NEG").otherwise("POS"))


def labels(spark, d):
    """Component label: motion from 0 h to 168 h beyond the 90 % quantile of its parameter."""
    from emberline.operators.ranks import group_quantiles

    t = tri(spark, d).withColumn("m", F.abs(F.col("u168") - F.col("u0")))
    q = group_quantiles(t, ["parameter_name"], "m", [0.9]).select("parameter_name", F.col("q")[0].alias("cut"))
    return t.join(q, "parameter_name").select("component_id", "lot_id", "parameter_name", (F.col("m") > F.col("cut")).alias("is_defective"))


def shown(df, *keys, digits=5):
    return df.select(*keys, "n", "n_valid", *[r6(c, digits).alias(c) for c in MET if c in df.columns])


@query("forecast_metrics", W + FC + f" SELECT parameter_name, {METSQL} FROM fc GROUP BY 1")
def forecast_metrics(spark, d):
    return shown(V.forecast_metrics(forecasts(spark, d), ["parameter_name"]), "parameter_name")


@query("metrics_grouping_sets", W + FC + f" SELECT sgn, parameter_name, {METSQL} FROM fc GROUP BY GROUPING SETS ((), (parameter_name), (sgn), (sgn, parameter_name))")
def metrics_grouping_sets(spark, d):
    m = V.metrics_by(forecasts(spark, d), ["sgn", "parameter_name"], [[], ["parameter_name"], ["sgn"], ["sgn", "parameter_name"]])
    return shown(m, "sgn", "parameter_name")


ARMS = ("carry", "huber", "ridge", "two_point")
MAECOLS = ("mae_mean", "mae_std", "mae_min", "mae_max")
SUM2 = ", ".join(f"t.{c} - a.{c} - b.{c} AS {c}" for c in G.SUMS)
FOLDS = FIT + f""",
lots AS MATERIALIZED (SELECT DISTINCT lot_id FROM tri),
hs AS MATERIALIZED (SELECT t.parameter_name, l.lot_id AS f, u0, u24, u168, flr FROM tri t JOIN lots l ON l.lot_id <> t.lot_id),
""" + huber("hu", "hs", "parameter_name, f")
# interval scales: the models that see neither the fold's lot nor the row's
NESTED = FOLDS + f""",
l2 AS MATERIALIZED (SELECT t.parameter_name, a.lot_id AS f, b.lot_id AS g, {SUM2} FROM fs t JOIN ls a USING (parameter_name) JOIN ls b ON b.parameter_name = t.parameter_name AND a.lot_id <> b.lot_id),
c2 AS MATERIALIZED (SELECT parameter_name, f, g, {SOLVE} FROM l2),
n2 AS MATERIALIZED (SELECT t.parameter_name, c.f, flr, u168 - (b0 + b1 * u0 + b2 * u24) AS r FROM tri t JOIN c2 c ON c.parameter_name = t.parameter_name AND c.g = t.lot_id),
hp AS MATERIALIZED (SELECT t.parameter_name, a.lot_id AS f, b.lot_id AS g, u0, u24, u168, flr FROM tri t JOIN lots a ON a.lot_id <> t.lot_id JOIN lots b ON b.lot_id <> t.lot_id AND a.lot_id < b.lot_id),
""" + huber("hv", "hp", "parameter_name, f, g", 9) + """,
h2 AS MATERIALIZED (SELECT t.parameter_name, CASE WHEN c.f = t.lot_id THEN c.g ELSE c.f END AS f, flr, u168 - (b0 + b1 * u0 + b2 * u24) AS r FROM tri t JOIN hv c ON c.parameter_name = t.parameter_name AND (c.f = t.lot_id OR c.g = t.lot_id)),
""" + med_mad("nm", "n2", "parameter_name, f", "r") + ",\n" + med_mad("hm", "h2", "parameter_name, f", "r")


def _trained(model: str, table: str, fold: str, sigma: str = "NULL::DOUBLE") -> str:
    return f"SELECT t.component_id, t.lot_id, t.parameter_name, t.v24, t.v168, '{model}' AS model, c.b0 + c.b1 * u0 + c.b2 * u24 AS uh, {sigma} AS sg FROM tri t JOIN {table} c ON c.parameter_name = t.parameter_name AND c.{fold} = t.lot_id"


SOUND = "abs(uh) <= 10 AND isfinite({y}) AND coalesce(isfinite({lo}) AND isfinite({hi}), true)".format(y=inv("uh"), lo=inv("uh - 1.6448536269514722::DOUBLE * sg"), hi=inv("uh + 1.6448536269514722::DOUBLE * sg"))
PREDICTED = f"""CASE WHEN {SOUND} THEN {inv('uh')} ELSE v24 END AS p, CASE WHEN {SOUND} THEN {inv('uh - 1.6448536269514722::DOUBLE * sg')} ELSE v24 END AS lo, CASE WHEN {SOUND} THEN {inv('uh + 1.6448536269514722::DOUBLE * sg')} ELSE v24 END AS hi"""
LOLO = FOLDS + f""",
uq AS ({_trained('ridge', 'lc', 'lot_id')} UNION ALL {_trained('huber', 'hu', 'f')}),
sc AS (SELECT lot_id, parameter_name, v168, model, p FROM (SELECT *, {PREDICTED} FROM uq)
 UNION ALL SELECT lot_id, parameter_name, v168, 'carry', v24 FROM tri UNION ALL SELECT lot_id, parameter_name, v168, 'two_point', 7 * v24 - 6 * v0 FROM tri),
fo AS (SELECT parameter_name, model, lot_id, avg(abs(p - v168)) AS m FROM sc GROUP BY 1, 2, 3),
fz AS (SELECT parameter_name, model, count(*) AS n_folds, avg(m) AS mae_mean, stddev_pop(m) AS mae_std, min(m) AS mae_min, max(m) AS mae_max FROM fo GROUP BY 1, 2)"""
_SIGMA = "(SELECT greatest(1.4826::DOUBLE * mad, {floor}) FROM {m} x WHERE x.parameter_name = t.parameter_name AND x.f = t.lot_id)"
_FLOOR = FLOOR.replace("parameter_name", "t.parameter_name")
EVIDENCE = NESTED + f""",
uq AS ({_trained('ridge', 'lc', 'lot_id', _SIGMA.format(floor=_FLOOR, m='nm'))} UNION ALL {_trained('huber', 'hu', 'f', _SIGMA.format(floor=_FLOOR, m='hm'))}),
sc AS MATERIALIZED (SELECT *, hi - lo + 20 * greatest(lo - v168, v168 - hi, 0) AS wk FROM (SELECT *, {PREDICTED} FROM uq)),
fo AS (SELECT parameter_name, model, lot_id, count(*) AS n, sum(abs(p - v168)) AS e, sum(wk) AS w FROM sc GROUP BY 1, 2, 3),
ev AS MATERIALIZED (SELECT parameter_name, model, sum(e) / sum(n) AS mae, sum(w) / sum(n) AS winkler, stddev_pop(e / n) AS mae_std FROM fo GROUP BY 1, 2)"""


def held_out(spark, d, nested):
    return FO.held_out_forecasts(tri(spark, d), nested=nested)


@query("lolo_cv", W + LOLO + f" SELECT parameter_name, model, n_folds, {', '.join(f'{o6(c, 5)} AS {c}' for c in MAECOLS)} FROM fz")
def lolo_cv(spark, d):
    return V.fold_summary(held_out(spark, d, False)).select("parameter_name", "model", "n_folds", *[r6(c, 5).alias(c) for c in MAECOLS])


@query("lolo_intervals", W + EVIDENCE + f" SELECT parameter_name, model, {o6('mae', 5)} AS mae, {o6('winkler', 4)} AS winkler, {o6('mae_std', 5)} AS mae_std FROM ev")
def lolo_intervals(spark, d):
    """P10, H4: error and Winkler score of held-out forecasts whose interval scale is held out as well."""
    e = V.model_evidence(held_out(spark, d, True).where("model IN ('ridge', 'huber')"))
    return e.select("parameter_name", "model", r6("mae", 5).alias("mae"), r6("winkler", 4).alias("winkler"), r6("mae_std", 5).alias("mae_std"))


def _gap(c: str) -> str:
    return f"abs(a_{c} - b_{c}) / least(a_{c}, b_{c})"


_TIER = " ".join(f"WHEN {_gap(c)} > 0.005 THEN '{t}'" for t, c in V.TIERS)
_CHOICE = " ".join(f"WHEN {_gap(c)} > 0.005 THEN CASE WHEN a_{c} < b_{c} THEN 'ridge' ELSE 'huber' END" for _, c in V.TIERS)
_GAP = " ".join(f"WHEN {_gap(c)} > 0.005 THEN {_gap(c)}" for _, c in V.TIERS)


@query(
    "model_selection",
    W + EVIDENCE + f""", pv AS (SELECT parameter_name, {', '.join(f"max({c}) FILTER (model = 'ridge') AS a_{c}, max({c}) FILTER (model = 'huber') AS b_{c}" for _, c in V.TIERS)} FROM ev GROUP BY 1),
ch AS (SELECT parameter_name, CASE {_TIER} ELSE '{V.LAST_TIER}' END AS tier, CASE {_CHOICE} ELSE 'ridge' END AS choice, CASE {_GAP} ELSE 0.0::DOUBLE END AS gap FROM pv)
SELECT parameter_name, choice, tier, {o6('gap', 4)} AS relative_gap, coalesce((SELECT max(choice) FROM (SELECT choice FROM ch GROUP BY 1 HAVING count(*) >= 3)), 'SPLIT') AS consensus FROM ch""",
)
def model_selection(spark, d):
    e = V.model_evidence(held_out(spark, d, True).where("model IN ('ridge', 'huber')"))
    return V.select_by_tiers(e, "ridge").select("parameter_name", "choice", "tier", r6("relative_gap", 4).alias("relative_gap"), "consensus")


SPLIT = TRI + ",\n" + PARTS_SQL + f""",
cs AS (SELECT parameter_name, {SUMSQL} FROM tri JOIN lp USING (lot_id) WHERE part = 'CAL' GROUP BY 1), cc AS (SELECT parameter_name, {SOLVE} FROM cs),
vv AS (SELECT t.*, lp.part, c.b0 + c.b1 * u0 + c.b2 * u24 AS uc FROM tri t JOIN lp USING (lot_id) JOIN cc c ON c.parameter_name = t.parameter_name),
vy AS (SELECT *, {inv('uc')} AS y FROM vv)"""


def calibrated(spark, d):
    t = tri(spark, d).join(F.broadcast(lot_partitions(spark, d)), "lot_id")
    return G.guarded(G.score(t, G.ridge_fit(t.where("partition = 'CAL'"))))


@query("pristine_to_defect", W + SPLIT + f" SELECT parameter_name, count(*) AS n, {o6('avg(abs(y - v168))', 5)} AS mae FROM vy WHERE part <> 'CAL' GROUP BY 1")
def pristine_to_defect(spark, d):
    m = V.forecast_metrics(calibrated(spark, d).where("partition <> 'CAL'"), ["parameter_name"], lo=None, hi=None)
    return m.select("parameter_name", "n", r6("mae", 5).alias("mae"))


@query("per_lot_breakdown", W + SPLIT + f" SELECT parameter_name, lot_id, count(*) AS n, {o6('avg(abs(y - v168))', 5)} AS mae, {o6('100 * (1 - avg(abs(y - v168)) / avg(abs(v24 - v168)))', 3)} AS improvement_pct FROM vy WHERE part = 'VAL' GROUP BY 1, 2")
def per_lot_breakdown(spark, d):
    c = calibrated(spark, d).where("partition = 'VAL'")
    mae, base = F.avg(F.abs(F.col("predicted") - F.col("v168"))), F.avg(F.abs(F.col("v24") - F.col("v168")))
    return c.groupBy("parameter_name", "lot_id").agg(F.count(F.lit(1)).alias("n"), r6(mae, 5).alias("mae"), r6(100 * (1 - mae / base), 3).alias("improvement_pct"))


@query("signed_metrics", W + FC + f" SELECT sgn, {METSQL} FROM fc WHERE parameter_name = 'IGSS' GROUP BY 1")
def signed_metrics(spark, d):
    return shown(V.forecast_metrics(forecasts(spark, d).where("parameter_name = 'IGSS'"), ["sgn"]), "sgn")


@query("residual_quantiles", W + FC + f" SELECT parameter_name, count(*) AS n, " + ", ".join(f"{o6(f'quantile_cont(abs(y - v168), {p})')} AS q{round(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + " FROM fc GROUP BY 1")
def residual_quantiles(spark, d):
    q = V.residual_quantiles(forecasts(spark, d).withColumn("e", F.abs(F.col("predicted") - F.col("v168"))), ["parameter_name"], "e")
    return q.select("parameter_name", "n", *[r6(c).alias(c) for c in q.columns if c.startswith("q")])


@query("interval_asymmetry", W + FC + f" SELECT parameter_name, {o6('avg((upper - y) / (y - lower))')} AS ratio, count(*) FILTER (v168 < lower) AS below, count(*) FILTER (v168 > upper) AS above FROM fc GROUP BY 1")
def interval_asymmetry(spark, d):
    f = forecasts(spark, d)
    return f.groupBy("parameter_name").agg(
        r6(F.avg((F.col("upper") - F.col("predicted")) / (F.col("predicted") - F.col("lower")))).alias("ratio"),
        F.count_if(F.col("v168") < F.col("lower")).alias("below"), F.count_if(F.col("v168") > F.col("upper")).alias("above"),
    )


@query("breach_contingency", W + FC + f", b AS (SELECT parameter_name, coalesce(v168 < {LOW}, false) OR coalesce(v168 > {HIGH}, false) AS actual, coalesce(y < {LOW}, false) OR coalesce(y > {HIGH}, false) AS pred FROM fc) SELECT parameter_name, actual, pred, count(*) AS n FROM b GROUP BY 1, 2, 3")
def breach_contingency(spark, d):
    b = P.breach_interpretation(forecasts(spark, d), "v168")
    return b.groupBy("parameter_name", F.col("measured_failure").alias("actual"), F.col("predicted_breach").alias("pred")).agg(F.count(F.lit(1)).alias("n"))


@query("top_errors", W + FC + f", r AS (SELECT *, row_number() OVER (PARTITION BY parameter_name ORDER BY round(abs(y - v168), 9) DESC, component_id) AS rank FROM fc) SELECT parameter_name, rank, component_id, {o6('abs(y - v168)')} AS abs_error FROM r WHERE rank <= 5")
def top_errors(spark, d):
    t = V.top_errors(forecasts(spark, d).withColumn("abs_error", F.round(F.abs(F.col("predicted") - F.col("v168")), 9)), ["parameter_name"])
    return t.select("parameter_name", F.col("rank").cast("bigint").alias("rank"), "component_id", r6("abs_error").alias("abs_error"))


CONFUSION = W + component_ctes(24) + "," + TRI[TRI.index("\ntri AS") : TRI.index("\nlk AS")] + LAB + """,
cm AS (SELECT count(*) FILTER (f AND defective) AS tp, count(*) FILTER (f AND NOT defective) AS fp, count(*) FILTER (NOT f AND defective) AS fn, count(*) FILTER (NOT f AND NOT defective) AS tn FROM (SELECT defective, coalesce(state IN ('FAIL', 'ALERT', 'HOLD'), false) AS f FROM lab LEFT JOIN cf USING (component_id)))"""
STATIC = TRI + ",\n" + LAB + f""",
sm AS (SELECT parameter_name, count(*) FILTER (f AND defective) AS tp, count(*) FILTER (f AND NOT defective) AS fp, count(*) FILTER (NOT f AND defective) AS fn, count(*) FILTER (NOT f AND NOT defective) AS tn FROM
 (SELECT parameter_name, abs(u168 - u0) > cut AS defective, abs(u24 - u0) > 0.5 * cut AS f FROM tri JOIN ab USING (parameter_name)) GROUP BY 1)"""


def counts(spark, d):
    c = S.screen_components(A.telemetry_parts(spark, d), 24, evidence=False).select("component_id", F.col("final.state").isin("FAIL", "ALERT", "HOLD").alias("flagged"))
    return V.confusion(c, labels(spark, d))


@query("confusion", CONFUSION + f" SELECT tp, fp, fn, tn, {o6('tp / (tp + fp)')} AS precision, {o6('tp / (tp + fn)')} AS recall FROM cm")
def confusion(spark, d):
    return counts(spark, d).select("tp", "fp", "fn", "tn", r6("precision").alias("precision"), r6("recall").alias("recall"))


COST = CONFUSION + f""",
st AS (SELECT count(*) FILTER (s AND NOT defective) AS sfp, count(*) FILTER (NOT s AND defective) AS sfn FROM (SELECT defective, coalesce(b, false) AS s FROM lab LEFT JOIN (SELECT component_id, bool_or(spec_status = 'SPEC_BREACH') AS b FROM spec GROUP BY 1) USING (component_id)))
SELECT CAST(r AS INTEGER) AS ratio, r * fn + fp AS cost, r * sfn + sfp AS static_cost, {o6('(r * fn + fp) / (tp + fp + fn + tn)')} AS normalised, {o6('(r * sfn + sfp) / (tp + fp + fn + tn)')} AS static_normalised, {o6('(r * sfn + sfp) / nullif(r * fn + fp, 0)')} AS reduction
FROM cm, st, (VALUES (1), (2), (5), (10), (20), (50)) v(r)"""


@query("cost_curve", COST)
def cost_curve(spark, d):
    breach = F.exists("params", lambda p: p["spec"]["status"] == "SPEC_BREACH").alias("static")
    c = cut(S.screen_components(A.telemetry_parts(spark, d), 24).select("component_id", F.col("final.state").isin("FAIL", "ALERT", "HOLD").alias("flagged"), breach))
    lab = cut(labels(spark, d))
    static = V.confusion(c.select("component_id", F.col("static").alias("flagged")), lab).select(F.col("fp").alias("static_fp"), F.col("fn").alias("static_fn"))
    curve = V.cost_curve(V.confusion(c, lab).crossJoin(static))
    return curve.select("ratio", "cost", "static_cost", *[r6(x).alias(x) for x in ("normalised", "static_normalised", "reduction")])


@query("threshold_metrics", W + STATIC + f" SELECT parameter_name, tp, fp, fn, tn, {o6('tp / nullif(tp + fp, 0)')} AS precision, {o6('tp / nullif(tp + fn, 0)')} AS recall, {o6('tn / nullif(tn + fp, 0)')} AS specificity, {o6('2 * tp / nullif(2 * tp + fp + fn, 0)')} AS f1 FROM sm")
def threshold_metrics(spark, d):
    from emberline.operators.ranks import group_quantiles

    t = tri(spark, d).withColumn("m", F.abs(F.col("u168") - F.col("u0")))
    q = group_quantiles(t, ["parameter_name"], "m", [0.9]).select("parameter_name", F.col("q")[0].alias("cut"))
    t = t.join(q, "parameter_name").select("parameter_name", (F.col("m") > F.col("cut")).alias("y"), (F.abs(F.col("u24") - F.col("u0")) > 0.5 * F.col("cut")).alias("f"))
    c = t.groupBy("parameter_name").agg(*[F.count_if((F.col("f") == a) & (F.col("y") == b)).alias(n) for n, a, b in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    return V.with_rates(c).select("parameter_name", "tp", "fp", "fn", "tn", *[r6(x).alias(x) for x in ("precision", "recall", "specificity", "f1")])


@query("error_table", W + FC + f" SELECT parameter_name, count(*) AS n, {o6('avg(abs(y - v168))', 5)} AS mae, {o6('median(abs(y - v168))', 5)} AS median_ae, {o6('avg(y - v168)', 5)} AS bias, {o6('avg(abs(y - v168)) / avg(abs(v168))', 5)} AS nmae FROM fc GROUP BY 1")
def error_table(spark, d):
    from emberline.operators.ranks import group_median

    f = forecasts(spark, d).withColumn("e", F.abs(F.col("predicted") - F.col("v168")))
    m = f.groupBy("parameter_name").agg(r6(F.avg("e"), 5).alias("mae"), r6(F.avg(F.col("predicted") - F.col("v168")), 5).alias("bias"), r6(F.avg("e") / F.avg(F.abs("v168")), 5).alias("nmae"))
    return m.join(group_median(f, ["parameter_name"], "e", "median_ae"), "parameter_name").withColumn("median_ae", r6("median_ae", 5))


HELD = TRI + f""",
hc AS (SELECT *, u168 - u24 AS dy FROM tri WHERE {part(2)} = 0), he AS (SELECT * FROM tri WHERE {part(2)} = 1),
{ridge('cd', 'hc', 'parameter_name')}, {ridge('cr', 'hc', 'parameter_name', 'dy')}"""


@query("relative_vs_direct", W + HELD + f""", p AS (SELECT e.*, d.b0 + d.b1 * u0 + d.b2 * u24 AS ua, u24 + r.b0 + r.b1 * u0 + r.b2 * u24 AS ub FROM he e JOIN cd d USING (parameter_name) JOIN cr r USING (parameter_name)),
q AS (SELECT parameter_name, abs({inv('ua')} - v168) AS ea, abs({inv('ub')} - v168) AS eb FROM p),
m AS (SELECT parameter_name, count(*) AS n, avg(ea) AS a, avg(eb) AS b, sqrt(avg(ea * ea)) AS ra, sqrt(avg(eb * eb)) AS rb, median(ea) AS ma, median(eb) AS mb FROM q GROUP BY 1)
SELECT parameter_name, n, {o6('a', 5)} AS mae_direct, {o6('b', 5)} AS mae_relative, {o6('ra', 5)} AS rmse_direct, {o6('rb', 5)} AS rmse_relative, {o6('ma', 5)} AS medae_direct, {o6('mb', 5)} AS medae_relative, {o6('100 * (b - a) / greatest(a, 1e-9)', 4)} AS mae_gap_pct, CASE WHEN b <= a THEN 'relative_delta' ELSE 'direct_level' END AS better FROM m""")
def relative_vs_direct(spark, d):
    h = V.held_out_target(tri(spark, d))
    return h.select("parameter_name", "n", *[r6(f"{m}_{k}", 5).alias(f"{m}_{k}") for k in ("direct", "relative") for m in ("mae", "rmse", "medae")], r6("mae_gap_pct", 4).alias("mae_gap_pct"), "better")


GRID = ", ".join(f"({10.0 ** (-3.0 + i * 6.0 / 49)!r}::DOUBLE)" for i in range(50))


@query("lambda_sweep", W + TRI + f""", fd AS (SELECT *, {part(5)} AS fold FROM tri), tr AS (SELECT l.lam, h.fold AS held, f.* FROM fd f JOIN (SELECT DISTINCT parameter_name, fold FROM fd) h ON h.parameter_name = f.parameter_name AND h.fold <> f.fold, (VALUES {GRID}) l(lam)),
{ridge('lw', 'tr', 'parameter_name, held, lam', lam='lam')},
pe AS (SELECT f.parameter_name, w.lam, f.fold, v168, w.b0 + w.b1 * u0 + w.b2 * u24 AS uh FROM fd f JOIN lw w ON w.parameter_name = f.parameter_name AND w.held = f.fold),
pf AS (SELECT parameter_name, lam, fold, avg(abs({inv('uh')} - v168)) AS mae FROM pe GROUP BY 1, 2, 3)
SELECT parameter_name, {o6('lam')} AS lam, {o6('avg(mae)', 5)} AS cv_mae, count(*) AS folds FROM pf GROUP BY parameter_name, lam""")
def lambda_sweep(spark, d):
    return V.lambda_sweep(tri(spark, d)).select("parameter_name", r6("lam").alias("lam"), r6("cv_mae", 5).alias("cv_mae"), "folds")


@query("lambda_choice", W + TRI + f""", fd AS (SELECT *, {part(5)} AS fold FROM tri), tr AS (SELECT l.lam, h.fold AS held, f.* FROM fd f JOIN (SELECT DISTINCT parameter_name, fold FROM fd) h ON h.parameter_name = f.parameter_name AND h.fold <> f.fold, (VALUES {GRID}, (1.0::DOUBLE)) l(lam)),
{ridge('lw', 'tr', 'parameter_name, held, lam', lam='lam')},
pe AS (SELECT f.parameter_name, w.lam, f.fold, v168, w.b0 + w.b1 * u0 + w.b2 * u24 AS uh FROM fd f JOIN lw w ON w.parameter_name = f.parameter_name AND w.held = f.fold),
pf AS (SELECT parameter_name, lam, fold, avg(abs({inv('uh')} - v168)) AS mae FROM pe GROUP BY 1, 2, 3), cv AS (SELECT parameter_name, lam, avg(mae) AS m FROM pf GROUP BY 1, 2),
ck AS (SELECT parameter_name, arg_min(lam, m) FILTER (lam <> 1) AS bl, min(m) FILTER (lam <> 1) AS bm, max(m) FILTER (lam = 1) AS lm FROM cv GROUP BY 1)
SELECT parameter_name, {o6('bl')} AS optimal_lambda, {o6('bm', 5)} AS optimal_mae, {o6('lm', 5)} AS locked_mae, {o6('100 * (lm - bm) / bm', 4)} AS gap_pct, 100 * (lm - bm) / bm <= 0.5 AS within_half_percent FROM ck""")
def lambda_choice(spark, d):
    c = V.lambda_choice(tri(spark, d))
    return c.select("parameter_name", r6("optimal_lambda").alias("optimal_lambda"), r6("optimal_mae", 5).alias("optimal_mae"), r6("locked_mae", 5).alias("locked_mae"), r6("gap_pct", 4).alias("gap_pct"), "within_half_percent")


SPLIT = "(CAST('0x' || substr(md5(split || lot_id), 1, 8) AS BIGINT) % 4)"


@query("multi_split", W + TRI + f""", sp AS (SELECT split, {SPLIT} = 0 AS held, t.* FROM tri t, (VALUES ('A'), ('B'), ('C'), ('D')) s(split)), st AS (SELECT * FROM sp WHERE NOT held),
{ridge('ms', 'st', 'parameter_name, split', penal=False)},
pr AS (SELECT p.split, p.parameter_name, v24, v168, m.b0 + m.b1 * u0 + m.b2 * u24 AS uh FROM sp p JOIN ms m ON m.parameter_name = p.parameter_name AND m.split = p.split WHERE held), py AS (SELECT *, CASE WHEN abs(uh) > 10 THEN v24 ELSE {inv('uh')} END AS y FROM pr)
SELECT split, parameter_name, count(*) AS n, {o6('avg(abs(y - v168))', 5)} AS mae, {o6('sqrt(avg((y - v168) * (y - v168)))', 5)} AS rmse FROM py GROUP BY 1, 2""")
def multi_split(spark, d):
    """Named train / validation lot splits, fitted together by one grouped aggregate."""
    t = tri(spark, d).withColumn("split", F.explode(F.array(*[F.lit(x) for x in "ABCD"])))
    t = t.withColumn("name", F.concat("split", "lot_id")).withColumn("held", V.lot_part(4, "name") == 0)
    coef = G.ridge_fit(t.where(~F.col("held")), ["parameter_name", "split"])
    s = G.guarded(G.score(t.where("held"), coef, ["parameter_name", "split"]))
    m = V.forecast_metrics(s, ["split", "parameter_name"], lo=None, hi=None)
    return m.select("split", "parameter_name", "n", r6("mae", 5).alias("mae"), r6("rmse", 5).alias("rmse"))


@query("regime_conformal", W + HELD + f""", r AS (SELECT t.parameter_name, {part(2)} AS half, abs(u24 - u0) AS mv, abs(u168 - (d.b0 + d.b1 * u0 + d.b2 * u24)) AS e FROM tri t JOIN cd d USING (parameter_name)),
k AS (SELECT parameter_name, median(mv) AS tau, quantile_cont(e, 0.9) AS qg FROM r WHERE half = 0 GROUP BY 1),
kq AS (SELECT parameter_name, quantile_cont(e, 0.9) FILTER (mv <= tau) AS qn, quantile_cont(e, 0.9) FILTER (mv > tau) AS qd FROM r JOIN k USING (parameter_name) WHERE half = 0 GROUP BY 1)
SELECT parameter_name, count(*) AS n, {o6('any_value(tau)')} AS tau, {o6('any_value(qg)')} AS q_global, {o6('any_value(qn)')} AS q_quiet, {o6('any_value(qd)')} AS q_moving, {o6('avg((e <= qg)::INT)')} AS uniform_all, {o6('avg((e <= qg)::INT) FILTER (mv > tau)')} AS uniform_moving,
 {o6('avg((e <= CASE WHEN mv <= tau THEN qn ELSE qd END)::INT)')} AS regime_all, {o6('avg((e <= qd)::INT) FILTER (mv > tau)')} AS regime_moving FROM r JOIN k USING (parameter_name) JOIN kq USING (parameter_name) WHERE half = 1 GROUP BY 1""")
def regime_conformal(spark, d):
    c = V.regime_coverage(tri(spark, d))
    return c.select("parameter_name", "n", *[r6(x).alias(x) for x in ("tau", "q_global", "q_quiet", "q_moving", "uniform_all", "uniform_moving", "regime_all", "regime_moving")])


@query("sensor_enrichment", """WITH c AS (SELECT vec_id AS row_id, i AS s, CASE WHEN (vec_id * 31 + i - 1) % 17 = 0 THEN NULL ELSE CAST(embedding[i] AS DOUBLE) END AS v FROM embeddings, range(1, 65) t(i)),
m AS (SELECT s, median(v) AS med, count(*) AS n, count(v) AS h FROM c GROUP BY 1), k AS (SELECT c.s, any_value(med) AS med, median(abs(v - med)) AS mad FROM c JOIN m USING (s) GROUP BY 1), g AS (SELECT k.* FROM k JOIN m USING (s) WHERE mad > 1e-6 AND 1 - h / n <= 0.5),
z AS (SELECT row_id, count(*) FILTER (abs(coalesce(v, med) - med) / (1.4826 * mad) >= 3.5) AS ne, round(sqrt(sum(pow(abs(coalesce(v, med) - med) / (1.4826::DOUBLE * mad), 2)) / (SELECT count(*) FROM g)), 9) AS rms FROM c JOIN g USING (s) GROUP BY 1),
r AS (SELECT z.*, (e.label = 0)::INT AS f, row_number() OVER (ORDER BY ne DESC, rms DESC, row_id) AS rk FROM z JOIN embeddings e ON e.vec_id = z.row_id)
SELECT CAST(k AS INTEGER) AS k, CAST(sum(f) AS BIGINT) AS hits, round(sum(f) / k, 6) AS precision, round((sum(f) / k) / (SELECT avg(f) FROM r), 6) AS lift FROM r JOIN (VALUES (10), (20), (50), (100), (150)) v(k) ON rk <= k GROUP BY k""")
def sensor_enrichment(spark, d):
    e = V.sensor_enrichment(A.sensor_matrix(spark, d), A.row_labels(spark, d))
    return e.select("k", "hits", r6("precision").alias("precision"), r6("lift").alias("lift"))


@query("regime_occupancy", W + ZA + f" SELECT parameter_name, count(*) AS n, count(*) FILTER (regime = 'ZERO_ANCHORED') AS zero_anchored, count(*) FILTER (regime = 'DRIFT_MODEL') AS drift_model, {o6('100.0 * count(*) FILTER (regime = ' + chr(39) + 'ZERO_ANCHORED' + chr(39) + ') / count(*)', 4)} AS zero_anchored_pct FROM za GROUP BY 1")
def regime_occupancy(spark, d):
    o = V.regime_occupancy(anchored(spark, d), "parameter_name", ["ZERO_ANCHORED", "DRIFT_MODEL"])
    return o.select("parameter_name", "n", "zero_anchored", "drift_model", r6("zero_anchored_pct", 4).alias("zero_anchored_pct"))


@query("coverage_table", W + ZA + f", v AS (SELECT ci.parameter_name, regime, l90, h90, t.v168 FROM ci JOIN tri t USING (component_id, parameter_name)) SELECT parameter_name, regime, count(*) AS n, {o6('avg((v168 BETWEEN l90 AND h90)::INT)')} AS coverage FROM v GROUP BY GROUPING SETS ((parameter_name), (regime), (parameter_name, regime), ())".replace("ci JOIN tri t USING", "(SELECT component_id, parameter_name, regime, l90, h90 FROM ci) ci JOIN tri t USING"))
def coverage_table(spark, d):
    t = tri(spark, d).select(*ID, "v168")
    c = anchored(spark, d).join(t, ID)
    m = V.metrics_by(c, ["parameter_name", "regime"], [["parameter_name"], ["regime"], ["parameter_name", "regime"], []], lo="low_90", hi="high_90")
    return m.select("parameter_name", "regime", "n", r6("coverage").alias("coverage"))


@query("joint_eval", CONFUSION + f" SELECT defective, count(*) AS n, {o6('avg(d)', 4)} AS mean, count(*) FILTER (d >= 4.25) AS flagged, {o6('quantile_cont(d, 0.05)', 4)} AS p05, {o6('quantile_cont(d, 0.95)', 4)} AS p95 FROM lab JOIN jd USING (component_id) GROUP BY 1")
def joint_eval(spark, d):
    """Joint distance by label: mean, upper / lower quantile, precision, recall."""
    from emberline.operators.ranks import group_quantiles

    lab = labels(spark, d).groupBy("component_id").agg(F.bool_or("is_defective").alias("defective"))
    j = S.joint_only(A.telemetry_parts(spark, d), 24).select("component_id", F.col("joint.distance").alias("dist"), F.col("joint.suspected").alias("hit"))
    j = lab.join(j.where("dist IS NOT NULL"), "component_id")
    g = j.groupBy("defective").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("dist"), 4).alias("mean"), F.count_if("hit").alias("flagged"))
    q = group_quantiles(j, ["defective"], "dist", [0.05, 0.95]).select("defective", F.col("q")[0].alias("p05"), F.col("q")[1].alias("p95"))
    return g.join(q, "defective").select("defective", "n", "mean", "flagged", r6("p05", 4).alias("p05"), r6("p95", 4).alias("p95"))


@query("joint_separation", CONFUSION + f""", jpart AS (SELECT defective, d, d >= 4.25 AS hit FROM lab JOIN jd USING (component_id) WHERE d IS NOT NULL),
jsum AS (SELECT count(*) AS n, avg(d) FILTER (NOT defective) AS a, avg(d) FILTER (defective) AS b, count(*) FILTER (defective AND hit) AS tp, count(*) FILTER (NOT defective AND hit) AS fp, count(*) FILTER (defective AND NOT hit) AS fn, count(*) FILTER (NOT defective AND NOT hit) AS tn FROM jpart)
SELECT n, {o6('a', 4)} AS mean_nominal, {o6('b', 4)} AS mean_defective, tp, fp, fn, tn, {o6('b / a', 4)} AS separation_ratio, {o6('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)', 4)} AS precision, {o6('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)', 4)} AS recall FROM jsum""")
def joint_separation(spark, d):
    lab = labels(spark, d).groupBy("component_id").agg(F.bool_or("is_defective").alias("defective"))
    j = S.joint_only(A.telemetry_parts(spark, d), 24).select("component_id", F.col("joint.distance").alias("dist"), F.col("joint.suspected").alias("hit"))
    s = V.separation(lab.join(j, "component_id"), "dist", "defective", "hit")
    return s.select("n", "tp", "fp", "fn", "tn", *[r6(c, 4).alias(c) for c in ("mean_nominal", "mean_defective", "separation_ratio", "precision", "recall")])


@query("fn_fp_tables", CONFUSION + " SELECT lot_id, qualifier, defective, count(*) AS n FROM lab JOIN cf USING (component_id) WHERE defective <> (state IN ('FAIL', 'ALERT', 'HOLD')) GROUP BY 1, 2, 3")
def fn_fp_tables(spark, d):
    lab = labels(spark, d).groupBy("component_id").agg(F.bool_or("is_defective").alias("defective"))
    c = S.screen_components(A.telemetry_parts(spark, d), 24, evidence=False).select("component_id", "lot_id", "final.qualifier", F.col("final.state").isin("FAIL", "ALERT", "HOLD").alias("f"))
    return lab.join(c, "component_id").where("defective <> f").groupBy("lot_id", "qualifier", "defective").agg(F.count(F.lit(1)).alias("n"))
