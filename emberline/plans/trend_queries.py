"""Queries of null-calibrated trend inference."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions.scalars import r6, wilson
from emberline.operators import represent as R
from emberline.operators import trend as K
from emberline.plans.catalog import query
from emberline.plans.oracle_parts import EXCL, TU, med_mad
from emberline.plans.oracle_parts import r6 as o6
from emberline.plans.quality_queries import PARTS_SQL, lot_partitions
from emberline.sources import adapters as A

ID = ["component_id", "parameter_name"]
W = "WITH "
EXC = TU + f""",
ex AS (SELECT * FROM (SELECT *, u - median(u) OVER (PARTITION BY lot_id, parameter_name, elapsed_hours {EXCL}) AS e FROM tu WHERE u IS NOT NULL) WHERE e IS NOT NULL),
pr AS (SELECT a.component_id, a.lot_id, a.parameter_name, avg(sign(b.e - a.e)) AS tau, median((b.e - a.e) / (b.elapsed_hours - a.elapsed_hours)) AS slope FROM ex a JOIN ex b ON a.component_id = b.component_id AND a.parameter_name = b.parameter_name AND b.elapsed_hours > a.elapsed_hours GROUP BY 1, 2, 3),
og AS (SELECT component_id, parameter_name, count(*) AS k, regr_slope(e, elapsed_hours) AS b, regr_sxx(e, elapsed_hours) AS sxx, regr_syy(e, elapsed_hours) AS syy FROM ex GROUP BY 1, 2),
st AS (SELECT pr.component_id, pr.lot_id, pr.parameter_name, pr.tau, round(pr.slope, 10) AS slope, og.k, CASE WHEN k >= 3 THEN b / sqrt((syy - b * b * sxx) / (k - 2) / sxx) END AS ols_t FROM pr JOIN og USING (component_id, parameter_name)),
""" + PARTS_SQL
EP = EXC + """,
rf AS (SELECT st.* FROM st JOIN lp USING (lot_id) WHERE part = 'CAL'), ob AS (SELECT st.* FROM st JOIN lp USING (lot_id) WHERE part <> 'CAL'),
ep AS (SELECT o.component_id, o.lot_id, o.parameter_name, o.k, (1.0::DOUBLE + (SELECT count(*) FROM rf r WHERE r.parameter_name = o.parameter_name AND r.k = o.k AND abs(r.slope) >= abs(o.slope))) / (1.0::DOUBLE + (SELECT count(*) FROM rf r WHERE r.parameter_name = o.parameter_name AND r.k = o.k)) AS p FROM ob o)"""


def tu(spark, d):
    return R.with_u(A.telemetry_parts(spark, d), last_bit=True)


def stats(spark, d):
    return K.trend_statistics(K.loo_excess(tu(spark, d)))


def split(spark, d):
    # last-digit noise of equal slopes is rounded away before they are ranked
    st, lp = stats(spark, d).withColumn("slope", F.round("slope", 10)), lot_partitions(spark, d)
    cal = lp.where("partition = 'CAL'").select("lot_id")
    return st.join(cal, "lot_id", "left_semi"), st.join(cal, "lot_id", "left_anti")


def pvalues(spark, d):
    ref, obs = split(spark, d)
    return K.empirical_p(obs, ref, ["parameter_name", "k"], "slope")


@query("loo_excess", W + EXC + f" SELECT component_id, parameter_name, elapsed_hours, {o6('e')} AS excess FROM ex")
def loo_excess(spark, d):
    return K.loo_excess(tu(spark, d)).select(*ID, "elapsed_hours", r6("excess").alias("excess"))


@query("kendall_tau", W + EXC + f" SELECT component_id, parameter_name, {o6('tau')} AS tau FROM st")
def kendall_tau(spark, d):
    return stats(spark, d).select(*ID, r6("tau").alias("tau"))


@query("theil_sen_excess", W + EXC + f" SELECT component_id, parameter_name, {o6('slope', 8)} AS slope FROM st")
def theil_sen_excess(spark, d):
    return stats(spark, d).select(*ID, r6("slope", 8).alias("slope"))


@query("ols_t", W + EXC + f" SELECT component_id, parameter_name, {o6('ols_t', 4)} AS ols_t FROM st")
def ols_t(spark, d):
    return stats(spark, d).select(*ID, r6("ols_t", 4).alias("ols_t"))


@query(
    "endpoint_drift",
    W + TU + ",\nz AS (SELECT * FROM tu WHERE elapsed_hours = 0),\n" + med_mad("m", "z", "lot_id, parameter_name")
    + f""", e AS (SELECT component_id, lot_id, parameter_name, any_value(flr) AS flr, arg_min(u, elapsed_hours) AS a, arg_max(u, elapsed_hours) AS b FROM tu GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT e.component_id, e.parameter_name, {o6('(b - a) / greatest(1.4826::DOUBLE * mad, flr)')} AS g, abs((b - a) / greatest(1.4826::DOUBLE * mad, flr)) >= 2.5 AS breach FROM e JOIN m ON e.lot_id = m.lot_id AND e.parameter_name = m.parameter_name""",
)
def endpoint_drift(spark, d):
    return K.endpoint_drift(tu(spark, d)).select(*ID, r6("g").alias("g"), "breach")


@query("empirical_p", W + EP + f" SELECT component_id, parameter_name, {o6('p')} AS p FROM ep")
def empirical_p(spark, d):
    return pvalues(spark, d).select(*ID, r6("p").alias("p"))


@query(
    "critical_threshold",
    W + EP + f", o AS (SELECT parameter_name, abs(slope) AS s, k, row_number() OVER (PARTITION BY parameter_name, k ORDER BY abs(slope) DESC) AS rn, count(*) OVER (PARTITION BY parameter_name, k) AS n FROM rf WHERE slope IS NOT NULL) SELECT parameter_name, k, n, {o6('s', 8)} AS threshold FROM o WHERE n >= 99 AND rn = CAST(floor(0.01::DOUBLE * (n + 1) - 1 + 1e-9) AS BIGINT) + 1",
)
def critical_threshold(spark, d):
    ref, _ = split(spark, d)
    # one threshold per number of checkpoints; below 99 references a level of 1 % has none
    out = K.critical_threshold(ref.where("slope IS NOT NULL"), ["parameter_name", "k"], "slope", 0.01).where("n >= 99")
    return out.select("parameter_name", "k", "n", r6("threshold", 8).alias("threshold"))


HOLM = EP + """,
h0 AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY p, parameter_name) AS step, count(*) OVER (PARTITION BY component_id) AS m FROM ep),
h1 AS (SELECT *, min(CASE WHEN p <= 0.05::DOUBLE / (m - step + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY component_id ORDER BY p, parameter_name ROWS UNBOUNDED PRECEDING) = 1 AS reject FROM h0)"""


@query("holm", W + HOLM + f" SELECT component_id, parameter_name, step, {o6('p')} AS p, reject FROM h1")
def holm(spark, d):
    return K.holm(pvalues(spark, d), 0.05).select(*ID, F.col("step").cast("bigint").alias("step"), r6("p").alias("p"), "reject")


@query(
    "holm_steps",
    W + EP + """, r AS (SELECT component_id, p, rank() OVER (PARTITION BY component_id ORDER BY p) - 1 AS r, count(*) OVER (PARTITION BY component_id) AS m FROM ep),
 g AS (SELECT component_id, count(*) FILTER (p <= 0.05::DOUBLE / (m - r)) AS n_hits, min(r) FILTER (p > 0.05::DOUBLE / (m - r)) AS fm FROM r GROUP BY 1)
SELECT component_id, n_hits, coalesce(least(n_hits, fm), n_hits) AS n_reject FROM g""",
)
def holm_steps(spark, d):
    return K.holm_steps(pvalues(spark, d), 0.05).select("component_id", "n_hits", F.col("n_reject").cast("bigint").alias("n_reject"))


def _wilson(k, n):
    z = "1.959963984540054::DOUBLE"
    p = f"({k}::DOUBLE / {n})"
    half = f"{z} * sqrt(({p} * (1 - {p}) + {z} * {z} / (4 * {n})) / {n})"
    mid, den = f"({p} + {z} * {z} / (2 * {n}))", f"(1 + {z} * {z} / {n})"
    return (
        f"CASE WHEN {k} = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, ({mid} - {half}) / {den}) END",
        f"CASE WHEN {k} = {n} THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, ({mid} + {half}) / {den}) END",
    )


LO, HI = _wilson("k", "n")


@query("wilson_ci", W + HOLM + f", c AS (SELECT parameter_name, count(*) AS n, count(*) FILTER (reject) AS k FROM h1 GROUP BY 1) SELECT parameter_name, n, k, {o6(LO)} AS low, {o6(HI)} AS high FROM c")
def wilson_ci(spark, d):
    g = K.holm(pvalues(spark, d), 0.05).groupBy("parameter_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("reject").alias("k"))
    low, high = wilson("k", "n")
    return g.select("parameter_name", "n", "k", r6(low).alias("low"), r6(high).alias("high"))


@query(
    "reference_table",
    W + EP + f""", x AS (SELECT parameter_name, k, round(tau, 9) AS tau FROM rf), t AS (SELECT parameter_name, k, tau, count(*) AS c FROM x GROUP BY 1, 2, 3),
 t2 AS (SELECT parameter_name, k, count(*) AS n_distinct, CAST(coalesce(sum(c) FILTER (c > 1), 0) AS BIGINT) AS n_tied FROM t GROUP BY 1, 2)
SELECT x.parameter_name, x.k, count(*) AS n, any_value(n_distinct) AS n_distinct, any_value(n_tied) AS n_tied, {o6('min(tau)')} AS min, {o6('max(tau)')} AS max, {o6('avg(tau)')} AS mean, {o6('stddev_pop(tau)')} AS std,
 {o6('quantile_cont(tau, 0.5)')} AS q50, {o6('quantile_cont(tau, 0.9)')} AS q90, {o6('quantile_cont(tau, 0.95)')} AS q95, {o6('quantile_cont(tau, 0.99)')} AS q99 FROM x JOIN t2 ON x.parameter_name = t2.parameter_name AND x.k = t2.k GROUP BY 1, 2""",
)
def reference_table(spark, d):
    ref, _ = split(spark, d)
    out = K.reference_table(ref.withColumn("tau", F.round("tau", 9)), ["parameter_name", "k"], "tau")
    return out.select("parameter_name", F.col("k").cast("bigint").alias("k"), "n", "n_distinct", "n_tied", *[r6(c).alias(c) for c in ("min", "max", "mean", "std", "q50", "q90", "q95", "q99")])


@query(
    "fpr_rollup",
    W + EP + f""", c AS (SELECT k AS points, parameter_name, count(*) AS n, count(*) FILTER (p <= 0.05) AS k FROM ep GROUP BY ROLLUP (points, parameter_name))
SELECT points, parameter_name, n, k, {o6('k::DOUBLE / n')} AS rate, {o6(LO)} AS low, {o6(HI)} AS high FROM c""",
)
def fpr_rollup(spark, d):
    p = pvalues(spark, d).withColumn("hit", F.col("p") <= 0.05).withColumn("points", F.col("k").cast("bigint")).drop("k")
    out = K.rate_rollup(p, ["points", "parameter_name"], "hit")
    return out.select("points", "parameter_name", "n", "k", *[r6(c).alias(c) for c in ("rate", "low", "high")])


_BOUNDS = {c: _wilson(f"k_{c}", "n") for c in ("excess", "raw")}
_STEP = "/ (b.elapsed_hours - a.elapsed_hours)"


@query(
    "excess_versus_raw",
    W + EXC + f""",
sl AS MATERIALIZED (SELECT a.component_id, a.lot_id, a.parameter_name, round(median((b.e - a.e) {_STEP}), 10) AS excess, round(median((b.u - a.u) {_STEP}), 10) AS raw FROM ex a JOIN ex b ON a.component_id = b.component_id AND a.parameter_name = b.parameter_name AND b.elapsed_hours > a.elapsed_hours GROUP BY 1, 2, 3),
sk AS MATERIALIZED (SELECT sl.*, og.k, part = 'CAL' AS cal FROM sl JOIN og USING (component_id, parameter_name) JOIN lp USING (lot_id)),
lg AS MATERIALIZED (SELECT component_id, parameter_name, k, cal, 'excess' AS coordinate, abs(excess) AS s FROM sk UNION ALL SELECT component_id, parameter_name, k, cal, 'raw', abs(raw) FROM sk),
pv AS (SELECT o.component_id, o.parameter_name, o.coordinate, (1.0::DOUBLE + (SELECT count(*) FROM lg r WHERE r.cal AND r.coordinate = o.coordinate AND r.parameter_name = o.parameter_name AND r.k = o.k AND r.s >= o.s)) / (1.0::DOUBLE + (SELECT count(*) FROM lg r WHERE r.cal AND r.coordinate = o.coordinate AND r.parameter_name = o.parameter_name AND r.k = o.k)) AS p FROM lg o WHERE NOT o.cal),
wd AS (SELECT component_id, parameter_name, bool_or(p <= 0.05 AND coordinate = 'excess') AS he, bool_or(p <= 0.05 AND coordinate = 'raw') AS hr FROM pv GROUP BY 1, 2),
c AS (SELECT parameter_name, count(*) AS n, count(*) FILTER (he) AS k_excess, count(*) FILTER (hr) AS k_raw, count(*) FILTER (he AND hr) AS k_both FROM wd GROUP BY 1)
SELECT parameter_name, n, k_excess, k_raw, k_both, {o6('k_excess::DOUBLE / n')} AS rate_excess, {o6(_BOUNDS['excess'][0])} AS low_excess, {o6(_BOUNDS['excess'][1])} AS high_excess,
 {o6('k_raw::DOUBLE / n')} AS rate_raw, {o6(_BOUNDS['raw'][0])} AS low_raw, {o6(_BOUNDS['raw'][1])} AS high_raw, {o6('k_raw::DOUBLE / n - k_excess::DOUBLE / n')} AS gap FROM c""",
)
def excess_versus_raw(spark, d):
    cal = lot_partitions(spark, d).where("partition = 'CAL'")
    out = K.excess_versus_raw(K.loo_excess(tu(spark, d)), cal)
    shown = [f"{v}_{c}" for c in ("excess", "raw") for v in ("rate", "low", "high")]
    return out.select("parameter_name", "n", "k_excess", "k_raw", "k_both", *[r6(c).alias(c) for c in [*shown, "gap"]])


@query("trend_screen", W + EP.replace("abs(r.slope) >= abs(o.slope)", "abs(r.tau) >= abs(o.tau) - 1e-9") + f""",
h0 AS (SELECT *, row_number() OVER (PARTITION BY component_id ORDER BY p, parameter_name) AS step, count(*) OVER (PARTITION BY component_id) AS m FROM ep)
SELECT component_id, parameter_name, {o6('p')} AS p, min(CASE WHEN p <= 0.001::DOUBLE / (m - step + 1) THEN 1 ELSE 0 END) OVER (PARTITION BY component_id ORDER BY p, parameter_name ROWS UNBOUNDED PRECEDING) = 1 AS reject FROM h0""")
def trend_screen(spark, d):
    cal = lot_partitions(spark, d).where("partition = 'CAL'")
    return K.trend_screen(tu(spark, d), cal).select(*ID, r6("p").alias("p"), "reject")


@query("lag1_autocorr", W + TU + f", l AS (SELECT parameter_name, u, lag(u) OVER (PARTITION BY component_id, parameter_name ORDER BY elapsed_hours) AS p FROM tu) SELECT parameter_name, count(p) AS n_pairs, {o6('corr(u, p)')} AS rho FROM l GROUP BY 1")
def lag1_autocorr(spark, d):
    return K.lag1_autocorrelation(tu(spark, d)).withColumn("rho", r6("rho"))
