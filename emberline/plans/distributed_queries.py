"""The rank-kernel queries once more with a tiny group limit, so that the route of large groups is checked as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions.scalars import r6
from emberline.operators import ranks as R
from emberline.operators.loo import with_loo
from emberline.plans.catalog import ORACLES, QUERIES, query
from emberline.plans.oracle_parts import r6 as o6
from emberline.sources.adapters import table

LIMIT = "emberline.group.limit"
KERNEL = ["loo_scale", "lot_median_mad", "d_channel", "empirical_p", "conformal_quantiles"]


def _register(base: str) -> None:
    @query(f"{base}_distributed", ORACLES[base])
    def run(spark, d):
        before = spark.conf.get(LIMIT, None)
        spark.conf.set(LIMIT, "15")
        try:
            return QUERIES[base](spark, d)
        finally:
            spark.conf.unset(LIMIT) if before is None else spark.conf.set(LIMIT, before)


for name in KERNEL:
    _register(name)


# Groups that exceed what one aggregation sorts at the default limit already on the small data sets
ROWS_SQL = "rw AS MATERIALIZED (SELECT l_linestatus AS g, CAST(l_suppkey AS VARCHAR) AS lab, CAST(l_extendedprice AS DOUBLE) AS x, l_orderkey, l_linenumber FROM lineitem)"


def _rows(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_linestatus").alias("g"), F.col("l_suppkey").cast("string").alias("lab"), F.col("l_extendedprice").cast("double").alias("x"), "l_orderkey", "l_linenumber")


@query(
    "large_group_quantiles",
    f"WITH {ROWS_SQL}, m AS (SELECT g, count(x) AS n, median(x) AS med FROM rw GROUP BY 1) SELECT rw.g, any_value(n) AS n, {o6('any_value(med)')} AS median, {o6('median(abs(x - med))')} AS mad, {o6('quantile_cont(x, 0.05)')} AS q05, {o6('quantile_cont(x, 0.999)')} AS q999 FROM rw JOIN m USING (g) GROUP BY 1",
)
def large_group_quantiles(spark, d):
    rows = _rows(spark, d)
    m = R.group_median_mad(rows, ["g"], "x")
    q = R.group_quantiles(rows, ["g"], "x", [0.05, 0.999]).drop("n")
    return m.join(q, "g").select("g", "n", r6("median").alias("median"), r6("mad").alias("mad"), r6(F.col("q")[0]).alias("q05"), r6(F.col("q")[1]).alias("q999"))


@query(
    "large_group_left_out",
    f"WITH {ROWS_SQL}, o AS (SELECT g, l.lab, median(x) AS med_out, count(*) AS n_out FROM rw JOIN (SELECT DISTINCT lab FROM rw) l ON l.lab <> rw.lab GROUP BY 1, 2), i AS (SELECT g, lab, median(x) AS med_in, count(*) AS n_in FROM rw GROUP BY 1, 2) SELECT g, lab, n_in, {o6('med_in')} AS med_in, n_out, {o6('med_out')} AS med_out FROM i JOIN o USING (g, lab)",
)
def large_group_left_out(spark, d):
    out = R.leave_label_out_median(_rows(spark, d), ["g"], "lab", "x")
    return out.select("g", "lab", "n_in", r6("med_in").alias("med_in"), "n_out", r6("med_out").alias("med_out"))


@query(
    "large_group_loo",
    f"""WITH {ROWS_SQL}, s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY x, l_orderkey, l_linenumber) AS k, count(*) OVER (PARTITION BY g) AS n FROM rw),
m AS (SELECT g, max(n) AS n, list(x ORDER BY k) AS xs FROM s GROUP BY 1)
SELECT s.g, l_orderkey, l_linenumber, s.n - 1 AS n_peers, {o6("(CASE WHEN (s.n - 1) % 2 = 1 THEN xs[(s.n // 2) + CASE WHEN k <= s.n // 2 THEN 1 ELSE 0 END] ELSE (xs[((s.n - 1) // 2) + CASE WHEN k <= (s.n - 1) // 2 THEN 1 ELSE 0 END] + xs[((s.n - 1) // 2 + 1) + CASE WHEN k <= (s.n - 1) // 2 + 1 THEN 1 ELSE 0 END]) / 2 END)")} AS peer_median
FROM s JOIN m USING (g)""",
)
def large_group_loo(spark, d):
    out = with_loo(_rows(spark, d), ["g"], "x")
    return out.select("g", "l_orderkey", "l_linenumber", F.col("loo_n").alias("n_peers"), r6("loo_med").alias("peer_median"))


@query(
    "large_group_ranks",
    f"WITH {ROWS_SQL} SELECT g, l_orderkey, l_linenumber, count(*) OVER (PARTITION BY g ORDER BY x DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n_ge, count(*) OVER (PARTITION BY g) AS n_ref FROM rw",
)
def large_group_ranks(spark, d):
    rows = _rows(spark, d)
    return R.count_at_least(rows, rows, ["g"], "x").select("g", "l_orderkey", "l_linenumber", "n_ge", "n_ref")
