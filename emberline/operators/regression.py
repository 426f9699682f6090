"""Two-feature ridge from mergeable sufficient statistics, its folds, and robust variants.

A fit needs ten sums per group.  Leave-one-lot-out folds are totals minus one lot's sums, so
fifty folds cost one pass over the data; nothing is trained in a loop over lots.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import DIVERGENCE, MAD_SCALE, inverse_transform
from emberline.operators.ranks import group_median_mad
from emberline.registry import REGISTRY, Registry
from emberline.session import cut

SUMS = ["n", "s1", "s2", "sy", "s11", "s12", "s22", "s1y", "s2y"]


def sums(x1: str = "u0", x2: str = "u24", y: str = "u168", w: str | None = None) -> list[Column]:
    a, b, t = F.col(x1), F.col(x2), F.col(y)
    k = F.lit(1.0) if w is None else F.col(w)
    parts = [k, k * a, k * b, k * t, k * a * a, k * a * b, k * b * b, k * a * t, k * b * t]
    return [F.sum(p).alias(c) for p, c in zip(parts, SUMS)]


def ridge_sql(lam: str = "1D", penalise_intercept: bool = False) -> dict[str, str]:
    """b0, b1, b2 as SQL over the sums; the unpenalised intercept drops out by centring."""
    if penalise_intercept:
        a = {"00": f"(n + {lam})", "01": "s1", "02": "s2", "11": f"(s11 + {lam})", "12": "s12", "22": f"(s22 + {lam})"}
        c00 = f"({a['11']} * {a['22']} - {a['12']} * {a['12']})"
        c01 = f"({a['02']} * {a['12']} - {a['01']} * {a['22']})"
        c02 = f"({a['01']} * {a['12']} - {a['02']} * {a['11']})"
        c11 = f"({a['00']} * {a['22']} - {a['02']} * {a['02']})"
        c12 = f"({a['01']} * {a['02']} - {a['00']} * {a['12']})"
        c22 = f"({a['00']} * {a['11']} - {a['01']} * {a['01']})"
        det = f"({a['00']} * {c00} + {a['01']} * {c01} + {a['02']} * {c02})"
        return {
            "b0": f"({c00} * sy + {c01} * s1y + {c02} * s2y) / {det}",
            "b1": f"({c01} * sy + {c11} * s1y + {c12} * s2y) / {det}",
            "b2": f"({c02} * sy + {c12} * s1y + {c22} * s2y) / {det}",
        }
    p, q, r = f"(s11 - s1 * s1 / n + {lam})", "(s12 - s1 * s2 / n)", f"(s22 - s2 * s2 / n + {lam})"
    v, w = "(s1y - s1 * sy / n)", "(s2y - s2 * sy / n)"
    det = f"({p} * {r} - {q} * {q})"
    b1, b2 = f"(({r} * {v} - {q} * {w}) / {det})", f"(({p} * {w} - {q} * {v}) / {det})"
    return {"b0": f"(sy - {b1} * s1 - {b2} * s2) / n", "b1": b1, "b2": b2}


def solve(stats: DataFrame, lam: str = "1D", penalise_intercept: bool = False) -> DataFrame:
    return stats.withColumns({k: F.expr(v) for k, v in ridge_sql(lam, penalise_intercept).items()})


def ridge_fit(tri: DataFrame, keys: Sequence[str] = ("parameter_name",), lam: str = "1D", penalise_intercept: bool = False, **cols) -> DataFrame:
    """Keys, n, b0, b1, b2."""
    return solve(tri.groupBy(*keys).agg(*sums(**cols)), lam, penalise_intercept).select(*keys, "n", "b0", "b1", "b2")


def lolo_coefficients(tri: DataFrame, fold: str = "lot_id", lam: str = "1D", **cols) -> DataFrame:
    """Coefficients trained without each fold: totals minus the fold's own sums."""
    per = tri.groupBy("parameter_name", fold).agg(*sums(**cols))
    total = per.groupBy("parameter_name").agg(*[F.sum(c).alias(f"t_{c}") for c in SUMS])
    rest = per.join(total, "parameter_name").select("parameter_name", fold, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in SUMS])
    return solve(rest, lam).select("parameter_name", fold, "b0", "b1", "b2")


def score(tri: DataFrame, coef: DataFrame, keys: Sequence[str] = ("parameter_name",)) -> DataFrame:
    """u_hat with the coefficients of the row's keys (a few rows per parameter and fold)."""
    return tri.join(coef.select(*keys, "b0", "b1", "b2"), list(keys)).withColumn("u_hat", F.expr("b0 + b1 * u0 + b2 * u24"))


def sigma_eff(residuals: DataFrame, value: str = "residual", keys: Sequence[str] = ("parameter_name",), reg: Registry = REGISTRY, skewed: bool | None = None) -> DataFrame:
    """max(1.4826 MAD, floor) with at least three residuals, else the floor."""
    g = group_median_mad(residuals, keys, value, skewed)
    s = F.when(F.col("n") >= 3, F.greatest(MAD_SCALE * F.col("mad"), reg.floor())).otherwise(reg.floor())
    return g.withColumn("sigma_eff", s)


def oof_sigma(tri: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """P10: out-of-fold residual scale per parameter."""
    res = score(tri, lolo_coefficients(tri), ["parameter_name", "lot_id"]).withColumn("residual", F.col("u168") - F.col("u_hat"))
    return sigma_eff(res, reg=reg)


def guarded(df: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """Physical forecast; |u_hat| > 10 or non-finite falls back to the 24 h reading."""
    bad = F.col("u_hat").isNull() | F.isnan("u_hat") | (F.abs("u_hat") > DIVERGENCE)
    phys = inverse_transform("parameter_name", "u_hat", reg)
    return df.withColumn("divergent", bad | phys.isNull()).withColumn(
        "predicted", F.when(F.col("divergent"), F.col("v24")).otherwise(phys)
    )


def huber_fit(tri: DataFrame, lam: float = 1.0, scale: float = 1.345, max_iter: int = 50, tol: float = 1e-6, reg: Registry = REGISTRY) -> DataFrame:
    """IRLS for all parameters at once; keys, b0, b1, b2, iterations, converged.

    A parameter that still moves by ``tol`` after ``max_iter`` rounds is returned as not converged.
    A bounded driver loop: an iteration is one robust scale and one combined aggregate; only a
    coefficient row per parameter returns to the driver to test convergence.
    """
    base = cut(tri.select("parameter_name", "u0", "u24", "u168"))
    spark = tri.sparkSession
    ddl = "parameter_name STRING, b0 DOUBLE, b1 DOUBLE, b2 DOUBLE"
    rows = [tuple(r) for r in ridge_fit(base, lam=f"{lam}D").select("parameter_name", "b0", "b1", "b2").collect()]
    open_params = {r[0] for r in rows}
    coef = {r[0]: r[1:] for r in rows}
    rounds = dict.fromkeys(coef, 0)
    for _ in range(max_iter):
        if not open_params:
            break
        now = spark.createDataFrame([(p, *coef[p]) for p in sorted(open_params)], ddl)
        res = score(base, F.broadcast(now)).withColumn("r", F.col("u168") - F.col("u_hat"))
        sig = sigma_eff(res, "r", reg=reg).select("parameter_name", (scale * F.greatest(MAD_SCALE * F.col("mad"), reg.floor())).alias("delta"))
        w = res.join(F.broadcast(sig), "parameter_name").withColumn(
            "w", F.when(F.abs("r") <= F.col("delta"), 1.0).otherwise(F.col("delta") / F.greatest(F.abs("r"), F.lit(1e-12)))
        )
        fit = solve(w.groupBy("parameter_name").agg(*sums(w="w")), f"{lam}D").select("parameter_name", "b0", "b1", "b2").collect()
        for r in fit:
            p, new = r[0], tuple(r[1:])
            if max(abs(a - b) for a, b in zip(new, coef[p])) < tol:
                open_params.discard(p)
            coef[p] = new
            rounds[p] += 1
    return spark.createDataFrame([(p, *coef[p], rounds[p], p not in open_params) for p in sorted(coef)], ddl + ", iterations INT, converged BOOLEAN")


def gram_fit(df: DataFrame, features: Sequence[str], target: str, lam: float = 1.0) -> DataFrame:
    """Ridge over any small feature list: the Gram matrix is one combined aggregate per
    parameter (a few dozen sums); the tiny solve of each parameter runs in an Arrow batch."""
    d = len(features)
    cols = [F.lit(1.0)] + [F.col(f) for f in features]
    pairs = [(i, j) for i in range(d + 1) for j in range(i + 1)]
    aggs = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i, j in pairs]
    aggs += [F.sum(cols[i] * F.col(target)).alias(f"c{i}") for i in range(d + 1)]
    gram = df.groupBy("parameter_name").agg(*aggs)

    def solve_batches(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                a = np.zeros((d + 1, d + 1))
                for i, j in pairs:
                    a[i, j] = a[j, i] = r[f"g{i}_{j}"]
                a += np.diag([0.0] + [lam] * d)
                out.append(np.linalg.solve(a, np.array([r[f"c{i}"] for i in range(d + 1)])).tolist())
            yield pdf[["parameter_name"]].assign(beta=out)

    return gram.mapInPandas(solve_batches, "parameter_name STRING, beta ARRAY<DOUBLE>")


# Feature lists of the context variants (target u168) and of the residual variants (target u168 - u24)
_CONTEXT = {
    "A": ("u0", "u24"),
    "B": ("u0", "u24", "loo_median_0"),
    "C": ("u0", "u24", "loo_median_0", "loo_median_24"),
    "D": ("u0", "u24", "lot_drift"),
    "E": ("u0", "u24", "excess_drift"),
    "F": ("u0", "u24", "lot_drift", "excess_drift"),
    "G": ("u0", "u24", "lot_drift", "excess_drift", "loo_scale_0"),
}
_RESIDUAL = {
    "A": (("u0", "u24"), "u168"),
    "B": (("u0", "u24"), "delta_u"),
    "C": (("u0", "u24", "lot_drift"), "delta_u"),
    "D": (("u0", "u24", "excess_drift"), "delta_u"),
    "E": (("u0", "u24", "lot_drift", "excess_drift"), "delta_u"),
    "F": (("u24", "component_drift", "lot_drift", "excess_drift"), "delta_u"),
}
VARIANTS = {f"context_{k}": (v, "u168") for k, v in _CONTEXT.items()} | {f"residual_{k}": v for k, v in _RESIDUAL.items()}


def variant_coefficients(df: DataFrame, variants: dict = VARIANTS, fold: str = "lot_id", lam: float = 1.0) -> DataFrame:
    """parameter_name, fold, betas ARRAY<ARRAY<DOUBLE>> (by variant) of ridge fits that do not see the fold.

    One wide table of cross products per parameter and lot holds everything: a fold is the total minus its own row, a
    variant is a sub-matrix. Solving reads some dozen numbers per fold, in Arrow batches.
    """
    features = list(dict.fromkeys(f for fs, _ in variants.values() for f in fs))
    targets = list(dict.fromkeys(t for _, t in variants.values()))
    names = ["__one", *features, *targets]
    pairs = [(i, j) for j in range(len(names)) for i in range(min(j, len(features)) + 1)]
    df = df.where(reduce(and_, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in names[1:]])).withColumn("__one", F.lit(1.0))
    cells = [f"s{i}_{j}" for i, j in pairs]
    per = df.groupBy("parameter_name", fold).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(c) for (i, j), c in zip(pairs, cells)])
    per = cut(per)
    total = per.groupBy("parameter_name").agg(*[F.sum(c).alias(f"t_{c}") for c in cells])
    rest = per.join(total, "parameter_name").select("parameter_name", fold, *[(F.col(f"t_{c}") - F.col(c)).alias(c) for c in cells])
    picks = [([0, *(names.index(f) for f in fs)], names.index(t)) for fs, t in variants.values()]
    width = len(names)

    def solve_batches(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            s = np.zeros((batch.num_rows, width, width))
            for (i, j), c in zip(pairs, cells):
                s[:, i, j] = s[:, j, i] = batch.column(c).to_numpy(zero_copy_only=False)
            seen = s[:, 0, 0] > 0
            out = [[] for _ in range(batch.num_rows)]
            for at, t in picks:
                a = s[:, at][:, :, at] + np.diag([0.0] + [lam] * (len(at) - 1))
                a[~seen] = np.eye(len(at))
                b = np.linalg.solve(a, s[:, at, t][..., None])[..., 0]
                for row, beta, some in zip(out, b.tolist(), seen):
                    row.append(beta if some else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["parameter_name", fold, "betas"])

    return rest.mapInArrow(solve_batches, f"parameter_name STRING, {fold} STRING, betas ARRAY<ARRAY<DOUBLE>>")


def variant_errors(df: DataFrame, variants: dict = VARIANTS, fold: str = "lot_id", lam: float = 1.0, reg: Registry = REGISTRY) -> DataFrame:
    """parameter_name, variant, n, n_divergent, mae in physical units, every row forecast without its own lot.

    df: features, targets, v24 and v168. A forecast beyond the divergence guard counts as the 24 h reading.
    """
    scored = df.join(variant_coefficients(df, variants, fold, lam), ["parameter_name", fold])
    each = []
    for k, (name, (features, target)) in enumerate(variants.items()):
        beta = F.col("betas")[k]
        u = reduce(lambda a, b: a + b, [beta[0], *(beta[i] * F.col(f) for i, f in enumerate(features, 1))])
        each.append(F.struct(F.lit(name).alias("variant"), (u + F.col("u24") if target == "delta_u" else u).alias("u_hat")))
    long = scored.select("parameter_name", "v24", "v168", F.explode(F.array(*each)).alias("e")).select("parameter_name", "v24", "v168", "e.*")
    told = guarded(long.where("u_hat IS NOT NULL"), reg)
    return told.groupBy("parameter_name", "variant").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("divergent").alias("n_divergent"), F.avg(F.abs(F.col("predicted") - F.col("v168"))).alias("mae")
    )


def gbt_residual(df: DataFrame, features: Sequence[str], target: str, parameters: Sequence[str], iterations: int = 50):
    """Boosted trees on the residual target, one MLlib model per parameter, over the rows of all of them.

    A row whose features are not all finite gets a null delta_hat; a parameter without a row to fit has none.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    def finite(columns):
        return reduce(and_, [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in columns])

    df = cut(df)
    vec = VectorAssembler(inputCols=list(features), outputCol="__x")
    gbt = GBTRegressor(featuresCol="__x", labelCol=target, maxDepth=3, maxIter=iterations, stepSize=0.05, minInstancesPerNode=10, seed=7)
    parts = []
    for parameter in parameters:
        rows = df.where(F.col("parameter_name") == parameter)
        usable = rows.where(finite(features))
        known = usable.where(finite([target]))
        if not known.limit(1).count():
            parts.append(rows.withColumn("delta_hat", F.lit(None).cast("double")))
            continue
        model = gbt.fit(vec.transform(known))
        parts.append(model.transform(vec.transform(usable)).drop("__x").withColumnRenamed("prediction", "delta_hat"))
        parts.append(rows.where(~finite(features)).withColumn("delta_hat", F.lit(None).cast("double")))
    return reduce(DataFrame.unionByName, parts)
