"""Joint distance over all parameters, from mergeable lot moments.

Every member is standardised by statistics that exclude it, so its reference matrix is its
own.  But that matrix only needs sums, cross sums and a count of the lot's complete vectors,
shifted by the member's leave-one-out centre, minus the member itself.  The sums are one
combined aggregate per lot and the member's matrix entries are column arithmetic, so a lot
never meets in one task; only the small symmetric solves run in vectorised Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import MAD_SCALE, score_joint
from emberline.operators.layers import Layer
from emberline.operators.loo import loo_layers

# Decision threshold, shrinkage weight, smallest lot, smallest peer set.
JOINT_LIMIT = 4.25
SHRINK = 0.20
MIN_JOINT_LOT = 6
MIN_JOINT_PEERS = 4


def joint_input_layers() -> list[Layer]:
    """joint_m, joint_s on series rows: this member's LOO centre and scale of its joint value."""
    return [
        *loo_layers("joint_rec", "joint_x", "__q"),
        {"joint_m": F.col("__q_med"), "joint_s": F.expr(f"greatest({MAD_SCALE}D * __q_mad, floor)")},
    ]


def lot_moments(vectors: DataFrame, p: int) -> DataFrame:
    """as_of_hours, lot_id: size at the horizon, complete vectors, sums and cross sums of ``x``."""
    x = F.col("x")
    full = ~F.exists(x, lambda v: v.isNull())
    aggs = [F.count_if("now_any").alias("joint_lot"), F.count_if(full).alias("joint_n")]
    for i in range(p):
        aggs.append(F.sum(F.when(full, x[i])).alias(f"s{i}"))
        aggs += [F.sum(F.when(full, x[i] * x[j])).alias(f"s{i}{j}") for j in range(i + 1)]
    return vectors.groupBy("as_of_hours", "lot_id").agg(*aggs)


def _solver(p: int):
    """w0.. = z R^-1 z by parameter for a batch of members: their matrices from the moments, then one vectorised solve."""
    @F.pandas_udf(", ".join(f"w{i} double" for i in range(p)))
    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.full((len(rows), p), np.nan)
        ok = rows["ready"].to_numpy().astype(bool)
        if ok.any():
            c = {name: rows[name].to_numpy()[ok].astype(float) for name in rows.columns if name != "ready"}
            n, z = c["n"], np.stack([(c[f"x{i}"] - c[f"m{i}"]) / c[f"d{i}"] for i in range(p)], axis=1)
            r = np.empty((len(z), p, p))
            for i in range(p):
                for j in range(i + 1):
                    x, y = c[f"m{i}"], c[f"m{j}"]
                    e = c[f"s{i}{j}"] - y * c[f"s{i}"] - x * c[f"s{j}"] + n * x * y - (c[f"x{i}"] - x) * (c[f"x{j}"] - y)
                    r[:, i, j] = r[:, j, i] = (1.0 - SHRINK) * (e / (c[f"d{i}"] * c[f"d{j}"] * (n - 2))) + (SHRINK if i == j else 0.0)
            out[ok] = z * np.linalg.solve(r, z[..., None])[..., 0]
        return pd.DataFrame(out, columns=[f"w{i}" for i in range(p)])

    return solve


def joint_distance(
    rows: DataFrame, moments: DataFrame, params: Sequence[str], fields: Sequence[str] | None = None
) -> DataFrame:
    """Component rows with arrays x, joint_m, joint_s + moments -> ``joint`` evidence struct, of all or the given ``fields``."""
    p = len(params)
    df = rows.join(moments, ["as_of_hours", "lot_id"], "left")
    x = F.col("x")
    ready = (
        ~F.exists(x, lambda v: v.isNull())
        & (F.col("joint_lot") >= MIN_JOINT_LOT)
        & (F.col("joint_n") - 1 >= MIN_JOINT_PEERS)
    )
    df = df.withColumn("__ready", ready)
    parts = [F.coalesce("__ready", F.lit(False)).alias("ready"), F.col("joint_n").cast("double").alias("n")]
    for i in range(p):
        parts += [F.get(F.col(c), F.lit(i)).alias(f"{k}{i}") for c, k in (("x", "x"), ("joint_m", "m"), ("joint_s", "d"))]
        parts += [F.col(f"s{i}"), *[F.col(f"s{i}{j}") for j in range(i + 1)]]
    df = df.withColumn("__w", _solver(p)(F.struct(*parts)))
    df = df.withColumn("__p", F.when(F.col("__ready"), F.array(*[F.col(f"__w.w{i}") for i in range(p)])))
    df = df.withColumn(
        "__d", F.expr("IF(__p IS NULL, NULL, sqrt(greatest(0D, aggregate(__p, 0D, (t, v) -> t + v))))")
    )
    parts = [F.col("__p")[i] for i in range(p)]
    d = F.col("__d")
    hit = F.coalesce(d >= JOINT_LIMIT, F.lit(False))
    lacking = (F.col("joint_lot") < MIN_JOINT_LOT) | ~F.col("now_any")
    reason = (
        F.when(lacking, "PEER_COUNT_INSUFFICIENT_FOR_JOINT_COVARIANCE")
        .when(F.exists(x, lambda v: v.isNull()), "NON_FINITE_TRANSFORM_FOR_TARGET_COMPONENT")
        .when(~F.col("__ready"), "INSUFFICIENT_VALID_PEERS_FOR_COVARIANCE")
        .when(hit, F.concat(F.lit("JOINT_MAHALANOBIS_EXCESS_"), F.format_string("%.2f", d), F.lit("_SIGMA")))
        .otherwise("NOMINAL_JOINT_COVARIANCE")
    )
    ev = F.struct(
        F.when(~F.col("__ready"), "INSUFFICIENT_PEERS").when(hit, "JOINT_ANOMALY_ALERT").otherwise("NOMINAL_JOINT").alias("status"),
        hit.alias("suspected"),
        (F.round(d, 4) + 0.0).alias("distance"),
        score_joint(d).alias("score"),
        reason.alias("reason"),
        F.map_from_arrays(
            F.array(*[F.lit(q) for q in params]),
            F.array(*[F.when(F.col("__ready"), F.round(q, 4) + 0.0) for q in parts]),
        ).alias("contributions"),
    )
    ev = ev if fields is None else F.struct(*[ev[f].alias(f) for f in fields])
    return df.select(*rows.columns, ev.alias("joint"))
