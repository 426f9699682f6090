"""Scalar expressions: representation transforms, evidence scores, interval arithmetic."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from emberline.registry import REGISTRY, Registry

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this module

MAD_SCALE = 1.4826
MAD_SCALE_CHANNEL = 1.482602218505602
MEDIAN_SE = 1.2533141373155
Z90 = 1.6448536269514722
DIVERGENCE = 10.0
ERF_TERMS = 60


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round and fold -0.0 into 0.0, the form every reported float takes."""
    return F.round(col(c), digits) + F.lit(0.0)


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities, the value otherwise."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def asinh(x: Column) -> Column:
    """Inverse hyperbolic sine, as exact for negative arguments as for positive ones (``F.asinh`` cancels there)."""
    a = F.abs(x)
    root = F.sqrt(a * a + 1.0)
    w = F.when(a > 1e150, F.ln(a) + math.log(2.0)).when(a > 2.0, F.ln(2.0 * a + 1.0 / (root + a))).otherwise(F.log1p(a + a * a / (1.0 + root)))
    return F.signum(x) * w


def transform(param: Column | str, value: Column | str, reg: Registry = REGISTRY) -> Column:
    """Physical value -> representation space; outside the domain the result is NULL."""
    p, y = col(param), finite(value)
    out = None
    for q in reg.parameters:
        if q.transform == "log":
            u = F.when(y > 0, F.ln(y))
        elif q.transform == "asinh":
            u = asinh(y / F.lit(q.scale))
        else:
            u = y
        out = F.when(p == q.name, u) if out is None else out.when(p == q.name, u)
    return out


_NAMED = {1: math.log, 2: math.asinh}


def _by_name(kind: pa.Array, x: pa.Array) -> pa.Array:
    """The C library's function of every value, once per distinct one; null where no function is named."""
    kinds, xs = kind.to_numpy(), x.to_numpy(zero_copy_only=False)
    out = np.full(len(xs), np.nan)
    for k, function in _NAMED.items():
        values, place = np.unique(xs[kinds == k], return_inverse=True)
        out[kinds == k] = np.fromiter(map(function, values.tolist()), float, len(values))[place]
    return pa.array(out, mask=kinds == 0)


def transform_last_bit(param: Column | str, value: Column | str, reg: Registry = REGISTRY) -> Column:
    """``transform`` with logarithms of the C library, whose last bits are those of the SQL's engine.

    Spark's own are up to one unit in the last place off, which decides the sign of a difference that is exactly zero.
    """
    p, y = col(param), finite(value)
    kind, x, plain = F.lit(0), F.lit(None).cast("double"), transform(p, y, reg)
    for q in reg.parameters:
        if q.transform in ("log", "asinh"):
            v = F.when(y > 0, y) if q.transform == "log" else y / F.lit(q.scale)
            named = (p == q.name) & v.isNotNull()
            kind, x = F.when(named, 1 if q.transform == "log" else 2).otherwise(kind), F.when(named, v).otherwise(x)
    told = F.arrow_udf(_by_name, "double")(kind, x)
    return F.coalesce(told, plain)


def inverse_transform(param: Column | str, u: Column | str, reg: Registry = REGISTRY) -> Column:
    """Representation space -> physical value; non-finite results are NULL."""
    p, x = col(param), finite(u)
    out = None
    for q in reg.parameters:
        if q.transform == "log":
            y = F.exp(x)
        elif q.transform == "asinh":
            y = F.sinh(x) * F.lit(q.scale)
        else:
            y = x
        out = F.when(p == q.name, finite(y)) if out is None else out.when(p == q.name, finite(y))
    return out


def _erf_sum(v: Column, q: Column) -> Column:
    """v (1 + q/3 (1 + q/5 (1 + ...))) with q = 2 v^2, times 2 exp(-v^2) / sqrt(pi)."""
    total = F.lit(1.0)
    for n in range(ERF_TERMS, 0, -1):
        total = 1.0 + q * (1.0 / (2.0 * n + 1.0)) * total  # a quotient would count as nullable, with a check at every step
    return F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-v * v) * v * total


def erf_abs(x: Column | str) -> Column:
    """erf(|x|): positive-term series, 1 beyond |x| = 5 (below double resolution there)."""
    a = F.abs(col(x))
    # bound once so that no step evaluates x again
    series = F.transform(F.array(a), lambda v: _erf_sum(v, 2.0 * v * v))[0]
    return F.when(a > 5.0, F.lit(1.0)).when(a.isNotNull(), F.least(F.lit(1.0), series))


def erf_layers(z: str, p: str) -> list[dict[str, Column]]:
    """Two layers giving <p>_erf = erf(|z| / sqrt 2) of a finite z, else 0: compiled code on columns without nulls."""
    a = F.coalesce(F.abs(finite(z) / math.sqrt(2.0)), F.lit(0.0))
    v, q = F.col(f"{p}_v"), F.col(f"{p}_q")
    capped = F.least(a, F.lit(5.0))
    return [
        {f"{p}_a": a, f"{p}_v": capped, f"{p}_q": 2.0 * capped * capped},
        {f"{p}_erf": F.when(F.col(f"{p}_a") > 5.0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), _erf_sum(v, q)))},
    ]


def _unit(c: Column) -> Column:
    return r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def score_peer(z: Column | str, erf: Column | None = None) -> Column:
    """``erf``: the value of ``erf_layers`` where the caller has it as a column."""
    z = finite(z)
    return F.when(z.isNotNull(), _unit(erf_abs(z / math.sqrt(2.0)) if erf is None else erf))


def score_drift(g: Column | str, cusum: Column | str | None = None, erf: Column | None = None) -> Column:
    g = finite(g)
    from_g = erf_abs(g / math.sqrt(2.0)) if erf is None else F.when(g.isNotNull(), erf)
    if cusum is None:
        return F.when(g.isNotNull(), _unit(from_g))
    c = finite(cusum)
    from_c = F.when(c <= 0, F.lit(0.0)).when(c > 0, logistic(1.5 * (c - 3.5)))
    return F.when(g.isNotNull() | c.isNotNull(), _unit(F.greatest(from_g, from_c)))


def score_step(j: Column | str) -> Column:
    j = finite(j)
    return F.when(j <= 0, F.lit(0.0)).when(j > 0, _unit(logistic(1.5 * (j - 4.0))))


def score_joint(d: Column | str) -> Column:
    d = finite(d)
    x = F.greatest(F.lit(0.0), d) * F.greatest(F.lit(0.0), d)
    return F.when(d.isNotNull(), _unit(1.0 - (1.0 + 0.5 * x) * F.exp(-0.5 * x)))


def score_equipment(shift: Column | str, offset: Column | str, floor: Column | str) -> Column:
    f = F.greatest(col(floor), F.lit(1e-9))

    def part(c):
        return F.coalesce(logistic(1.2 * (F.abs(finite(c)) / f - 3.0)), F.lit(0.0))

    return _unit(F.greatest(part(shift), part(offset)))


def wilson(k: Column | str, n: Column | str, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval; exact 0 at k = 0 and exact 1 at k = n."""
    k, n = col(k).cast("double"), col(n).cast("double")
    p = k / F.when(n > 0, n)
    den = 1.0 + z * z / n
    mid = p + z * z / (2.0 * n)
    half = z * F.sqrt((p * (1.0 - p) + z * z / (4.0 * n)) / n)
    low = F.when(k == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (mid - half) / den))
    high = F.when(k == n, F.lit(1.0)).otherwise(F.least(F.lit(1.0), (mid + half) / den))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


_WILSON = (
    "(k / n + 3.841458820694124D / (2D * n) {side} 1.959963984540054D * "
    "sqrt((k / n * (1D - k / n) + 3.841458820694124D / (4D * n)) / n)) / (1D + 3.841458820694124D / n)"
)


def _erf_sql(z: str) -> str:
    """erf(|z| / sqrt 2) in SQL, by the series of ``erf_abs``."""
    step = "s.term * {z} * {z} / (2D * n + 1D)".format(z=z)
    return (
        f"CASE WHEN abs({z}) > 7 THEN 1D ELSE least(1D, 1.1283791670955126D * exp(-{z} * {z} / 2D) * aggregate(sequence(1, 60), "
        f"struct(abs({z}) / sqrt(2D) AS term, abs({z}) / sqrt(2D) AS total), (s, n) -> struct({step} AS term, s.total + {step} AS total), s -> s.total)) END"
    )


def _none_sql(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}) OR abs({c}) = DOUBLE('Infinity'))"


def _moved_sql(c: str) -> str:
    return f"CASE WHEN {_none_sql(c)} THEN 0D ELSE 1D / (1D + exp(-1.2D * (abs({c}) / greatest(floor, 1e-9D) - 3D))) END"


def _unit_sql(x: str) -> str:
    return f"round(greatest(0D, least(1D, {x})), 4) + 0D"


def register_sql_functions(spark: SparkSession) -> list[str]:
    """Expose the scalar layer to ``spark.sql`` as temporary SQL functions (no Python)."""
    log = ", ".join(f"'{p.name}'" for p in REGISTRY.parameters if p.transform == "log")
    ash = ", ".join(f"'{p.name}'" for p in REGISTRY.parameters if p.transform == "asinh")
    lin = ", ".join(f"'{p.name}'" for p in REGISTRY.parameters if p.transform == "linear")
    bodies = {
        "el_transform": (
            "p STRING, y DOUBLE",
            f"CASE WHEN isnan(y) OR abs(y) = DOUBLE('Infinity') THEN NULL WHEN p IN ({log}) THEN "
            f"CASE WHEN y > 0 THEN ln(y) END WHEN p IN ({ash}) THEN asinh(y) WHEN p IN ({lin}) THEN y END",
        ),
        "el_inverse": (
            "p STRING, u DOUBLE",
            f"CASE WHEN p IN ({log}) THEN exp(u) WHEN p IN ({ash}) THEN sinh(u) WHEN p IN ({lin}) THEN u END",
        ),
        "el_score_step": (
            "j DOUBLE",
            "CASE WHEN j <= 0 THEN 0D ELSE round(1D / (1D + exp(-1.5D * (j - 4D))), 4) END",
        ),
        "el_score_joint": (
            "d DOUBLE",
            "round(1D - (1D + 0.5D * d * d) * exp(-0.5D * d * d), 4)",
        ),
        "el_score_peer": ("z DOUBLE", f"CASE WHEN {_none_sql('z')} THEN NULL ELSE {_unit_sql(_erf_sql('z'))} END"),
        "el_score_drift": (
            "g DOUBLE, c DOUBLE",
            f"CASE WHEN {_none_sql('g')} AND {_none_sql('c')} THEN NULL ELSE "
            + _unit_sql(
                f"greatest(CASE WHEN {_none_sql('g')} THEN NULL ELSE {_erf_sql('g')} END, "
                f"CASE WHEN {_none_sql('c')} THEN NULL WHEN c <= 0 THEN 0D ELSE 1D / (1D + exp(-1.5D * (c - 3.5D))) END)"
            )
            + " END",
        ),
        "el_score_equipment": (
            "shift DOUBLE, off DOUBLE, floor DOUBLE",
            _unit_sql(f"greatest({_moved_sql('shift')}, {_moved_sql('off')})"),
        ),
        "el_wilson_low": (
            "k DOUBLE, n DOUBLE",
            f"CASE WHEN n > 0 THEN CASE WHEN k = 0 THEN 0D ELSE greatest(0D, {_WILSON.format(side='-')}) END ELSE 0D END",
        ),
        "el_wilson_high": (
            "k DOUBLE, n DOUBLE",
            f"CASE WHEN n > 0 THEN CASE WHEN k = n THEN 1D ELSE least(1D, {_WILSON.format(side='+')}) END ELSE 0D END",
        ),
    }
    for name, (args, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS DOUBLE RETURN {body}")
    return sorted(bodies)
