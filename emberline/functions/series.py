"""Expressions over one short ordered series, an ARRAY<STRUCT<t INT, u DOUBLE>>.

A series holds one reading per checkpoint (at most eight), so pair loops inside the
array are bounded by the checkpoint schedule, never by the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_median(xs: Column) -> Column:
    """Median of a small array of non-null doubles; NULL when it is empty."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        hi = F.get(s, F.floor(n / 2).cast("int"))
        lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
        return F.when(n > 0, (lo + hi) / 2.0)

    # bound once: every reference would sort (and build) the array again
    return F.transform(F.array(F.sort_array(xs)), middle)[0]


def pairs(pts: Column, fn) -> Column:
    """Array of ``fn(earlier, later)`` over all time-ordered pairs of a series."""
    return F.flatten(
        F.transform(
            pts,
            lambda a: F.transform(F.filter(pts, lambda b: b["t"] > a["t"]), lambda b: fn(a, b)),
        )
    )


def theil_sen(pts: Column) -> Column:
    return array_median(pairs(pts, lambda a, b: (b["u"] - a["u"]) / (b["t"] - a["t"])))


SHORT = 4  # points up to which a caller may have the slopes, excesses and jumps of a series written out


def short_slopes(pts: Column) -> Column:
    """The slopes between the first four points in ascending order, NULL (first) where a pair is missing."""
    at = [F.get(pts, F.lit(i)) for i in range(SHORT)]
    each = [F.when(at[j]["t"] > at[i]["t"], (at[j]["u"] - at[i]["u"]) / (at[j]["t"] - at[i]["t"])) for i in range(SHORT) for j in range(i + 1, SHORT)]
    return F.sort_array(F.array(*each))


def theil_sen_short(pts: Column, slopes: Column) -> Column:
    """``theil_sen(pts)``, for up to four points from their ``short_slopes`` (a column, so that it is sorted once)."""
    size = SHORT * (SHORT - 1) // 2
    n = sum(F.get(slopes, F.lit(i)).isNotNull().cast("int") for i in range(size))
    lo, hi = (F.get(slopes, (size - n + F.floor(k / 2)).cast("int")) for k in (n - 1, n))
    return F.when(F.size(pts) <= SHORT, F.when(n > 0, (lo + hi) / 2.0)).otherwise(theil_sen(pts))


def cusum_short(count: Column, excess: list[Column], slack: float = 0.25) -> Column:
    """``cusum`` of the first ``count`` of a few excesses that stand in columns of their own."""

    def side(signed) -> Column:
        s = F.lit(0.0)
        for i, e in enumerate(excess):
            s = F.when(count > i, F.greatest(F.lit(0.0), s + (signed(e) - slack))).otherwise(s)
        return s

    return F.greatest(side(lambda e: e), side(lambda e: -e))


def kendall_tau(pts: Column) -> Column:
    signs = pairs(pts, lambda a, b: F.signum(b["u"] - a["u"]))
    total = F.aggregate(signs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(signs) > 0, total / F.size(signs))


def back(pts: Column, k: int) -> Column:
    """k-th point from the end (1 = last); NULL when the series is shorter."""
    return F.get(pts, F.size(pts) - k)


def acceleration(pts: Column) -> Column:
    """Last slope minus the one before it; needs three points."""
    a, b, c = back(pts, 3), back(pts, 2), back(pts, 1)
    return F.when(
        F.size(pts) >= 3,
        F.try_divide(c["u"] - b["u"], (c["t"] - b["t"]).cast("double")) - F.try_divide(b["u"] - a["u"], (b["t"] - a["t"]).cast("double")),
    )


def cusum(excess: Column, slack: float = 0.25) -> Column:
    """Two-sided one-pass CUSUM over an ordered array; value after the last element."""
    zero = F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"))
    return F.aggregate(
        excess,
        zero,
        lambda s, e: F.struct(
            F.greatest(F.lit(0.0), s["pos"] + (e - slack)).alias("pos"),
            F.greatest(F.lit(0.0), s["neg"] + (-e - slack)).alias("neg"),
        ),
        lambda s: F.greatest(s["pos"], s["neg"]),
    )


def ols_t(pts: Column) -> Column:
    """t statistic of the least-squares slope; needs K >= 3. NaN (0 / 0) where all values are equal, 0 on a sloped line."""
    n = F.size(pts).cast("double")
    mt = F.aggregate(pts, F.lit(0.0), lambda s, p: s + p["t"]) / n
    mu = F.aggregate(pts, F.lit(0.0), lambda s, p: s + p["u"]) / n
    sxx = F.aggregate(pts, F.lit(0.0), lambda s, p: s + (p["t"] - mt) * (p["t"] - mt))
    sxy = F.aggregate(pts, F.lit(0.0), lambda s, p: s + (p["t"] - mt) * (p["u"] - mu))
    slope = F.try_divide(sxy, sxx)
    sse = F.aggregate(
        pts,
        F.lit(0.0),
        lambda s, p: s + F.pow(p["u"] - mu - slope * (p["t"] - mt), 2),
    )
    se = F.sqrt(F.try_divide(F.try_divide(sse, n - 2.0), sxx))
    level = F.array_min(F.transform(pts, lambda p: p["u"])) == F.array_max(F.transform(pts, lambda p: p["u"]))
    return F.when(F.size(pts) >= 3, F.when(level, F.lit(float("nan"))).when(se > 1e-12, slope / se).otherwise(F.lit(0.0)))
