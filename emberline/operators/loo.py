"""Leave-one-out robust statistics (median, MAD, scale) from group-level constants.

Removing one member moves the median of a sorted group among at most three values, and
which one depends only on how the member compares with the middle order statistics.  So a
member needs a constant-size record per group - the middle three values, and the middle
three deviations about each possible centre - and no self-join, no per-member array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import MAD_SCALE
from emberline.operators.layers import Layer, layered
from emberline.operators.ranks import (
    broadcast_if_small,
    group_limit,
    join_on,
    median_of_middle,
    middle_of,
    middle_ranks,
    pick_middle,
    value_cells,
)
from emberline.session import cut


def _centres(n: Column, mid: Column) -> Column:
    """Centres for: member <= x_a, x_a < member <= x_(a+1), member above, no member removed."""
    odd = n % 2 == 1
    return F.array(
        F.when(odd, (mid[1] + mid[2]) / 2.0).otherwise(mid[1]),
        F.when(odd, (mid[0] + mid[2]) / 2.0).otherwise(mid[0]),
        F.when(odd, (mid[0] + mid[1]) / 2.0).otherwise(mid[0]),
        median_of_middle(n, mid),
    )


def loo_record(df: DataFrame, keys: Sequence[str], value: str, skewed: bool | None = None) -> DataFrame:
    """keys, loo STRUCT<n, n_pos, n_neg, mid, centre, dev>: one constant-size record per group.

    A caller who knows that there are large groups (``skewed``) passes rows that are cheap to read several times.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).where(F.col(value).isNotNull())
    if skewed is False:
        return _loo_record_sorted(rows, keys)
    rows = cut(rows) if skewed is None else rows
    cells = cut(value_cells(rows, keys))
    sizes = cells.groupBy(*keys).agg(
        F.sum("__m").alias("n"),
        *[F.coalesce(F.sum(F.when(c, F.col("__m"))), F.lit(0)).alias(name) for name, c in (("n_pos", F.col("__b") > 0), ("n_neg", F.col("__b") < 0))],
    )
    sizes = cut(sizes.where(F.col("n") > group_limit(df)))
    if sizes.isEmpty():
        return _loo_record_sorted(rows, keys)
    side = broadcast_if_small(sizes.select(*keys))
    large = _loo_record_large(join_on(rows, side, keys, "left_semi"), join_on(cells, side, keys, "left_semi"), sizes, keys)
    return _loo_record_sorted(join_on(rows, side, keys, "left_anti"), keys).unionByName(large)


def _loo_record_sorted(rows: DataFrame, keys: list[str]) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__x"))
    g = g.withColumn("n", F.size("__x").cast("bigint"))

    def middle(xs):
        return F.transform(middle_ranks(F.col("n")), lambda r: F.get(xs, (r - 1).cast("int")))

    g = g.withColumn("mid", middle(F.col("__x")))
    g = g.withColumn("centre", _centres(F.col("n"), F.col("mid")))
    dev = F.transform(
        "centre",
        lambda c: F.when(
            c.isNotNull(), middle(F.sort_array(F.transform(F.col("__x"), lambda x: F.abs(x - c))))
        ),
    )
    return g.select(
        *keys,
        F.struct(
            "n",
            F.size(F.filter("__x", lambda x: x > 0)).cast("bigint").alias("n_pos"),
            F.size(F.filter("__x", lambda x: x < 0)).cast("bigint").alias("n_neg"),
            "mid",
            "centre",
            dev.alias("dev"),
        ).alias("loo"),
    )


def _loo_record_large(rows: DataFrame, cells: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """Records of large groups: the middle values by narrowing, the middle deviations about all centres from one window.

    Centres lie between neighbouring values, so what is middle about one of them is, but for the distance of the
    centres, middle about the group's median: only rows in that window of deviations are gathered.
    """
    mids = pick_middle(rows, cells, keys)
    base = cut(join_on(sizes, mids.drop("n"), keys, "inner").withColumn("centre", _centres(F.col("n"), F.col("mid"))))
    away = F.abs(F.col("__v") - F.col("__c"))
    about = join_on(rows, broadcast_if_small(base.select(*keys, F.col("centre")[3].alias("__c"))), keys, "inner")
    about = about.select(*keys, away.alias("__v"))
    near = pick_middle(about, cut(value_cells(about, keys)), keys).drop("n").withColumnRenamed("mid", "__near")
    apart = F.array_max(F.transform("centre", lambda c: F.abs(c - F.col("centre")[3])))
    reach = join_on(base, near, keys, "inner").withColumn("__apart", apart)
    # twice the distance of the centres, and more than the rounding of the differences
    slack = 2.0 * F.col("__apart") + 1e-12 * (F.array_max("__near") + F.col("__apart"))
    reach = cut(reach.withColumns({"__from": F.array_min("__near") - slack, "__to": F.array_max("__near") + slack, "__c": F.col("centre")[3]}))
    seen = join_on(rows, broadcast_if_small(reach.select(*keys, "__c", "__from", "__to")), keys, "inner").where(away <= F.col("__to"))
    # rows nearer than the window are one entry without a value
    seen = cut(seen.groupBy(*keys, F.when(away >= F.col("__from"), F.col("__v")).alias("__v")).agg(F.count(F.lit(1)).alias("__w")))
    wide = cut(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__d")).where(F.col("__d") > group_limit(rows) + 1).select(*keys))
    many = not wide.isEmpty()
    held = join_on(seen, broadcast_if_small(wide), keys, "left_anti") if many else seen
    entry = F.when(F.col("__v").isNotNull(), F.struct(F.col("__v").alias("v"), F.col("__w").alias("w")))
    held = held.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("__v").isNull(), F.col("__w"))), F.lit(0)).alias("__nearer"), F.collect_list(entry).alias("__x")
    )
    held = join_on(base, held, keys, "inner")

    def ranked(c):
        xs = F.sort_array(F.transform("__x", lambda e: F.struct(F.abs(e["v"] - c).alias("v"), e["w"].alias("w"))))
        return middle_of(xs, F.col("n"), F.col("__nearer"))

    record = F.struct("n", "n_pos", "n_neg", "mid", "centre", "dev").alias("loo")
    out = held.withColumn("dev", F.transform("centre", ranked)).select(*keys, record)
    if not many:
        return out
    # neighbouring values far apart: every centre's deviations for themselves
    far = join_on(base, broadcast_if_small(wide), keys, "left_semi")
    centres = far.select(*keys, F.posexplode("centre").alias("__i", "__c"))
    each = join_on(rows, broadcast_if_small(centres), keys, "inner").select(*keys, "__i", away.alias("__v"))
    own = [*keys, "__i"]
    dev = pick_middle(each, cut(value_cells(each, own)), own)
    dev = dev.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "mid"))), lambda s: s["mid"]).alias("dev"))
    return out.unionByName(join_on(far, dev, keys, "inner").select(*keys, record))


def loo_layers(r: str, v: str, p: str) -> list[Layer]:
    """Three layers giving <p>_n, <p>_med, <p>_mad from a record column and a value column.

    A NULL value is not a member of the group, so nothing is removed for it.
    """
    d = f"abs({v} - {p}_med)"
    lo = f"IF({d} <= {p}_dv[0], {p}_dv[1], {p}_dv[0])"
    hi = f"IF({d} <= {p}_dv[1], {p}_dv[2], {p}_dv[1])"
    return [
        {
            f"{p}_i": F.expr(
                f"CASE WHEN {v} IS NULL THEN 3 WHEN {v} <= {r}.mid[0] THEN 0 WHEN {v} <= {r}.mid[1] THEN 1 ELSE 2 END"
            ),
            f"{p}_n": F.expr(f"coalesce({r}.n, 0L) - int({v} IS NOT NULL)"),
        },
        {f"{p}_med": F.expr(f"{r}.centre[{p}_i]"), f"{p}_dv": F.expr(f"{r}.dev[{p}_i]")},
        {
            f"{p}_mad": F.expr(
                f"CASE WHEN {p}_i = 3 THEN IF({r}.n % 2 = 1, {p}_dv[1], ({p}_dv[0] + {p}_dv[1]) / 2D) "
                f"WHEN {p}_n < 1 THEN NULL WHEN {r}.n % 2 = 0 THEN {lo} ELSE ({lo} + {hi}) / 2D END"
            )
        },
    ]


def group_mad(rec: str) -> Column:
    """MAD of the whole group (nobody removed) from its record."""
    return F.expr(f"IF({rec}.n % 2 = 1, {rec}.dev[3][1], ({rec}.dev[3][0] + {rec}.dev[3][1]) / 2D)")


def with_loo(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    floor: Column | None = None,
    prefix: str = "loo",
    skewed: bool | None = None,
) -> DataFrame:
    """Rows plus <prefix>_n, _med, _mad, _scale of their peers."""
    rec = loo_record(df, keys, value, skewed).withColumnRenamed("loo", "__rec")
    fl = F.lit(0.0) if floor is None else floor
    scale = {f"{prefix}_scale": F.greatest(MAD_SCALE * F.col(f"{prefix}_mad"), fl)}
    out = layered(join_on(df, rec, list(keys), "left"), [*loo_layers("__rec", value, prefix), scale])
    return out.drop("__rec", f"{prefix}_i", f"{prefix}_dv")
