"""Assembly of component histories and of the lot context every detector reads.

One shuffle brings a component's readings together (at most parameters x checkpoints of
them, since telemetry is unique per key); parameters without readings come out of the same
row, so the component x parameter scaffold needs no cross join.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import transform
from emberline.operators.loo import loo_record
from emberline.operators.ranks import BROADCAST_ROWS, broadcast_if_small, has_large_groups, leave_label_out_median
from emberline.registry import REGISTRY, Registry
from emberline.session import cut

LOT_KEYS = ["as_of_hours", "lot_id", "parameter_name"]
READING = [
    "elapsed_hours", "value", "u", "unit", "measurement_quality", "instrument_id", "channel_id",
    "absolute_limit_low", "absolute_limit_high",
]


def is_skewed(telemetry: DataFrame) -> bool:
    """One probe per job: does any (lot, parameter, checkpoint) exceed the array limit?"""
    return has_large_groups(telemetry, ["lot_id", "parameter_name", "elapsed_hours"])


ARRIVAL = "arrival_seq"
CONTEXT_ROWS = 2_000  # most lot contexts that are broadcast, some KB each


def latest(telemetry: DataFrame, order: str = ARRIVAL) -> DataFrame:
    """One row per component, lot, parameter and checkpoint: the reading that arrived last.

    Each task keeps its own latest row of a key before the shuffle, so a key that repeats without end stays one row.
    """
    keys = ["component_id", "lot_id", "parameter_name", "elapsed_hours"]
    rest = [c for c in telemetry.columns if c not in (*keys, order)]
    return telemetry.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *rest)).alias("row")).select(*keys, "row.*")


def components(telemetry: DataFrame, as_of: Iterable[int], reg: Registry = REGISTRY) -> DataFrame:
    """as_of_hours, component_id, lot_id, readings (by parameter and checkpoint): one row per component and horizon.

    The horizon filter reaches the scan; horizons share the one component shuffle. Telemetry
    with an ``arrival_seq`` column may repeat readings: the last to arrive counts. Without it
    readings are unique per component, parameter and checkpoint.
    """
    horizons = sorted(set(int(t) for t in as_of))
    if ARRIVAL in telemetry.columns:
        telemetry = latest(telemetry)
    have = [c if c in telemetry.columns else None for c in READING]
    seen = telemetry.where(F.col("elapsed_hours") <= horizons[-1]).withColumn(
        "u", transform("parameter_name", "value", reg)
    )
    absent = {"measurement_quality": F.lit("VALID")}
    cols = [
        F.col(c) if (h or c == "u") else absent.get(c, F.lit(None).cast("double" if "limit" in c else "string")).alias(c)
        for c, h in zip(READING, have)
    ]
    seen = seen.select("component_id", "lot_id", "parameter_name", *cols)
    got = seen.groupBy("component_id", "lot_id").agg(
        F.sort_array(F.collect_list(F.struct("parameter_name", *READING))).alias("readings")
    )
    if len(horizons) == 1:
        return got.select(F.lit(horizons[0]).alias("as_of_hours"), "component_id", "lot_id", "readings")
    got = got.withColumn("as_of_hours", F.explode(F.array(*[F.lit(t) for t in horizons])))
    got = got.withColumn("readings", F.filter("readings", lambda r: r["elapsed_hours"] <= F.col("as_of_hours")))
    return got.where(F.size("readings") > 0).select("as_of_hours", "component_id", "lot_id", "readings")


def is_skewed_components(comps: DataFrame) -> bool:
    """The same probe on component rows, where they are already at hand."""
    read = comps.select("lot_id", F.explode("readings").alias("r"))
    return has_large_groups(read.select("lot_id", "r.parameter_name", "r.elapsed_hours"), ["lot_id", "parameter_name", "elapsed_hours"])


def series(comps: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """One row per component, horizon and registered parameter, with ordered history."""
    names = F.array(*[F.lit(n) for n in reg.names])
    s = comps.withColumn("parameter_name", F.explode(names))
    # readings come ordered, so a parameter's own are in the order of time
    s = s.withColumn("obs", F.expr("filter(readings, r -> r.parameter_name = parameter_name)")).drop("readings")
    s = s.withColumns(
        {
            "pts": F.expr(
                "transform(filter(obs, r -> r.u IS NOT NULL), r -> named_struct('t', r.elapsed_hours, 'u', r.u))"
            ),
            "now": F.expr("get(filter(obs, r -> r.elapsed_hours = as_of_hours), 0)"),
            "zero": F.expr("get(filter(obs, r -> r.elapsed_hours = 0), 0)"),
            "first_bad": F.expr("array_min(transform(filter(obs, r -> r.u IS NULL), r -> r.elapsed_hours))"),
            "prev_t": F.expr(
                "array_max(transform(filter(obs, r -> r.elapsed_hours < as_of_hours), r -> r.elapsed_hours))"
            ),
        }
    )
    s = s.withColumns(
        {
            "has_now": F.expr("now IS NOT NULL"),
            "u_now": F.expr("now.u"),
            "u_zero": F.expr("zero.u"),
            "floor": reg.floor(),
        }
    )
    return s.withColumns(
        {
            # peers' shifts stop contributing at their first untransformable reading
            "steps": F.expr(
                "IF(u_zero IS NULL, CAST(array() AS ARRAY<STRUCT<t: INT, u: DOUBLE>>), "
                "transform(filter(pts, p -> p.t > 0 AND (first_bad IS NULL OR p.t < first_bad)), "
                "p -> named_struct('t', p.t, 'u', p.u - u_zero)))"
            ),
            "end_shift": F.expr("IF(as_of_hours > 0, u_now - u_zero, NULL)"),
            "joint_x": F.expr("IF(as_of_hours > 0 AND zero IS NOT NULL, u_now - u_zero, u_now)"),
        }
    )


KINDS = ("level", "step", "end", "joint", "chamber")


def _measures(kinds: Sequence[str]) -> Column:
    """Long (kind, t, x) view of a series: what the lot statistics are taken over; a kind goes by its place in ``KINDS``."""
    typ = "array<struct<kind:int,t:int,x:double>>"

    expr = {
        "level": "transform(pts, p -> named_struct('kind', 0, 't', p.t, 'x', p.u))",
        "step": "transform(steps, p -> named_struct('kind', 1, 't', p.t, 'x', p.u))",
        "end": "array(named_struct('kind', 2, 't', -1, 'x', end_shift))",
        "joint": "array(named_struct('kind', 3, 't', -1, 'x', joint_x))",
        "chamber": "transform(filter(pts, p -> p.t < as_of_hours), "
        "p -> named_struct('kind', 4, 't', p.t, 'x', u_now - p.u))",
    }
    return F.concat(*[F.expr(expr[k]).cast(typ) for k in kinds])


def lot_context(
    ser: DataFrame,
    kinds: Sequence[str] = ("level", "step", "end", "chamber", "joint"),
    channels: bool = True,
    skewed: bool | None = None,
) -> DataFrame:
    """Per (horizon, lot, parameter): sizes, LOO records by kind and checkpoint, channel medians.

    All statistics of all kinds come out of one grouped pass over the series.
    """
    base = ser.groupBy(*LOT_KEYS).agg(
        F.count(F.lit(1)).alias("lot_size"),
        F.count_if("has_now").alias("n_now"),
        F.max("prev_t").alias("lot_prev_t"),
    )
    # where lots are few, rows that go through many counts carry a number for the names of their lot
    base = cut(base.withColumn("__lot", F.monotonically_increasing_id()))
    few = base.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    lot = ["__lot"] if few else LOT_KEYS

    def numbered(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(base.select(*LOT_KEYS, "__lot")), LOT_KEYS) if few else rows

    if kinds:
        long = numbered(ser).select(*lot, _measures(kinds).alias("m"))
        # large lots are read several times: their measures are written once, a row to a series
        long = long if skewed is False else cut(long)
        long = long.select(*lot, F.explode("m").alias("m")).select(*lot, F.col("m.kind").alias("kind"), F.col("m.t").alias("t"), F.col("m.x").alias("x"))
        rec = loo_record(long, [*lot, "kind", "t"], "x", skewed)
        name = F.concat(F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.col("t").cast("string"))
        rec = rec.groupBy(*lot).agg(F.map_from_entries(F.collect_list(F.struct(name, "loo"))).alias("rec"))
        base = base.join(rec, lot, "left")
    if channels:
        now = numbered(ser.where(F.col("u_now").isNotNull())).select(*lot, F.col("now.channel_id").alias("channel"), F.col("u_now").alias("x"))
        ch = leave_label_out_median(now, lot, "channel", "x", skewed)
        ch = ch.groupBy(*lot).agg(
            F.map_from_entries(
                F.collect_list(F.struct("channel", F.struct("n_in", "med_in", "n_out", "med_out")))
            ).alias("chan")
        )
        base = base.join(ch, lot, "left")
    return base.drop("__lot")


def with_context(ser: DataFrame, ctx: DataFrame, kinds: Sequence[str] = ("level", "step", "end", "chamber", "joint")) -> DataFrame:
    """Attach the lot context (a handful of rows per lot; written once, broadcast or co-shuffled by its
    counted size) and name the records the detectors read: those of the lot there, those of a reading here."""
    lot, about = {}, "named_struct('n', {0}.n, 'mid', {0}.mid, 'centre', {0}.centre)"
    # of a record that many rows carry only what its reader takes
    if "level" in kinds:
        lot["lvl_now"] = F.expr("try_element_at(rec, concat('level', string(as_of_hours)))")
        lot["lvl_zero"] = F.expr("try_element_at(rec, 'level0')")
    if "end" in kinds:
        lot["end_rec"] = F.expr("transform(array(try_element_at(rec, 'end-1')), v -> IF(v IS NULL, NULL, " + about.format("v") + "))[0]")
    if "joint" in kinds:
        lot["joint_rec"] = F.expr("try_element_at(rec, 'joint-1')")
    if "chamber" in kinds:
        shift = "named_struct('n', v.n, 'n_pos', v.n_pos, 'n_neg', v.n_neg, 'centre', v.centre)"
        lot["chamber_rec"] = F.expr(f"transform(array(try_element_at(rec, concat('chamber', string(lot_prev_t)))), v -> IF(v IS NULL, NULL, {shift}))[0]")
    for kind, part in (("level", "named_struct('n', v.n, 'dev', v.dev)"), ("step", about.format("v"))):
        if kind in kinds:  # by checkpoint
            own = f"transform_keys(map_filter(rec, (k, v) -> startswith(k, '{kind}')), (k, v) -> int(substring(k, {len(kind) + 1})))"
            lot[f"{kind}_recs"] = F.expr(f"transform_values({own}, (k, v) -> {part})")
    channels = "chan" in ctx.columns
    ctx = cut(ctx.withColumns(lot).drop("rec") if kinds else ctx)
    s = ser.join(broadcast_if_small(ctx, CONTEXT_ROWS), LOT_KEYS, "left").withColumn("t_before", F.get("obs", F.size("obs") - 2)["elapsed_hours"])
    named = {}
    if "level" in kinds:
        named["lvl_before"] = F.expr("try_element_at(level_recs, t_before)")
    if channels:
        named["channel"] = F.expr("now.channel_id")
        named["ch"] = F.expr("try_element_at(chan, now.channel_id)")
    s = s.withColumns(named) if named else s
    return s.drop("chan", "level_recs")
