"""Screening detectors: each adds one evidence struct to series rows that carry lot context.

Every detector first names its intermediate quantities as columns and then classifies them,
so that nothing is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import series as S
from emberline.functions.scalars import (
    MAD_SCALE,
    MAD_SCALE_CHANNEL,
    MEDIAN_SE,
    erf_layers,
    inverse_transform,
    score_drift,
    score_peer,
    score_step,
)
from emberline.operators.layers import Layer, layered, merge, trimmed
from emberline.operators.loo import group_mad, loo_layers
from emberline.registry import REGISTRY, SCHEDULE, Registry

# Decision thresholds.
MIN_LOT = 8
PEER_MILD, PEER_EXTREME = 3.0, 5.0
G_ACCEL, G_SUBTLE, KAPPA_MIN = 3.0, 2.5, 1e-5
CUSUM_SLACK, CUSUM_LIMIT = 0.25, 2.0
MIN_SHIFT_PEERS = 4
STEP_LIMIT = 4.0
CHAMBER_MULT, CHAMBER_SHARE = 3.0, 0.75
MIN_CHANNEL, CHANNEL_Z = 4, 3.42


def _table(case: str, rows: list[tuple[str, str]]):
    """Constant lookup on the name of a classification branch."""
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in rows)
    return F.expr(f"CASE {case} {arms} END")


def spec_layers(reg: Registry = REGISTRY) -> list[Layer]:
    """Absolute limits (row override first), then the tightened screening margin."""
    return [
        {
            # NaN orders above every number in Spark; a NaN reading breaches nothing
            "__sv": F.expr("IF(isnan(now.value), NULL, now.value)"),
            "__slo": F.coalesce(F.col("now.absolute_limit_low"), reg.lookup("spec_low")),
            "__shi": F.coalesce(F.col("now.absolute_limit_high"), reg.lookup("spec_high")),
            "__smg": reg.lookup("margin_high"),
            "__stag": reg.lookup("tag"),
        },
        {
            "__sk": F.expr(
                "CASE WHEN NOT has_now THEN 'none' WHEN __sv < __slo THEN 'low' WHEN __sv > __shi THEN 'high' "
                "WHEN __sv > __smg THEN 'margin' ELSE 'ok' END"
            )
        },
        {
            "spec": F.struct(
                _table(
                    "__sk",
                    [
                        ("none", "'NOT_EVALUATED'"), ("low", "'SPEC_BREACH'"), ("high", "'SPEC_BREACH'"),
                        ("margin", "'SCREENING_MARGIN_BREACH'"), ("ok", "'COMPLIANT'"),
                    ],
                ).alias("status"),
                F.expr("__sk IN ('margin', 'ok')").alias("passed"),
                F.expr("IF(has_now, __slo, NULL)").alias("limit_low"),
                F.expr("CASE __sk WHEN 'none' THEN NULL WHEN 'margin' THEN __smg ELSE __shi END").alias("limit_high"),
                F.expr("IF(__sk = 'margin', 'CLASS_C', 'CLASS_A')").alias("limit_class"),
                _table(
                    "__sk",
                    [
                        ("none", "'MISSING_OBSERVATION_AT_CHECKPOINT'"),
                        ("low", "concat('ABSOLUTE_LIMIT_BREACH_', __stag, '_LOW')"),
                        ("high", "concat('ABSOLUTE_LIMIT_BREACH_', __stag, '_HIGH')"),
                        ("margin", "concat('SCREENING_MARGIN_BREACH_', __stag)"),
                        ("ok", "'SPEC_COMPLIANT'"),
                    ],
                ).alias("reason"),
            )
        },
    ]


def peer_layers(reg: Registry = REGISTRY) -> list[Layer]:
    """Leave-one-out robust z at the horizon; untransformable targets get a status."""
    peer_erf = erf_layers("__pz", "__p")
    return [
        *loo_layers("lvl_now", "u_now", "__p"),
        {
            "__pk": F.expr(
                "CASE WHEN NOT has_now THEN 'none' WHEN u_now IS NULL THEN 'domain' "
                f"WHEN n_now < {MIN_LOT} THEN 'small' WHEN __p_n < {MIN_LOT - 1} THEN 'few' ELSE 'ok' END"
            ),
            "__ps": F.expr(f"greatest({MAD_SCALE}D * __p_mad, floor)"),
        },
        {
            "__pz": F.expr("IF(__pk = 'ok', (u_now - __p_med) / __ps, NULL)"),
            "__pphys": inverse_transform("parameter_name", "__p_med", reg),
        },
        {
            "__pc": F.expr(
                f"CASE WHEN abs(__pz) >= {PEER_EXTREME}D THEN 'extreme' WHEN abs(__pz) >= {PEER_MILD}D THEN 'mild' ELSE __pk END"
            ),
            **peer_erf[0],
        },
        peer_erf[1],
        {
            "peer": F.struct(
                _table(
                    "__pc",
                    [
                        ("none", "'INSUFFICIENT_PEERS'"), ("domain", "'UNTRANSFORMABLE'"),
                        ("small", "'PEER_SUPPRESSED_SMALL_LOT'"), ("few", "'INSUFFICIENT_PEERS'"),
                        ("extreme", "'PEER_EXTREME_OUTLIER'"), ("mild", "'PEER_MILD_OUTLIER'"), ("ok", "'PEER_NORMAL'"),
                    ],
                ).alias("status"),
                F.col("__pz").alias("z"),
                F.expr("IF(__pz IS NULL, NULL, __pphys)").alias("median"),
                F.expr("IF(__pz IS NULL, NULL, __p_mad)").alias("mad"),
                F.expr("IF(__pz IS NULL, NULL, __ps)").alias("scale"),
                F.expr("CASE __pk WHEN 'none' THEN 0L WHEN 'small' THEN n_now - 1 ELSE __p_n END").alias("peer_count"),
                score_peer("__pz", F.col("__p_erf")).alias("score"),
                _table(
                    "__pc",
                    [
                        ("none", "'MISSING_OBSERVATION'"), ("domain", "'UNTRANSFORMABLE_TARGET'"),
                        ("small", "'PEER_SUPPRESSED_SMALL_LOT'"), ("few", "'INSUFFICIENT_VALID_PEERS'"),
                        ("extreme", "'EXTREME_PEER_OUTLIER'"), ("mild", "'MILD_PEER_OUTLIER'"), ("ok", "'PEER_NORMAL'"),
                    ],
                ).alias("reason"),
            )
        },
    ]


def equipment_layers() -> list[Layer]:
    """Chamber excursion over the lot, channel bias inside the lot, and their synthesis."""
    return [
        {
            "__qs": F.expr(f"IF(has_now AND chamber_rec.n >= {MIN_SHIFT_PEERS}, chamber_rec.centre[3], NULL)"),
            "__qin": F.expr("coalesce(ch.n_in, 0L)"),
            "__qout": F.expr("coalesce(ch.n_out, coalesce(lvl_now.n, 0L) - coalesce(ch.n_in, 0L))"),
            "__qmad": group_mad("lvl_now"),
        },
        {
            "__qf": F.expr(
                "IF(abs(__qs) > 1e-6, double(IF(__qs > 0, chamber_rec.n_pos, chamber_rec.n_neg)) / double(chamber_rec.n), NULL)"
            ),
            "__qc": F.expr(
                "CASE WHEN channel IS NULL THEN 'none' "
                f"WHEN __qin < {MIN_CHANNEL} THEN 'small' WHEN __qout < {MIN_CHANNEL} THEN 'few' ELSE 'ok' END"
            ),
        },
        {
            "__qhit": F.expr(
                f"coalesce(has_now AND abs(__qs) >= {CHAMBER_MULT}D * floor AND __qf >= {CHAMBER_SHARE}D, false)"
            ),
            "__qoff": F.expr(
                "CASE WHEN NOT has_now THEN NULL WHEN __qc = 'small' THEN ch.med_in - lvl_now.centre[3] "
                "WHEN __qc = 'ok' THEN ch.med_in - ch.med_out END"
            ),
        },
        {
            "__qz": F.expr(
                f"IF(has_now AND __qc = 'ok', __qoff / ({MEDIAN_SE}D * greatest({MAD_SCALE_CHANNEL}D * __qmad, floor) "
                "* sqrt(1D / __qin + 1D / __qout)), NULL)"
            )
        },
        {
            "__qb": F.expr(f"coalesce(abs(__qz) >= {CHANNEL_Z}D, false)"),
            "__qcr": F.expr(
                f"CASE WHEN abs(__qz) >= {CHANNEL_Z}D THEN 'ATE_CHANNEL_FIXTURE_BIAS' "
                "WHEN __qc = 'none' THEN 'NO_CHANNEL_ID_METADATA' "
                "WHEN __qc = 'small' THEN 'CHANNEL_BIAS_SUPPRESSED_SMALL_SAMPLE' "
                "WHEN __qc = 'few' THEN 'INSUFFICIENT_REFERENCE_POPULATION' ELSE 'NOMINAL_ATE_CHANNEL' END"
            ),
        },
        {
            "__qk": F.expr(
                "CASE WHEN NOT has_now THEN 'none' WHEN __qhit THEN 'chamber' WHEN __qb THEN 'channel' "
                "WHEN __qc <> 'ok' THEN 'suppressed' ELSE 'ok' END"
            ),
            "__qm": F.expr("greatest(0D, coalesce(abs(__qs) / floor, 0D), IF(__qb, abs(__qz), 0D))"),
        },
        {
            "eq": F.struct(
                _table(
                    "__qk",
                    [
                        ("none", "'NOMINAL_EQUIPMENT'"), ("chamber", "'CHAMBER_EXCURSION_SUSPECTED'"),
                        ("channel", "'CHANNEL_BIAS_SUSPECTED'"),
                        ("suppressed", "'CHANNEL_BIAS_SUPPRESSED_SMALL_SAMPLE'"), ("ok", "'NOMINAL_EQUIPMENT'"),
                    ],
                ).alias("status"),
                F.expr("__qhit OR __qb").alias("suspected"),
                _table(
                    "__qk",
                    [
                        ("none", "'NOT_EVALUATED'"), ("chamber", "'CHAMBER_SYNCHRONOUS_EXCURSION'"),
                        ("channel", "__qcr"), ("suppressed", "__qcr"), ("ok", "'NOMINAL_EQUIPMENT_ENVIRONMENT'"),
                    ],
                ).alias("reason"),
                F.col("__qs").alias("lot_shift"),
                F.col("__qf").alias("share"),
                F.col("__qhit").alias("chamber_suspected"),
                F.col("channel").alias("channel"),
                F.expr("IF(channel IS NULL, 0L, __qin)").alias("n_channel"),
                F.expr("IF(channel IS NULL, 0L, __qout)").alias("n_other"),
                F.col("__qoff").alias("channel_offset"),
                F.col("__qz").alias("channel_z"),
                F.col("__qb").alias("channel_suspected"),
                F.col("__qcr").alias("channel_reason"),
                F.expr("round(__qm, 4) + 0D").alias("common_mode"),
                F.expr("round(least(1D, __qm / 5D), 4) + 0D").alias("score"),
            )
        },
    ]


def drift_layers() -> list[Layer]:
    """D3: drift against the LOO lot reference; classification reads the equipment flag."""
    drift_erf = erf_layers("__dg", "__d")
    base = loo_layers("lvl_zero", "u_zero", "__b")
    end = [{k: c for k, c in layer.items() if k not in ("__e_dv", "__e_mad")} for layer in loo_layers("end_rec", "end_shift", "__e")]
    quiet = "('none', 'single', 'thin')"
    few = range(1, S.SHORT)
    # the lot's shift at a reading's checkpoint without the reading's own; 0 where peers are few
    lot_shift = (
        "IF(coalesce({rec}.n, 0L) - int({own} IS NOT NULL) >= " + str(MIN_SHIFT_PEERS) + ", {rec}.centre[CASE WHEN {own} IS NULL THEN 3 "
        "WHEN {own} <= {rec}.mid[0] THEN 0 WHEN {own} <= {rec}.mid[1] THEN 1 ELSE 2 END], 0D)"
    )

    def shown(c, idle="0D"):
        return F.expr(f"CASE WHEN __dk IN ('none', 'thin') THEN NULL WHEN __dk = 'single' THEN {idle} ELSE {c} END")

    calc = [
        base[0] | end[0] | {
            "__dlot": group_mad("lvl_zero"),
            "__dsa": S.short_slopes(F.col("pts")),
            "__dka": S.acceleration(F.col("pts")),
            # departures from the first reading, beside the lot record of the same checkpoint: an array only where points are many
            "__dref": F.expr(
                f"IF(size(pts) > {S.SHORT}, transform(filter(pts, (p, i) -> i > 0), p -> named_struct('d', p.u - get(pts, 0).u, "
                "'own', IF(p.t > 0 AND (first_bad IS NULL OR p.t < first_bad), p.u - u_zero, NULL), "
                "'rec', try_element_at(step_recs, p.t))), NULL)"
            ),
            **{f"__dr{i}": F.expr(f"try_element_at(step_recs, get(pts, {i}).t)") for i in few},
            **{
                f"__do{i}": F.expr(f"IF(get(pts, {i}).t > 0 AND (first_bad IS NULL OR get(pts, {i}).t < first_bad), get(pts, {i}).u - u_zero, NULL)")
                for i in few
            },
        },
        base[1] | end[1] | {
            "__dsl": F.coalesce(S.theil_sen_short(F.col("pts"), F.col("__dsa")), F.lit(0.0)),
            **{f"__dx{i}": F.expr(f"get(pts, {i}).u - get(pts, 0).u - " + lot_shift.format(own=f"__do{i}", rec=f"__dr{i}")) for i in few},
        },
        base[2] | end[2],
        {
            # own LOO scale, else the whole-lot scale, else the noise floor
            "__dsg": F.expr(
                f"CASE WHEN __b_n >= {MIN_LOT - 1} THEN greatest({MAD_SCALE}D * __b_mad, floor) "
                f"WHEN lot_size >= {MIN_LOT} AND lvl_zero.n >= {MIN_LOT - 1} THEN greatest({MAD_SCALE}D * __dlot, floor) "
                "ELSE floor END"
            )
        },
        {
            "__dex": F.expr("transform(__dref, x -> (x.d - " + lot_shift.format(own="x.own", rec="x.rec") + ") / __dsg)"),
            **{f"__de{i}": F.col(f"__dx{i}") / F.col("__dsg") for i in few},
            "__dg": F.expr("(get(pts, size(pts) - 1).u - get(pts, 0).u) / __dsg"),
            "__dgl": F.expr(f"IF(__e_n >= {MIN_SHIFT_PEERS}, __e_med / __dsg, NULL)"),
        },
        {
            "__dcu": F.when(F.size("pts") > S.SHORT, S.cusum(F.col("__dex"), CUSUM_SLACK)).otherwise(
                S.cusum_short(F.size("pts") - 1, [F.col(f"__de{i}") for i in few], CUSUM_SLACK)
            ),
            **drift_erf[0],
        },
    ]
    return [
        *calc,
        drift_erf[1],
        {
            "__dk": F.expr(
                "CASE WHEN NOT has_now THEN 'none' WHEN size(obs) < 2 THEN 'single' WHEN size(pts) < 2 THEN 'thin' "
                f"WHEN abs(__dg) >= {G_ACCEL}D AND __dka > {KAPPA_MIN}D AND __dsl > 0 THEN 'accel' "
                f"WHEN abs(__dg) >= {G_SUBTLE}D THEN 'subtle' "
                f"WHEN size(pts) >= 3 AND __dcu >= {CUSUM_LIMIT}D THEN 'lasting' "
                "WHEN eq.suspected THEN 'confounded' ELSE 'still' END"
            ),
        },
        {
            "drift": F.struct(
                _table(
                    "__dk",
                    [
                        ("none", "'INSUFFICIENT_HISTORY'"), ("single", "'STATIONARY'"),
                        ("thin", "'INSUFFICIENT_HISTORY'"), ("accel", "'ACCELERATING_DRIFT'"),
                        ("subtle", "'SUBTLE_DRIFT'"), ("lasting", "'PERSISTENT_DRIFT'"),
                        ("confounded", "'TEMPORALLY_CONFOUNDED_BY_EQUIPMENT'"), ("still", "'STATIONARY'"),
                    ],
                ).alias("status"),
                _table(
                    "__dk",
                    [
                        ("none", "'MISSING_CURRENT_OBSERVATION'"), ("single", "'BASELINE_INITIAL_OBSERVATION'"),
                        ("thin", "'INSUFFICIENT_TRANSFORMABLE_POINTS'"), ("accel", "'ACCELERATING_TEMPORAL_DRIFT'"),
                        ("subtle", "'SUBTLE_TEMPORAL_DRIFT'"), ("lasting", "'PERSISTENT_TEMPORAL_DRIFT'"),
                        ("confounded", "'TEMPORALLY_CONFOUNDED_BY_EQUIPMENT'"), ("still", "'TEMPORALLY_STATIONARY'"),
                    ],
                ).alias("reason"),
                F.expr(f"IF(__dk IN {quiet}, size(obs), size(pts))").alias("n_obs"),
                shown("__dsl").alias("slope"),
                shown("__dg").alias("g"),
                shown("__dgl").alias("g_lot"),
                shown("coalesce(__dg - __dgl, __dg)").alias("g_excess"),
                shown("__dka", "CAST(NULL AS DOUBLE)").alias("kappa"),
                shown("round(__dcu, 4)").alias("cusum"),
                F.expr(f"__dk NOT IN {quiet} AND size(pts) >= 3 AND __dcu >= {CUSUM_LIMIT}D").alias("persistent"),
                F.expr(
                    f"IF(__dk NOT IN {quiet} AND __dgl IS NULL, 'LOT_REFERENCE_UNAVAILABLE_SMALL_LOT', NULL)"
                ).alias("note"),
                F.when(~F.col("__dk").isin("none", "thin"), F.when(F.col("__dk") == "single", 0.0).otherwise(score_drift("__dg", "__dcu", F.col("__d_erf")))).alias("score"),
            )
        },
    ]


def step_layers() -> list[Layer]:
    """Largest adjacent jump over the lot scale at the second-last checkpoint."""
    few = range(1, S.SHORT)
    none = "named_struct('d', -1D, 'a', 0, 'b', 0)"
    jump = "named_struct('d', __t{b}, 'a', get(obs, {a}).elapsed_hours, 'b', get(obs, {b}).elapsed_hours)"
    return [
        {
            "__tlot": group_mad("lvl_before"),
            # adjacent readings; a pair with an untransformable end gives NULL and is skipped
            "__tj": F.expr(
                f"IF(size(obs) > {S.SHORT}, filter(transform(obs, (r, i) -> named_struct('d', IF(i > 0, abs(r.u - get(obs, i - 1).u), NULL), "
                "'a', get(obs, i - 1).elapsed_hours, 'b', r.elapsed_hours)), j -> j.d IS NOT NULL), NULL)"
            ),
            **{f"__t{i}": F.expr(f"abs(get(obs, {i}).u - get(obs, {i - 1}).u)") for i in few},
        },
        {
            "__tden": F.expr(
                f"IF(as_of_hours > 0 AND lot_size >= {MIN_LOT} AND coalesce(lvl_before.n, 0L) >= {MIN_LOT - 1}, "
                f"greatest({MAD_SCALE}D * __tlot, floor), floor)"
            ),
            # ties keep the earlier interval; all-zero histories report the latest one
            "__tb1": F.expr(
                f"IF(size(obs) > {S.SHORT}, aggregate(__tj, {none}, (s, j) -> IF(j.d > s.d OR s.d <= 0, j, s)), IF(__t1 IS NOT NULL, {jump.format(a=0, b=1)}, {none}))"
            ),
            "__tk": F.expr(
                "CASE WHEN NOT has_now THEN 'none' WHEN size(obs) < 2 THEN 'single' "
                "WHEN coalesce(__t1, __t2, __t3) IS NULL AND coalesce(size(__tj), 0) <= 0 THEN 'bad' ELSE 'ok' END"
            ),
        },
        *[
            {
                f"__tb{i}": F.expr(
                    f"IF(size(obs) <= {S.SHORT} AND __t{i} IS NOT NULL AND (__t{i} > __tb{i - 1}.d OR __tb{i - 1}.d <= 0), {jump.format(a=i - 1, b=i)}, __tb{i - 1})"
                )
            }
            for i in few[1:]
        ],
        {"__tb": F.col(f"__tb{few[-1]}")},
        {"__tr": F.expr("IF(__tk = 'ok', __tb.d / __tden, NULL)")},
        {"__tc": F.expr(f"IF(__tr >= {STEP_LIMIT}D, 'jump', __tk)"), "__ts": score_step("__tr")},
        {
            "step": F.struct(
                _table(
                    "__tc",
                    [
                        ("none", "'INSUFFICIENT_HISTORY'"), ("single", "'NO_STEP'"), ("bad", "'INSUFFICIENT_HISTORY'"),
                        ("jump", "'ABRUPT_JUMP_ALERT'"), ("ok", "'NO_STEP'"),
                    ],
                ).alias("status"),
                _table(
                    "__tc",
                    [
                        ("none", "'MISSING_CURRENT_OBSERVATION'"), ("single", "'NO_PRIOR_CHECKPOINT'"),
                        ("bad", "'INVALID_TRANSFORM_AT_INTERVAL'"), ("jump", "'ABRUPT_STEP_CHANGE'"),
                        ("ok", "'NOMINAL_STEP_INTERVAL'"),
                    ],
                ).alias("reason"),
                F.expr("CASE __tk WHEN 'single' THEN 0D WHEN 'ok' THEN __tb.d END").alias("magnitude"),
                F.expr("IF(__tk = 'single', 0D, __tr)").alias("ratio"),
                F.expr(
                    "CASE __tk WHEN 'ok' THEN __tb.a WHEN 'single' THEN NULL "
                    "WHEN 'none' THEN get(obs, size(obs) - 1).elapsed_hours ELSE t_before END"
                ).alias("t_prev"),
                F.expr("IF(__tk = 'ok', __tb.b, as_of_hours)").alias("t_curr"),
                F.col("__ts").alias("score"),
            )
        },
    ]


def sufficiency_layers(schedule=SCHEDULE) -> list[Layer]:
    """Scheduled checkpoints present, all qualities VALID, lot large enough."""
    due = ", ".join(str(t) for t in sorted(schedule))
    return [
        {
            "__fm": F.expr(
                f"array_join(array_except(filter(array({due}), t -> t <= as_of_hours), "
                "transform(obs, r -> r.elapsed_hours)), '_')"
            ),
            "__fc": F.expr("exists(obs, r -> NOT (r.measurement_quality <=> 'VALID'))"),
        },
        {
            "__fk": F.expr(
                "CASE WHEN __fm <> '' THEN 'gap' WHEN __fc THEN 'corrupt' "
                f"WHEN lot_size < {MIN_LOT} THEN 'small' ELSE 'ok' END"
            )
        },
        {
            "suff": F.struct(
                _table(
                    "__fk",
                    [
                        ("gap", "'INCOMPLETE_HISTORY'"), ("corrupt", "'CORRUPTED_MEASUREMENT'"),
                        ("small", "'SMALL_LOT_RESTRICTION'"), ("ok", "'SUFFICIENT'"),
                    ],
                ).alias("status"),
                F.expr("__fk IN ('small', 'ok')").alias("sufficient"),
                F.col("lot_size").alias("lot_size"),
                F.expr(f"lot_size < {MIN_LOT}").alias("small_lot"),
                F.col("__fm").alias("missing"),
                _table(
                    "__fk",
                    [
                        ("gap", "concat('MISSING_CHECKPOINTS_', __fm)"), ("corrupt", "'CORRUPTED_MEASUREMENT_QUALITY'"),
                        ("small", "'SMALL_LOT_PEER_RESTRICTION'"), ("ok", "'DATA_SUFFICIENT_AND_VALID'"),
                    ],
                ).alias("reason"),
            )
        },
    ]


def detect(
    s: DataFrame, *which: str, reg: Registry = REGISTRY, fields: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Add the evidence structs of the named detectors (drift needs ``eq`` beside it), of all or the given ``fields``."""
    make = {
        "spec": lambda: spec_layers(reg),
        "peer": lambda: peer_layers(reg),
        "eq": equipment_layers,
        "drift": drift_layers,
        "step": step_layers,
        "suff": sufficiency_layers,
    }
    return layered(s, trimmed(merge(*[make[w]() for w in which]), fields or {}))
