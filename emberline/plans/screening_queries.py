"""Queries of the robust kernel, the detectors, the scores and the fused dispositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberline.functions import scalars as SC
from emberline.functions.scalars import r6
from emberline.operators import decomposition as DC
from emberline.operators import detectors as D
from emberline.operators import represent as R
from emberline.operators.loo import with_loo
from emberline.operators.ranks import group_median_mad
from emberline.plans import evidence as E
from emberline.plans import screening as S
from emberline.plans.catalog import query
from emberline.plans.oracle_parts import FLOOR, HIGH, LOW, TU, erf, inv, loo, med_mad
from emberline.plans.oracle_parts import r6 as o6
from emberline.plans.screening_oracle import component_ctes, joint_ctes, screen_ctes
from emberline.registry import REGISTRY
from emberline.sources import adapters as A

T = 168
W = "WITH "
GROUP = ["lot_id", "parameter_name", "elapsed_hours"]
ID = ["component_id", "parameter_name"]
SCREEN = W + screen_ctes(T)
COMPONENTS = W + component_ctes(T)


def tel(spark, d):
    return A.telemetry_parts(spark, d)


def tu(spark, d):
    return R.with_u(tel(spark, d))


@query("loo_median", W + TU + ",\n" + loo("l", "tu", "lot_id, parameter_name, elapsed_hours") + f" SELECT component_id, parameter_name, elapsed_hours, CAST(ln AS BIGINT) AS n_peers, {o6('lmed')} AS loo_median FROM l0 l")
def loo_median(spark, d):
    out = with_loo(tu(spark, d), GROUP, "u")
    return out.select(*ID, "elapsed_hours", F.col("loo_n").alias("n_peers"), r6("loo_med").alias("loo_median"))


@query("loo_scale", W + TU + ",\n" + loo("l", "tu", "lot_id, parameter_name, elapsed_hours") + f" SELECT component_id, parameter_name, elapsed_hours, {o6('lmad')} AS loo_mad, {o6('greatest(1.4826::DOUBLE * lmad, flr)')} AS loo_scale FROM l")
def loo_scale(spark, d):
    out = with_loo(tu(spark, d), GROUP, "u", REGISTRY.floor())
    return out.select(*ID, "elapsed_hours", r6("loo_mad").alias("loo_mad"), r6("loo_scale").alias("loo_scale"))


@query("lot_median_mad", W + TU + ",\n" + med_mad("m", "tu", "lot_id, parameter_name, elapsed_hours") + f" SELECT lot_id, parameter_name, elapsed_hours, n, {o6('med')} AS median, {o6('mad')} AS mad FROM m")
def lot_median_mad(spark, d):
    return group_median_mad(tu(spark, d), GROUP, "u").select(*GROUP, "n", r6("median").alias("median"), r6("mad").alias("mad"))


def ctx(spark, d, kinds=(), channels=False):
    return S.contextual_series(tel(spark, d), T, kinds=kinds, channels=channels)


@query("d_spec", SCREEN + " SELECT component_id, parameter_name, spec_status AS status, spec_reason AS reason FROM spec")
def d_spec(spark, d):
    return D.detect(ctx(spark, d), "spec").select(*ID, "spec.status", "spec.reason")


@query(
    "d_peer",
    SCREEN + f" SELECT component_id, parameter_name, peer_status AS status, peer_reason AS reason, {o6('z')} AS z, {o6('CASE WHEN z IS NOT NULL THEN ' + inv('lmed') + ' END')} AS median, {o6('CASE WHEN z IS NOT NULL THEN scale END')} AS scale FROM peer",
)
def d_peer(spark, d):
    p = D.detect(ctx(spark, d, ("level",)), "peer")
    return p.select(*ID, "peer.status", "peer.reason", r6("peer.z").alias("z"), r6("peer.median").alias("median"), r6("peer.scale").alias("scale"))


@query("d_sufficiency", SCREEN + " SELECT component_id, parameter_name, suff_status AS status, sufficient, suff_reason AS reason FROM suff")
def d_sufficiency(spark, d):
    return D.detect(ctx(spark, d), "suff").select(*ID, "suff.status", "suff.sufficient", "suff.reason")


@query("d_chamber", SCREEN + f" SELECT component_id, parameter_name, {o6('lot_shift')} AS lot_shift, {o6('share')} AS share, chit AS suspected FROM eq")
def d_chamber(spark, d):
    s = D.detect(ctx(spark, d, ("level", "chamber"), True), "eq")
    return s.select(*ID, r6("eq.lot_shift").alias("lot_shift"), r6("eq.share").alias("share"), F.col("eq.chamber_suspected").alias("suspected"))


@query("d_channel", SCREEN + f" SELECT component_id, parameter_name, n_in AS n_channel, n_out AS n_other, {o6('off')} AS channel_offset, {o6('cz')} AS z, bhit AS suspected FROM eq")
def d_channel(spark, d):
    s = D.detect(ctx(spark, d, ("level", "chamber"), True), "eq")
    return s.select(
        *ID, "eq.n_channel", "eq.n_other", r6("eq.channel_offset").alias("channel_offset"),
        r6("eq.channel_z").alias("z"), F.col("eq.channel_suspected").alias("suspected"),
    )


@query("d_equipment", SCREEN + f" SELECT component_id, parameter_name, eq_status AS status, suspected, eq_reason AS reason, {o6('mag', 4)} AS common_mode, {o6('least(1.0::DOUBLE, mag / 5)', 4)} AS score FROM eq")
def d_equipment(spark, d):
    s = D.detect(ctx(spark, d, ("level", "chamber"), True), "eq")
    return s.select(*ID, "eq.status", "eq.suspected", "eq.reason", "eq.common_mode", "eq.score")


IDLE = "CASE WHEN NOT has_now THEN NULL WHEN k < 2 THEN 0.0::DOUBLE ELSE {} END"


@query(
    "d_drift",
    SCREEN + f" SELECT component_id, parameter_name, drift_status AS status, drift_reason AS reason, {o6(IDLE.format('g'))} AS g, {o6(IDLE.format('g_lot'))} AS g_lot, {o6(IDLE.format('g_excess'))} AS g_excess, {o6(IDLE.format('slope'), 8)} AS slope, {o6(IDLE.format('cusum'), 4)} AS cusum, persistent FROM drift",
)
def d_drift(spark, d):
    s = D.detect(ctx(spark, d, ("level", "step", "end", "chamber"), True), "eq", "drift")
    return s.select(
        *ID, "drift.status", "drift.reason", *[r6(f"drift.{c}").alias(c) for c in ("g", "g_lot", "g_excess")],
        r6("drift.slope", 8).alias("slope"), r6("drift.cusum", 4).alias("cusum"), "drift.persistent",
    )


@query("d_step", SCREEN + f" SELECT component_id, parameter_name, step_status AS status, step_reason AS reason, {o6('magnitude')} AS magnitude, {o6('ratio')} AS ratio FROM step")
def d_step(spark, d):
    s = D.detect(ctx(spark, d, ("level",)), "step")
    return s.select(*ID, "step.status", "step.reason", r6("step.magnitude").alias("magnitude"), r6("step.ratio").alias("ratio"))


PAIRS = TU + """, pr AS (SELECT a.component_id, a.parameter_name, median((b.u - a.u) / (b.elapsed_hours - a.elapsed_hours)) AS slope FROM tu a JOIN tu b ON a.component_id = b.component_id AND a.parameter_name = b.parameter_name AND b.elapsed_hours > a.elapsed_hours GROUP BY 1, 2)"""


@query("theil_sen", W + PAIRS + f" SELECT component_id, parameter_name, {o6('slope', 8)} AS slope FROM pr")
def theil_sen(spark, d):
    from emberline.functions.series import theil_sen as ts

    t = R.trajectories(tu(spark, d)).where(F.size("pts") >= 2)
    return t.select(*ID, r6(ts(F.col("pts")), 8).alias("slope"))


@query(
    "acceleration",
    W + TU + f""", s AS (SELECT component_id, parameter_name, elapsed_hours AS t, (u - lag(u) OVER w) / (elapsed_hours - lag(elapsed_hours) OVER w) AS sl FROM tu WINDOW w AS (PARTITION BY component_id, parameter_name ORDER BY elapsed_hours)),
 k AS (SELECT component_id, parameter_name, t, sl - lag(sl) OVER (PARTITION BY component_id, parameter_name ORDER BY t) AS kappa FROM s)
SELECT component_id, parameter_name, {o6('arg_max(kappa, t)', 8)} AS kappa FROM k GROUP BY 1, 2 HAVING count(*) >= 3""",
)
def acceleration(spark, d):
    from emberline.functions.series import acceleration as acc

    t = R.trajectories(tu(spark, d)).where(F.size("pts") >= 3)
    return t.select(*ID, r6(acc(F.col("pts")), 8).alias("kappa"))


@query("cusum", SCREEN + f" SELECT component_id, parameter_name, {o6('cusum', 4)} AS cusum, persistent FROM drift WHERE has_now AND k >= 2")
def cusum(spark, d):
    s = D.detect(ctx(spark, d, ("level", "step", "end", "chamber"), True), "eq", "drift", fields={"eq": ["suspected"], "drift": ["cusum", "persistent"]})
    return s.where("has_now AND size(obs) >= 2").select(*ID, r6("drift.cusum", 4).alias("cusum"), "drift.persistent")


@query("d_joint", COMPONENTS + f" SELECT component_id, {o6('d', 4)} AS distance, coalesce(d >= 4.25, false) AS suspected FROM cf")
def d_joint(spark, d):
    c = S.joint_only(tel(spark, d), T)
    return c.select("component_id", r6("joint.distance", 4).alias("distance"), "joint.suspected")


@query(
    "decomposition",
    W + TU + ",\nz0 AS (SELECT * FROM tu WHERE elapsed_hours IN (0, 96)),\n" + loo("l", "z0", "lot_id, parameter_name, elapsed_hours")
    + f""", w AS (SELECT component_id, parameter_name, max(u) FILTER (elapsed_hours = 0) AS u0, max(u) FILTER (elapsed_hours = 96) AS ut, max(ln) FILTER (elapsed_hours = 0) AS n0, max(ln) FILTER (elapsed_hours = 96) AS nt,
 max(lmed) FILTER (elapsed_hours = 0) AS m0, max(lmed) FILTER (elapsed_hours = 96) AS mt, max(greatest(1.4826::DOUBLE * lmad, flr)) FILTER (elapsed_hours = 0) AS s0 FROM l GROUP BY 1, 2),
 x AS (SELECT *, CASE WHEN n0 >= 4 THEN (u0 - m0) / s0 END AS b, CASE WHEN n0 >= 4 AND nt >= 4 THEN ((ut - mt) - (u0 - m0)) / s0 END AS g FROM w)
SELECT component_id, parameter_name, {o6('b')} AS b, {o6('g')} AS g, CASE WHEN b IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(b) >= 3.5 THEN 'MAJOR_OUTLIER' WHEN abs(b) >= 2.5 THEN 'OUTLIER' WHEN abs(b) >= 1.5 THEN 'SUSPECT' ELSE 'NORMAL' END AS peer_status,
 CASE WHEN g IS NULL THEN 'INSUFFICIENT_DATA' WHEN abs(g) >= 3 THEN 'ACCELERATING' WHEN abs(g) >= 1.5 THEN 'DRIFTING' ELSE 'STABLE' END AS trend_status,
 CASE WHEN u0 IS NULL THEN 'MISSING_BASELINE' WHEN n0 < 4 THEN 'FEW_PEERS_AT_BASELINE' WHEN ut IS NULL THEN 'MISSING_OBSERVATION' WHEN nt < 4 THEN 'FEW_PEERS_AT_CHECKPOINT' ELSE 'OK' END AS note FROM x""",
)
def decomposition(spark, d):
    out = DC.decomposition(tu(spark, d), 96)
    return out.select(*ID, r6("b").alias("b"), r6("g").alias("g"), "peer_status", "trend_status", "note")


NAIVE = ",\nnw AS (SELECT * FROM tu WHERE elapsed_hours = 168),\n" + med_mad("nm", "nw", "lot_id, parameter_name") + ",\nnz AS (SELECT w.component_id, w.lot_id, w.parameter_name, (w.u - m.med) / greatest(1.4826::DOUBLE * m.mad, w.flr) AS z FROM nw w JOIN nm m ON m.lot_id = w.lot_id AND m.parameter_name = w.parameter_name)"


@query("naive_screen", W + TU + NAIVE + f" SELECT component_id, parameter_name, {o6('z')} AS z, abs(z) >= 3 AS reject FROM nz")
def naive_screen(spark, d):
    return DC.naive_screen(tu(spark, d), T).select(*ID, r6("z").alias("z"), "reject")


@query("static_screen", W + TU + f" SELECT DISTINCT component_id, lot_id FROM tu WHERE elapsed_hours = 168 AND (value < {LOW} OR value > {HIGH})")
def static_screen(spark, d):
    return DC.static_screen(tel(spark, d), T)


@query("score_peer", SCREEN + f" SELECT component_id, parameter_name, {o6(erf('z / sqrt(2)'), 4)} AS score FROM peer WHERE z IS NOT NULL")
def score_peer(spark, d):
    p = D.detect(ctx(spark, d, ("level",)), "peer", fields={"peer": ["z", "score"]})
    return p.where("peer.z IS NOT NULL").select(*ID, F.col("peer.score").alias("score"))


@query(
    "score_drift",
    SCREEN + f" SELECT component_id, parameter_name, {o6('greatest(' + erf('g / sqrt(2)') + ', CASE WHEN cusum <= 0 THEN 0.0::DOUBLE ELSE 1 / (1 + exp(-1.5 * (cusum - 3.5))) END)', 4)} AS score FROM drift WHERE has_now AND k >= 2",
)
def score_drift(spark, d):
    s = D.detect(ctx(spark, d, ("level", "step", "end", "chamber"), True), "eq", "drift", fields={"eq": ["suspected"], "drift": ["score"]})
    return s.where("has_now AND size(obs) >= 2").select(*ID, F.col("drift.score").alias("score"))


@query("score_step", SCREEN + f" SELECT component_id, parameter_name, {o6('CASE WHEN j <= 0 THEN 0.0::DOUBLE ELSE 1 / (1 + exp(-1.5 * (j - 4))) END', 4)} AS score FROM step WHERE has_now AND k >= 2")
def score_step(spark, d):
    s = D.detect(ctx(spark, d, ("level",)), "step")
    return s.where("has_now AND size(obs) >= 2").select(*ID, F.col("step.score").alias("score"))


@query("score_joint", COMPONENTS + f" SELECT component_id, {o6('1 - (1 + 0.5 * d * d) * exp(-0.5 * d * d)', 4)} AS score FROM cf WHERE d IS NOT NULL")
def score_joint(spark, d):
    return S.joint_only(tel(spark, d), T).where("joint.distance IS NOT NULL").select("component_id", F.col("joint.score").alias("score"))


def _lg(x):
    return f"coalesce(1 / (1 + exp(-1.2 * (abs({x}) / greatest(flr, 1e-9) - 3.0))), 0.0::DOUBLE)"


@query("score_equipment", SCREEN + f" SELECT component_id, parameter_name, {o6('greatest(' + _lg('lot_shift') + ', ' + _lg('off') + ')', 4)} AS score FROM eq WHERE has_now")
def score_equipment(spark, d):
    s = D.detect(ctx(spark, d, ("level", "chamber"), True), "eq", fields={"eq": ["lot_shift", "channel_offset"]}).where("has_now")
    return s.select(*ID, SC.score_equipment("eq.lot_shift", "eq.channel_offset", "floor").alias("score"))


FUSED = ["state", "qualifier", "reason"]


@query("fuse_parameter", SCREEN + " SELECT component_id, parameter_name, state, qualifier, reason, drifting FROM pf")
def fuse_parameter(spark, d):
    return S.screen_parameters(tel(spark, d), T, fields={}).select(*ID, "fused.state", "fused.qualifier", "fused.reason", "fused.drifting")


@query(
    "screen_parameters",
    SCREEN + f""" SELECT as_of_hours, component_id, lot_id, parameter_name, {o6('value')} AS value, spec_status, peer_status, {o6('z')} AS z, drift_status, step_status, eq_status, suff_reason, state, qualifier, reason FROM pf""",
)
def screen_parameters(spark, d):
    s = S.screen_parameters(tel(spark, d), T, fields={"peer": ["z"], "eq": ["status"]})
    return s.select(
        "as_of_hours", "component_id", "lot_id", "parameter_name", r6("now.value").alias("value"), F.col("spec.status").alias("spec_status"),
        F.col("peer.status").alias("peer_status"), r6("peer.z").alias("z"), F.col("drift.status").alias("drift_status"),
        F.col("step.status").alias("step_status"), F.col("eq.status").alias("eq_status"), F.col("suff.reason").alias("suff_reason"),
        "fused.state", "fused.qualifier", "fused.reason",
    )


@query("fuse_component", COMPONENTS + " SELECT component_id, state, qualifier, compound FROM cf")
def fuse_component(spark, d):
    return S.screen_components(tel(spark, d), T, evidence=False).select("component_id", "final.state", "final.qualifier", "final.compound")


REPEATED = COMPONENTS.replace("\ntel AS (", "\ntel0 AS (").replace(
    ",\ntu AS",
    ",\ntel AS (SELECT * REPLACE (CASE WHEN parameter_name = 'RDS(on)' AND elapsed_hours = 168 AND CAST(substr(component_id, 2) AS BIGINT) % 10 = 0 THEN 70.0 ELSE value END AS value) FROM tel0),\ntu AS",
    1,
)


def repeated_telemetry(spark, d):
    """Every 96 h reading was taken twice, the first time wrongly; every tenth part was read again at 168 h, in breach."""
    t = tel(spark, d)
    early = t.where("elapsed_hours = 96").withColumn("value", F.col("value") * 1.5).withColumn("arrival_seq", F.lit(0))
    late = t.where("parameter_name = 'RDS(on)' AND elapsed_hours = 168 AND cast(substr(component_id, 2) AS bigint) % 10 = 0")
    late = late.withColumn("value", F.lit(70.0)).withColumn("arrival_seq", F.lit(2))
    return early.unionByName(late).unionByName(t.withColumn("arrival_seq", F.lit(1)))


@query("screen_repeated_readings", REPEATED + " SELECT component_id, state, qualifier, reason FROM cf")
def screen_repeated_readings(spark, d):
    c = S.screen_components(repeated_telemetry(spark, d), T, evidence=False)
    return c.select("component_id", "final.state", "final.qualifier", "final.reason")


@query("screen_components", COMPONENTS + " SELECT as_of_hours, component_id, lot_id, state, qualifier, reason, compound FROM cf")
def screen_components(spark, d):
    c = S.screen_components(tel(spark, d), T, evidence=False)
    return c.select("as_of_hours", "component_id", "lot_id", "final.state", "final.qualifier", "final.reason", "final.compound")


@query(
    "state_evolution",
    " UNION ALL ".join(f"(WITH {component_ctes(t)} SELECT as_of_hours, state, qualifier, count(*) AS n FROM cf GROUP BY 1, 2, 3)" for t in (0, 24, 96, 168)),
)
def state_evolution(spark, d):
    c = S.screen_components(tel(spark, d), [0, 24, 96, 168], evidence=False)
    return c.groupBy("as_of_hours", "final.state", "final.qualifier").agg(F.count(F.lit(1)).alias("n"))


@query(
    "lot_statuses",
    COMPONENTS + " SELECT lot_id, component_id, state, CASE state WHEN 'FAIL' THEN 'CONDEMN_TO_SCRAP' WHEN 'EQUIPMENT_SUSPECTED' THEN 'QUARANTINE_SOCKET_RETEST' WHEN 'HOLD' THEN 'HOLD_MATERIAL_REVIEW_BOARD' WHEN 'INSUFFICIENT_DATA' THEN 'DEFER_INSUFFICIENT_DATA' ELSE 'CLEARED_FOR_FLIGHT' END AS action FROM cf",
)
def lot_statuses(spark, d):
    return E.lot_statuses(S.screen_components(tel(spark, d), T, evidence=False))


@query(
    "equipment_diagnostics",
    SCREEN + f""", c AS (SELECT lot_id, parameter_name, channel_id, any_value(lot_shift) AS lot_shift, bool_or(chit) AS chamber, bool_or(bhit) AS biased, any_value(cz) AS cz, count(*) AS n FROM eq WHERE has_now AND channel_id IS NOT NULL GROUP BY 1, 2, 3)
SELECT lot_id, channel_id AS channel, max(n) AS n_affected, bool_or(chamber) AS chamber_suspected, bool_or(biased) AS channel_suspected, {o6('max(abs(cz))')} AS worst_z,
 CASE WHEN bool_or(chamber) THEN 'INSPECT_CHAMBER' WHEN bool_or(biased) THEN 'RECALIBRATE_CHANNEL' ELSE 'NO_ACTION' END AS action FROM c GROUP BY 1, 2""",
)
def equipment_diagnostics(spark, d):
    s = D.detect(ctx(spark, d, ("level", "chamber"), True), "eq")
    return E.equipment_diagnostics(s).withColumn("worst_z", r6("worst_z"))


CHANNELS = SCREEN + """, c AS (SELECT lot_id, channel_id AS channel, component_id, bhit, off, cz, CASE WHEN bhit THEN 'B' WHEN n_in < 4 OR n_out < 4 THEN 'S' ELSE 'N' END AS k, n_in, n_out FROM eq WHERE has_now AND channel_id IS NOT NULL AND parameter_name = 'RDS(on)'),
v AS (SELECT lot_id, channel, count(DISTINCT component_id) AS n_components, max(off) AS off, max(cz) AS cz, min(k) AS k, max(n_in) AS n_in FROM c GROUP BY 1, 2),
w AS (SELECT lot_id, bool_or(k = 'B') AS hit, CAST(coalesce(sum(n_components) FILTER (k = 'B'), 0) AS BIGINT) AS n_affected FROM v GROUP BY 1)"""


@query(
    "channel_verdicts",
    CHANNELS + f""" SELECT v.lot_id, channel, n_components, {o6('off')} AS channel_offset, {o6('cz')} AS z, CASE k WHEN 'B' THEN 'ATE_CHANNEL_FIXTURE_BIAS' WHEN 'S' THEN CASE WHEN n_in < 4 THEN 'CHANNEL_BIAS_SUPPRESSED_SMALL_SAMPLE' ELSE 'INSUFFICIENT_REFERENCE_POPULATION' END ELSE 'NOMINAL_ATE_CHANNEL' END AS reason,
 CASE k WHEN 'B' THEN 'DRIFT_SUSPECTED' WHEN 'S' THEN 'SUPPRESSED' ELSE 'NOMINAL' END AS status, CASE k WHEN 'B' THEN 'QUARANTINE_SOCKET_FIXTURE' WHEN 'S' THEN 'SAMPLE_INSUFFICIENT' ELSE 'ACCEPT_FOR_FLIGHT' END AS action, CASE WHEN hit THEN 'EXCURSION_DETECTED' ELSE 'NOMINAL' END AS fixture_status, n_affected
FROM v JOIN w USING (lot_id)""",
)
def channel_verdicts(spark, d):
    s = D.detect(ctx(spark, d, ("level", "chamber"), True), "eq")
    return E.channel_verdicts(s).withColumns({"channel_offset": r6("channel_offset"), "z": r6("z")})


@query("affected_components", CHANNELS + " SELECT DISTINCT lot_id, channel, component_id FROM c WHERE bhit")
def affected_components(spark, d):
    return E.affected_components(D.detect(ctx(spark, d, ("level", "chamber"), True), "eq", fields={"eq": ["channel", "channel_suspected"]}))


@query(
    "naive_vs_aware",
    COMPONENTS + NAIVE + """, nr AS (SELECT component_id, bool_or(abs(z) >= 3) AS naive FROM nz GROUP BY 1)
SELECT state, coalesce(naive, false) AS naive_reject, count(*) AS n FROM cf LEFT JOIN nr USING (component_id) GROUP BY 1, 2""",
)
def naive_vs_aware(spark, d):
    naive = DC.naive_screen(tu(spark, d), T)
    return E.naive_vs_aware(naive, S.screen_components(tel(spark, d), T, evidence=False))


@query(
    "g_excess_sweep",
    SCREEN + " SELECT c.cut, count(*) FILTER (suspected AND (coalesce(abs(g_excess) >= c.cut, false) OR persistent)) AS n_confounded, count(*) FILTER (suspected AND NOT (coalesce(abs(g_excess) >= c.cut, false) OR persistent)) AS n_equipment_only FROM pf, (VALUES (1.0::DOUBLE), (1.5), (2.0), (2.5), (3.0), (3.5), (4.0)) c(cut) GROUP BY 1",
)
def g_excess_sweep(spark, d):
    s = D.detect(ctx(spark, d, ("level", "step", "end", "chamber"), True), "eq", "drift", fields={"eq": ["suspected"], "drift": ["g", "g_excess", "persistent"]})
    return E.g_excess_sweep(s, [1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0])
