"""Oracle CTEs of the screening plan, by brute force over peers (self-joins, no closed forms)."""

from emberline.plans.oracle_parts import EXCL, FLOOR, HIGH, LOW, TU, erf, inv, loo, med_mad


def screen_ctes(t: int) -> str:
    """CTEs up to pf (fused parameters), jd (joint) and cf (fused components) at horizon ``t``."""
    due = ", ".join(f"({h})" for h in (0, 24, 96, 168) if h <= t)
    ts = TU + f""",
hist AS (SELECT *, elapsed_hours AS t FROM tu WHERE elapsed_hours <= {t}),
now0 AS (SELECT * FROM hist WHERE t = {t}),
zero AS (SELECT * FROM hist WHERE t = 0),
comp AS (SELECT DISTINCT component_id, lot_id FROM hist),
lots AS (SELECT lot_id, count(*) AS lot_size FROM comp GROUP BY 1),
par AS (SELECT * FROM (VALUES ('IDSS', 1, 'IDSS'), ('VGS(th)', 2, 'VGSTH'), ('RDS(on)', 3, 'RDSON'), ('IGSS', 4, 'IGSS')) v(parameter_name, ord, tag)),
{loo('pn', 'now0', 'lot_id, parameter_name')},
{loo('pz', 'zero', 'lot_id, parameter_name')},
{med_mad('ml', 'hist', 'lot_id, parameter_name, t')},
sh AS (SELECT b.component_id, b.lot_id, b.parameter_name, b.t, b.u - a.u AS sh FROM hist b JOIN zero a ON a.component_id = b.component_id AND a.parameter_name = b.parameter_name WHERE b.t > 0),
sl AS (SELECT *, count(sh) OVER (PARTITION BY lot_id, parameter_name, t {EXCL}) AS ln, median(sh) OVER (PARTITION BY lot_id, parameter_name, t {EXCL}) AS lmed FROM sh),
sg AS (SELECT lot_id, parameter_name, t, count(*) AS gn, median(sh) AS gmed FROM sh GROUP BY 1, 2, 3),
ser AS (SELECT component_id, parameter_name, count(*) AS k, list(t ORDER BY t) AS tt, list(u ORDER BY t) AS uu, string_agg(CAST(t AS VARCHAR), '_' ORDER BY t) AS seen FROM hist GROUP BY 1, 2),
miss AS (SELECT c.component_id, p.parameter_name, string_agg(CAST(d.h AS VARCHAR), '_' ORDER BY d.h) AS missing FROM comp c, par p, (VALUES {due}) d(h)
  WHERE NOT EXISTS (SELECT 1 FROM hist x WHERE x.component_id = c.component_id AND x.parameter_name = p.parameter_name AND x.t = d.h) GROUP BY 1, 2),
nn AS (SELECT lot_id, parameter_name, count(*) AS n_now FROM now0 GROUP BY 1, 2),
base AS (SELECT {t} AS as_of_hours, c.component_id, c.lot_id, p.parameter_name, p.ord, p.tag, l.lot_size, n.value, n.u, n.channel_id, n.value IS NOT NULL AS has_now, coalesce(s.k, 0) AS k, s.tt, s.uu, coalesce(m.missing, '') AS missing, coalesce(nn.n_now, 0) AS n_now,
   {FLOOR.replace('parameter_name', 'p.parameter_name')} AS flr, {LOW.replace('parameter_name', 'p.parameter_name')} AS lo, {HIGH.replace('parameter_name', 'p.parameter_name')} AS hi, CASE WHEN p.parameter_name = 'RDS(on)' THEN 60.0::DOUBLE END AS mg
  FROM comp c CROSS JOIN par p JOIN lots l ON l.lot_id = c.lot_id LEFT JOIN now0 n ON n.component_id = c.component_id AND n.parameter_name = p.parameter_name
  LEFT JOIN ser s ON s.component_id = c.component_id AND s.parameter_name = p.parameter_name LEFT JOIN miss m ON m.component_id = c.component_id AND m.parameter_name = p.parameter_name
  LEFT JOIN nn ON nn.lot_id = c.lot_id AND nn.parameter_name = p.parameter_name),
spec AS (SELECT component_id, parameter_name, CASE WHEN NOT has_now THEN 'NOT_EVALUATED' WHEN value < lo OR value > hi THEN 'SPEC_BREACH' WHEN value > mg THEN 'SCREENING_MARGIN_BREACH' ELSE 'COMPLIANT' END AS spec_status,
   CASE WHEN NOT has_now THEN 'MISSING_OBSERVATION_AT_CHECKPOINT' WHEN value < lo THEN 'ABSOLUTE_LIMIT_BREACH_' || tag || '_LOW' WHEN value > hi THEN 'ABSOLUTE_LIMIT_BREACH_' || tag || '_HIGH' WHEN value > mg THEN 'SCREENING_MARGIN_BREACH_' || tag ELSE 'SPEC_COMPLIANT' END AS spec_reason FROM base),
pz1 AS (SELECT b.component_id, b.parameter_name, b.has_now, b.n_now, p.ln, p.lmed, p.lmad, greatest(1.4826::DOUBLE * p.lmad, b.flr) AS scale, CASE WHEN b.has_now AND b.n_now >= 8 AND p.ln >= 7 THEN (b.u - p.lmed) / greatest(1.4826::DOUBLE * p.lmad, b.flr) END AS z
   FROM base b LEFT JOIN pn p ON p.component_id = b.component_id AND p.parameter_name = b.parameter_name),
peer AS (SELECT *, CASE WHEN NOT has_now THEN 'INSUFFICIENT_PEERS' WHEN n_now < 8 THEN 'PEER_SUPPRESSED_SMALL_LOT' WHEN ln < 7 THEN 'INSUFFICIENT_PEERS' WHEN abs(z) >= 5 THEN 'PEER_EXTREME_OUTLIER' WHEN abs(z) >= 3 THEN 'PEER_MILD_OUTLIER' ELSE 'PEER_NORMAL' END AS peer_status,
   CASE WHEN NOT has_now THEN 'MISSING_OBSERVATION' WHEN n_now < 8 THEN 'PEER_SUPPRESSED_SMALL_LOT' WHEN ln < 7 THEN 'INSUFFICIENT_VALID_PEERS' WHEN abs(z) >= 5 THEN 'EXTREME_PEER_OUTLIER' WHEN abs(z) >= 3 THEN 'MILD_PEER_OUTLIER' ELSE 'PEER_NORMAL' END AS peer_reason FROM pz1),
tprev AS (SELECT lot_id, parameter_name, max(t) AS tp FROM hist WHERE t < {t} GROUP BY 1, 2),
cs AS (SELECT n.lot_id, n.parameter_name, count(*) AS n, median(n.u - q.u) AS med, count(*) FILTER (n.u - q.u > 0) AS np, count(*) FILTER (n.u - q.u < 0) AS nm FROM now0 n JOIN tprev t ON t.lot_id = n.lot_id AND t.parameter_name = n.parameter_name
   JOIN hist q ON q.component_id = n.component_id AND q.parameter_name = n.parameter_name AND q.t = t.tp GROUP BY 1, 2),
ch AS (SELECT lot_id, parameter_name, channel_id, count(*) AS n_in, median(u) AS med_in FROM now0 GROUP BY 1, 2, 3),
cho AS (SELECT c.lot_id, c.parameter_name, c.channel_id, count(n.u) AS n_out, median(n.u) AS med_out FROM ch c LEFT JOIN now0 n ON n.lot_id = c.lot_id AND n.parameter_name = c.parameter_name AND n.channel_id <> c.channel_id GROUP BY 1, 2, 3),
e0 AS (SELECT b.*, CASE WHEN has_now AND cs.n >= 4 THEN cs.med END AS lot_shift, CASE WHEN has_now AND cs.n >= 4 AND abs(cs.med) > 1e-6 THEN (CASE WHEN cs.med > 0 THEN np ELSE nm END)::DOUBLE / cs.n::DOUBLE END AS share, coalesce(ch.n_in, 0) AS n_in, ch.med_in, coalesce(cho.n_out, 0) AS n_out, cho.med_out, ml.med AS lmed0, ml.mad AS lmad0
   FROM base b LEFT JOIN cs ON cs.lot_id = b.lot_id AND cs.parameter_name = b.parameter_name LEFT JOIN ch ON ch.lot_id = b.lot_id AND ch.parameter_name = b.parameter_name AND ch.channel_id = b.channel_id
   LEFT JOIN cho ON cho.lot_id = b.lot_id AND cho.parameter_name = b.parameter_name AND cho.channel_id = b.channel_id LEFT JOIN ml ON ml.lot_id = b.lot_id AND ml.parameter_name = b.parameter_name AND ml.t = {t}),
e1 AS (SELECT *, coalesce(abs(lot_shift) >= 3.0 * flr AND share >= 0.75, false) AS chit, CASE WHEN NOT has_now THEN NULL WHEN n_in < 4 THEN med_in - lmed0 WHEN n_out < 4 THEN NULL ELSE med_in - med_out END AS off,
   CASE WHEN has_now AND n_in >= 4 AND n_out >= 4 THEN (med_in - med_out) / (1.2533141373155::DOUBLE * greatest(1.482602218505602::DOUBLE * lmad0, flr) * sqrt(1.0::DOUBLE / n_in + 1.0::DOUBLE / n_out)) END AS cz FROM e0),
e2 AS (SELECT *, coalesce(abs(cz) >= 3.42, false) AS bhit, greatest(0.0::DOUBLE, coalesce(abs(lot_shift) / flr, 0.0::DOUBLE), CASE WHEN coalesce(abs(cz) >= 3.42, false) THEN abs(cz) ELSE 0.0::DOUBLE END) AS mag FROM e1),
eq AS (SELECT *, chit OR bhit AS suspected, CASE WHEN NOT has_now THEN 'NOMINAL_EQUIPMENT' WHEN chit THEN 'CHAMBER_EXCURSION_SUSPECTED' WHEN bhit THEN 'CHANNEL_BIAS_SUSPECTED' WHEN n_in < 4 OR n_out < 4 THEN 'CHANNEL_BIAS_SUPPRESSED_SMALL_SAMPLE' ELSE 'NOMINAL_EQUIPMENT' END AS eq_status,
   CASE WHEN NOT has_now THEN 'NOT_EVALUATED' WHEN chit THEN 'CHAMBER_SYNCHRONOUS_EXCURSION' WHEN bhit THEN 'ATE_CHANNEL_FIXTURE_BIAS' WHEN n_in < 4 THEN 'CHANNEL_BIAS_SUPPRESSED_SMALL_SAMPLE' WHEN n_out < 4 THEN 'INSUFFICIENT_REFERENCE_POPULATION' ELSE 'NOMINAL_EQUIPMENT_ENVIRONMENT' END AS eq_reason FROM e2),
d0 AS (SELECT e.component_id, e.lot_id, e.parameter_name, e.has_now, e.k, e.tt, e.uu, e.flr, e.suspected, e.lot_size,
   CASE WHEN coalesce(z.ln, m0.n, 0) >= 7 THEN greatest(1.4826::DOUBLE * coalesce(z.lmad, m0.mad), e.flr) WHEN e.lot_size >= 8 AND m0.n >= 7 THEN greatest(1.4826::DOUBLE * m0.mad, e.flr) ELSE e.flr END AS sig,
   CASE WHEN coalesce(s.ln, g.gn, 0) >= 4 THEN coalesce(s.lmed, g.gmed) END AS endmed
   FROM eq e LEFT JOIN pz z ON z.component_id = e.component_id AND z.parameter_name = e.parameter_name LEFT JOIN ml m0 ON m0.lot_id = e.lot_id AND m0.parameter_name = e.parameter_name AND m0.t = 0
   LEFT JOIN sl s ON s.component_id = e.component_id AND s.parameter_name = e.parameter_name AND s.t = {t} LEFT JOIN sg g ON g.lot_id = e.lot_id AND g.parameter_name = e.parameter_name AND g.t = {t}),
ex AS (SELECT d.component_id, d.parameter_name, list((h.u - d.uu[1] - CASE WHEN coalesce(s.ln, g.gn, 0) >= 4 THEN coalesce(s.lmed, g.gmed) ELSE 0.0::DOUBLE END) / d.sig ORDER BY h.t) AS ex
   FROM d0 d JOIN hist h ON h.component_id = d.component_id AND h.parameter_name = d.parameter_name AND h.t > d.tt[1]
   LEFT JOIN sl s ON s.component_id = h.component_id AND s.parameter_name = h.parameter_name AND s.t = h.t LEFT JOIN sg g ON g.lot_id = h.lot_id AND g.parameter_name = h.parameter_name AND g.t = h.t GROUP BY 1, 2),
slp AS (SELECT a.component_id, a.parameter_name, median((b.u - a.u) / (b.t - a.t)) AS slope FROM hist a JOIN hist b ON a.component_id = b.component_id AND a.parameter_name = b.parameter_name AND b.t > a.t GROUP BY 1, 2),
d1 AS (SELECT d.*, (uu[k] - uu[1]) / sig AS g, endmed / sig AS g_lot, coalesce(s.slope, 0.0::DOUBLE) AS slope,
   CASE WHEN k >= 3 THEN (uu[k] - uu[k - 1]) / (tt[k] - tt[k - 1]) - (uu[k - 1] - uu[k - 2]) / (tt[k - 1] - tt[k - 2]) END AS kappa,
   CASE WHEN k >= 2 THEN list_reduce([{{'p': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 'e': 0.0::DOUBLE}}] || [{{'p': 0.0::DOUBLE, 'n': 0.0::DOUBLE, 'e': v}} FOR v IN x.ex], lambda a, b: {{'p': greatest(0.0::DOUBLE, a.p + (b.e - 0.25::DOUBLE)), 'n': greatest(0.0::DOUBLE, a.n + (-b.e - 0.25::DOUBLE)), 'e': b.e}}) END AS cu
   FROM d0 d LEFT JOIN slp s ON s.component_id = d.component_id AND s.parameter_name = d.parameter_name LEFT JOIN ex x ON x.component_id = d.component_id AND x.parameter_name = d.parameter_name),
d2 AS (SELECT *, greatest(cu.p, cu.n) AS cusum FROM d1),
drift AS (SELECT *, coalesce(g - g_lot, g) AS g_excess, has_now AND k >= 3 AND cusum >= 2.0 AS persistent,
   CASE WHEN NOT has_now THEN 'INSUFFICIENT_HISTORY' WHEN k < 2 THEN 'STATIONARY' WHEN abs(g) >= 3.0 AND kappa > 1e-5 AND slope > 0 THEN 'ACCELERATING_DRIFT' WHEN abs(g) >= 2.5 THEN 'SUBTLE_DRIFT' WHEN k >= 3 AND cusum >= 2.0 THEN 'PERSISTENT_DRIFT' WHEN suspected THEN 'TEMPORALLY_CONFOUNDED_BY_EQUIPMENT' ELSE 'STATIONARY' END AS drift_status,
   CASE WHEN NOT has_now THEN 'MISSING_CURRENT_OBSERVATION' WHEN k < 2 THEN 'BASELINE_INITIAL_OBSERVATION' WHEN abs(g) >= 3.0 AND kappa > 1e-5 AND slope > 0 THEN 'ACCELERATING_TEMPORAL_DRIFT' WHEN abs(g) >= 2.5 THEN 'SUBTLE_TEMPORAL_DRIFT' WHEN k >= 3 AND cusum >= 2.0 THEN 'PERSISTENT_TEMPORAL_DRIFT' WHEN suspected THEN 'TEMPORALLY_CONFOUNDED_BY_EQUIPMENT' ELSE 'TEMPORALLY_STATIONARY' END AS drift_reason FROM d2),
jmp AS (SELECT component_id, parameter_name, max(abs(u - pu)) AS d FROM (SELECT *, lag(u) OVER (PARTITION BY component_id, parameter_name ORDER BY t) AS pu FROM hist) GROUP BY 1, 2),
st0 AS (SELECT b.component_id, b.parameter_name, b.has_now, b.k, j.d, j.d / CASE WHEN b.lot_size >= 8 AND {t} > 0 AND m.n >= 7 THEN greatest(1.4826::DOUBLE * m.mad, b.flr) ELSE b.flr END AS j
   FROM base b LEFT JOIN jmp j ON j.component_id = b.component_id AND j.parameter_name = b.parameter_name LEFT JOIN ml m ON m.lot_id = b.lot_id AND m.parameter_name = b.parameter_name AND m.t = b.tt[b.k - 1]),
step AS (SELECT *, CASE WHEN NOT has_now THEN NULL WHEN k < 2 THEN 0.0::DOUBLE ELSE j END AS ratio, CASE WHEN NOT has_now THEN NULL WHEN k < 2 THEN 0.0::DOUBLE ELSE d END AS magnitude,
   CASE WHEN NOT has_now THEN 'INSUFFICIENT_HISTORY' WHEN k < 2 THEN 'NO_STEP' WHEN j >= 4.0 THEN 'ABRUPT_JUMP_ALERT' ELSE 'NO_STEP' END AS step_status,
   CASE WHEN NOT has_now THEN 'MISSING_CURRENT_OBSERVATION' WHEN k < 2 THEN 'NO_PRIOR_CHECKPOINT' WHEN j >= 4.0 THEN 'ABRUPT_STEP_CHANGE' ELSE 'NOMINAL_STEP_INTERVAL' END AS step_reason FROM st0),
suff AS (SELECT component_id, parameter_name, CASE WHEN missing <> '' THEN 'INCOMPLETE_HISTORY' WHEN lot_size < 8 THEN 'SMALL_LOT_RESTRICTION' ELSE 'SUFFICIENT' END AS suff_status, missing = '' AS sufficient,
   CASE WHEN missing <> '' THEN 'MISSING_CHECKPOINTS_' || missing WHEN lot_size < 8 THEN 'SMALL_LOT_PEER_RESTRICTION' ELSE 'DATA_SUFFICIENT_AND_VALID' END AS suff_reason FROM base),
ev AS (SELECT e.as_of_hours, e.component_id, e.lot_id, e.parameter_name, e.ord, e.value, e.suspected, e.eq_status, e.eq_reason, s.spec_status, s.spec_reason, p.peer_status, p.peer_reason, p.z, d.drift_status, d.drift_reason, d.g, d.g_lot, d.g_excess, d.persistent, d.slope, d.cusum, t.step_status, t.step_reason, t.ratio, f.sufficient, f.suff_reason
   FROM eq e JOIN spec s USING (component_id, parameter_name) JOIN peer p USING (component_id, parameter_name) JOIN drift d USING (component_id, parameter_name) JOIN step t USING (component_id, parameter_name) JOIN suff f USING (component_id, parameter_name)),
br AS (SELECT *, CASE WHEN spec_status = 'SPEC_BREACH' THEN 0 WHEN NOT sufficient THEN 1 WHEN suspected AND (coalesce(abs(g_excess) >= 2.5, false) OR persistent) THEN 2 WHEN suspected THEN 3 WHEN drift_status = 'ACCELERATING_DRIFT' THEN 4 WHEN step_status = 'ABRUPT_JUMP_ALERT' THEN 5
   WHEN spec_status = 'SCREENING_MARGIN_BREACH' AND drift_status IN ('SUBTLE_DRIFT', 'PERSISTENT_DRIFT') THEN 6 WHEN drift_status IN ('SUBTLE_DRIFT', 'PERSISTENT_DRIFT') THEN 7 WHEN spec_status = 'SCREENING_MARGIN_BREACH' THEN 8 WHEN peer_status IN ('PEER_MILD_OUTLIER', 'PEER_EXTREME_OUTLIER') THEN 9 ELSE 10 END AS b FROM ev),
pf AS (SELECT *, CASE b WHEN 0 THEN 'FAIL' WHEN 1 THEN 'INSUFFICIENT_DATA' WHEN 2 THEN CASE WHEN drift_status = 'ACCELERATING_DRIFT' OR step_status = 'ABRUPT_JUMP_ALERT' THEN 'FAIL' ELSE 'ALERT' END WHEN 3 THEN 'EQUIPMENT_SUSPECTED' WHEN 4 THEN 'FAIL' WHEN 5 THEN 'FAIL' WHEN 6 THEN 'HOLD' WHEN 10 THEN 'PASS' ELSE 'ALERT' END AS state,
   CASE b WHEN 0 THEN 'SPECIFICATION_FAILURE' WHEN 1 THEN 'INSUFFICIENT_EVIDENCE' WHEN 2 THEN 'COMPONENT_DEGRADATION_CONFOUNDED_BY_EQUIPMENT' WHEN 3 THEN 'EQUIPMENT_ONLY' WHEN 4 THEN 'COMPONENT_DEGRADATION' WHEN 5 THEN 'COMPONENT_DEGRADATION' WHEN 6 THEN 'HOLD_SCREENING_MARGIN' WHEN 7 THEN 'COMPONENT_DEGRADATION' WHEN 8 THEN 'SPECIFICATION_FAILURE' WHEN 9 THEN 'PEER_OUTLIER_STATIONARY' ELSE 'NOMINAL_STABLE' END AS qualifier,
   CASE b WHEN 0 THEN spec_reason WHEN 1 THEN suff_reason WHEN 2 THEN CASE WHEN drift_status IN ('ACCELERATING_DRIFT', 'PERSISTENT_DRIFT') THEN drift_reason WHEN step_status = 'ABRUPT_JUMP_ALERT' THEN step_reason ELSE 'CONFOUNDED_TEMPORAL_DRIFT' END WHEN 3 THEN eq_reason WHEN 4 THEN drift_reason WHEN 5 THEN step_reason
   WHEN 6 THEN 'HOLD_SCREENING_MARGIN_BREACH_WITH_DRIFT' WHEN 7 THEN drift_reason WHEN 8 THEN spec_reason WHEN 9 THEN CASE WHEN drift_status = 'STATIONARY' THEN 'HIGH_BUT_STABLE_PEER_OUTLIER' ELSE peer_reason END ELSE 'NOMINAL_SPEC_AND_STABLE_KINETICS' END AS reason,
   drift_status IN ('SUBTLE_DRIFT', 'ACCELERATING_DRIFT', 'PERSISTENT_DRIFT') OR step_status = 'ABRUPT_JUMP_ALERT' OR b IN (2, 6) AS drifting FROM br)"""
    return ts


def joint_ctes(t: int) -> str:
    """jd: joint distance per component, from all ordered pairs of the lot."""
    p = range(4)
    z = ", ".join(f"(b.x[{i + 1}] - a.m[{i + 1}]) / a.s[{i + 1}] AS z{i}" for i in p)
    r = ", ".join(
        f"0.8::DOUBLE * sum(z{i} * z{j}) / greatest(1, count(*) - 1) + {0.2 if i == j else 0.0}::DOUBLE AS r{i}{j}"
        for i in p for j in range(i + 1)
    )
    out = f""",
jx AS (SELECT n.component_id, n.lot_id, n.parameter_name, CASE WHEN {t} > 0 AND q.u IS NOT NULL THEN n.u - q.u ELSE n.u END AS x, n.flr FROM now0 n LEFT JOIN zero q ON q.component_id = n.component_id AND q.parameter_name = n.parameter_name),
{loo('jl', 'jx', 'lot_id, parameter_name', 'x')},
jv AS (SELECT j.component_id, j.lot_id, list(x ORDER BY p.ord) AS x, list(lmed ORDER BY p.ord) AS m, list(greatest(1.4826::DOUBLE * lmad, flr) ORDER BY p.ord) AS s FROM jl j JOIN par p ON p.parameter_name = j.parameter_name GROUP BY 1, 2 HAVING count(*) = 4),
jn AS (SELECT lot_id, count(DISTINCT component_id) AS n FROM now0 GROUP BY 1 HAVING count(DISTINCT component_id) >= 6),
jz AS (SELECT a.component_id, {z} FROM jv a JOIN jv b ON a.lot_id = b.lot_id AND a.component_id <> b.component_id JOIN jn ON jn.lot_id = a.lot_id),
jr AS (SELECT component_id, {r} FROM jz GROUP BY 1 HAVING count(*) >= 4),
j0 AS (SELECT r.*, a.lot_id, {', '.join(f'(a.x[{i + 1}] - a.m[{i + 1}]) / a.s[{i + 1}] AS z{i}' for i in p)} FROM jr r JOIN jv a ON a.component_id = r.component_id)"""
    prev = "j0"
    step = 1
    for j in p:
        piv = f"r{j}{j}" + "".join(f" - l{j}{k} * l{j}{k} * d{k}" for k in range(j))
        fwd = f"z{j}" + "".join(f" - l{j}{k} * y{k}" for k in range(j))
        out += f",\nj{step} AS (SELECT *, {piv} AS d{j}, {fwd} AS y{j} FROM {prev})"
        prev, step = f"j{step}", step + 1
        below = ", ".join(
            f"(r{i}{j}" + "".join(f" - l{i}{k} * l{j}{k} * d{k}" for k in range(j)) + f") / d{j} AS l{i}{j}" for i in range(j + 1, 4)
        )
        if below:
            out += f",\nj{step} AS (SELECT *, {below} FROM {prev})"
            prev, step = f"j{step}", step + 1
    out += f",\njd AS (SELECT component_id, lot_id, sqrt(greatest(0.0::DOUBLE, {' + '.join(f'y{i} * y{i} / d{i}' for i in p)})) AS d FROM {prev})"
    return out


def component_ctes(t: int) -> str:
    return screen_ctes(t) + joint_ctes(t) + """,
ca AS (SELECT as_of_hours, component_id, lot_id, count(*) FILTER (drifting) AS nd, count(*) FILTER (state = 'FAIL') AS nf, count(*) FILTER (state = 'INSUFFICIENT_DATA') AS ni, count(*) FILTER (state = 'HOLD') AS nh, count(*) FILTER (state = 'ALERT') AS na, count(*) FILTER (state = 'EQUIPMENT_SUSPECTED') AS ne,
  bool_or(qualifier = 'COMPONENT_DEGRADATION_CONFOUNDED_BY_EQUIPMENT') AS conf, string_agg(parameter_name, '_' ORDER BY parameter_name) FILTER (drifting OR state = 'FAIL') AS names,
  arg_min({'q': qualifier, 'r': parameter_name || ':' || reason}, ord) FILTER (state = 'FAIL') AS ff, arg_min({'q': 'INSUFFICIENT_EVIDENCE', 'r': parameter_name || ':' || reason}, ord) FILTER (state = 'INSUFFICIENT_DATA') AS fi,
  arg_min({'q': qualifier, 'r': parameter_name || ':' || reason}, ord) FILTER (state = 'HOLD') AS fh,
  arg_min({'q': qualifier, 'r': parameter_name || ':' || reason}, ord + CASE WHEN qualifier IN ('COMPONENT_DEGRADATION', 'COMPONENT_DEGRADATION_CONFOUNDED_BY_EQUIPMENT') THEN 0 ELSE 10 END) FILTER (state = 'ALERT') AS fa,
  arg_min({'q': 'EQUIPMENT_ONLY', 'r': parameter_name || ':' || reason}, ord) FILTER (state = 'EQUIPMENT_SUSPECTED') AS fe FROM pf GROUP BY 1, 2, 3),
cj AS (SELECT ca.*, jd.d, coalesce(jd.d >= 4.25, false) AS jh FROM ca LEFT JOIN jd ON jd.component_id = ca.component_id),
cf AS (SELECT as_of_hours, component_id, lot_id, d,
  CASE WHEN nd >= 2 OR nf >= 2 THEN 'FAIL' WHEN nf > 0 THEN 'FAIL' WHEN ni > 0 THEN 'INSUFFICIENT_DATA' WHEN nh > 0 THEN 'HOLD' WHEN na > 0 THEN 'ALERT' WHEN ne > 0 THEN 'EQUIPMENT_SUSPECTED' WHEN jh THEN 'HOLD' ELSE 'PASS' END AS state,
  CASE WHEN nd >= 2 OR nf >= 2 THEN CASE WHEN conf THEN 'COMPONENT_DEGRADATION_CONFOUNDED_BY_EQUIPMENT' ELSE 'COMPONENT_DEGRADATION' END WHEN nf > 0 THEN ff.q WHEN ni > 0 THEN fi.q WHEN nh > 0 THEN fh.q WHEN na > 0 THEN fa.q WHEN ne > 0 THEN fe.q WHEN jh THEN 'HOLD_SCREENING_MARGIN' ELSE 'NOMINAL_STABLE' END AS qualifier,
  CASE WHEN nd >= 2 OR nf >= 2 THEN 'COMPOUND_MULTI_PARAMETER_DRIFT_' || names WHEN nf > 0 THEN ff.r WHEN ni > 0 THEN fi.r WHEN nh > 0 THEN fh.r WHEN na > 0 THEN fa.r WHEN ne > 0 THEN fe.r WHEN jh THEN 'JOINT:JOINT_MAHALANOBIS_EXCESS_' || printf('%.2f', d) || '_SIGMA' ELSE 'NOMINAL_SPEC_AND_STABLE_KINETICS' END AS reason,
  CASE WHEN nd >= 2 OR nf >= 2 THEN true WHEN nf + ni + nh + na + ne = 0 THEN jh ELSE nd >= 2 OR nf + nh + na >= 2 OR jh END AS compound FROM cj)"""
