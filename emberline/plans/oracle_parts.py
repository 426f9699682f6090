"""Shared SQL building blocks of the oracle statements (plain ANSI CTEs)."""

HOURS = "CASE WHEN {b} <= 0 THEN 0 WHEN {b} = 1 THEN 24 WHEN {b} = 2 THEN 96 ELSE 168 END"

TEL = f"""cells AS (
  SELECT l_partkey, CAST({HOURS.format(b='b')} AS INTEGER) AS elapsed_hours, count(*) AS n,
         sum(p) AS p, sum(d) AS d, sum(q) AS q, sum(x) AS x
  FROM (SELECT l_partkey, floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 625) AS b,
               CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(round(l_discount * 100) AS BIGINT) AS d,
               CAST(round(l_quantity) AS BIGINT) AS q, CAST(round(l_tax * 100) AS BIGINT) AS x
        FROM lineitem)
  GROUP BY 1, 2),
mean4 AS (
  SELECT 'P' || l_partkey AS component_id, p_brand AS lot_id, 'CH_' || (l_partkey % 8) AS channel_id,
         'ATE_' || (p_size % 2) AS instrument_id, elapsed_hours,
         CAST(p AS DOUBLE) / CAST(n AS DOUBLE) AS mp, CAST(d AS DOUBLE) / CAST(n AS DOUBLE) AS md,
         CAST(q AS DOUBLE) / CAST(n AS DOUBLE) AS mq, CAST(x AS DOUBLE) / CAST(n AS DOUBLE) AS mx
  FROM cells JOIN part ON l_partkey = p_partkey),
tel AS MATERIALIZED (
  SELECT component_id, lot_id, 'IDSS' AS parameter_name, elapsed_hours, mp / 1000000.0::DOUBLE AS value, 'uA' AS unit, instrument_id, channel_id FROM mean4
  UNION ALL SELECT component_id, lot_id, 'VGS(th)', elapsed_hours, 1.95::DOUBLE + md * 0.2::DOUBLE, 'V', instrument_id, channel_id FROM mean4
  UNION ALL SELECT component_id, lot_id, 'RDS(on)', elapsed_hours, 18.25::DOUBLE + mq, 'mOhm', instrument_id, channel_id FROM mean4
  UNION ALL SELECT component_id, lot_id, 'IGSS', elapsed_hours, (mx - 4.0::DOUBLE) * 26.0::DOUBLE + 0.5::DOUBLE, 'nA', instrument_id, channel_id FROM mean4)"""

EVR = f"""evr AS (
  SELECT event_id, ts, 'U' || user_id AS component_id, 'LOT_' || CAST(floor(user_id / 15) AS BIGINT) AS lot_id,
         CASE event_type WHEN 'click' THEN 'IDSS' WHEN 'view' THEN 'VGS(th)' WHEN 'purchase' THEN 'RDS(on)' WHEN 'signup' THEN 'IGSS' ELSE 'ERR' END AS parameter_name,
         CAST({HOURS.format(b='least(3, floor(floor((epoch(ts) - 1704067200) / 3600) / 180))')} AS INTEGER) AS elapsed_hours,
         value,
         CASE event_type WHEN 'click' THEN 'uA' WHEN 'view' THEN 'V' WHEN 'purchase' THEN 'mOhm' WHEN 'signup' THEN 'nA' ELSE '?' END AS unit
  FROM events)"""
EVT = EVR + """,
evt AS (
  SELECT component_id, lot_id, parameter_name, elapsed_hours, unit,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / CAST(count(value) AS DOUBLE) / 100.0::DOUBLE AS value
  FROM evr GROUP BY 1, 2, 3, 4, 5)"""

U = """CASE parameter_name WHEN 'IDSS' THEN CASE WHEN value > 0 THEN ln(value) END
 WHEN 'RDS(on)' THEN CASE WHEN value > 0 THEN ln(value) END WHEN 'IGSS' THEN asinh(value) WHEN 'VGS(th)' THEN value END"""
FLOOR = "CASE parameter_name WHEN 'IDSS' THEN 0.05::DOUBLE WHEN 'VGS(th)' THEN 0.01::DOUBLE WHEN 'RDS(on)' THEN 0.01::DOUBLE WHEN 'IGSS' THEN 0.1::DOUBLE ELSE 0.01::DOUBLE END"
LOW = "CASE parameter_name WHEN 'VGS(th)' THEN 2.0::DOUBLE WHEN 'IGSS' THEN -100.0::DOUBLE END"
HIGH = "CASE parameter_name WHEN 'IDSS' THEN 10.0::DOUBLE WHEN 'VGS(th)' THEN 4.0::DOUBLE WHEN 'RDS(on)' THEN 65.0::DOUBLE WHEN 'IGSS' THEN 100.0::DOUBLE END"
TU = TEL + f""",
tu AS (SELECT *, {U} AS u, {FLOOR} AS flr FROM tel)"""
EXCL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW"


def r6(x: str, d: int = 6) -> str:
    return f"(round({x}, {d}) + 0.0::DOUBLE)"


def inv(u: str) -> str:
    return f"CASE parameter_name WHEN 'IDSS' THEN exp({u}) WHEN 'RDS(on)' THEN exp({u}) WHEN 'IGSS' THEN sinh({u}) WHEN 'VGS(th)' THEN {u} END"


def loo(name: str, src: str, keys: str, x: str = "u") -> str:
    """CTEs <name>0 and <name>: rows of ``src`` + ln, lmed, lmad (leave-one-out by brute force)."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    return f"""{name}0 AS (SELECT *, row_number() OVER () AS rid, count({x}) OVER (PARTITION BY {keys} {EXCL}) AS ln,
  median({x}) OVER (PARTITION BY {keys} {EXCL}) AS lmed FROM {src} WHERE {x} IS NOT NULL),
{name}m AS (SELECT a.rid, median(abs(b.{x} - a.lmed)) AS lmad FROM {name}0 a JOIN {name}0 b ON {on} AND a.rid <> b.rid GROUP BY a.rid),
{name} AS (SELECT a.*, m.lmad FROM {name}0 a LEFT JOIN {name}m m ON a.rid = m.rid)"""


def med_mad(name: str, src: str, keys: str, x: str = "u") -> str:
    """CTE <name>: keys, n, med, mad per group."""
    on = " AND ".join(f"s.{k.strip()} = g.{k.strip()}" for k in keys.split(","))
    gk = ", ".join(f"g.{k.strip()}" for k in keys.split(","))
    return f"""{name}g AS (SELECT {keys}, count({x}) AS n, median({x}) AS med FROM {src} WHERE {x} IS NOT NULL GROUP BY {keys}),
{name} AS (SELECT {gk}, g.n, g.med, median(abs(s.{x} - g.med)) AS mad FROM {name}g g JOIN {src} s ON {on} WHERE s.{x} IS NOT NULL GROUP BY {gk}, g.n, g.med)"""


def erf(x: str) -> str:
    """erf(|x|) as a scalar expression: positive series, 60 terms by list reduction."""
    a = f"abs({x})"
    return (
        f"CASE WHEN {a} > 5 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 1.1283791670955126::DOUBLE * exp(-({a}) * ({a})) * "
        f"list_reduce([{{'t': {a}, 's': {a}, 'n': 0.0::DOUBLE}}] || [{{'t': {a}, 's': {a}, 'n': k::DOUBLE}} FOR k IN range(1, 61)], "
        f"lambda p, q: {{'t': p.t * 2 * ({a}) * ({a}) / (2 * q.n + 1), 's': p.s + p.t * 2 * ({a}) * ({a}) / (2 * q.n + 1), 'n': q.n}}).s) END"
    )


def part(k: int, lot: str = "lot_id") -> str:
    return f"(CAST('0x' || substr(md5({lot}), 1, 8) AS BIGINT) % {k})"


def ridge(name: str, src: str, keys: str, y: str = "u168", lam: str = "1.0::DOUBLE", penal: bool = True) -> str:
    """CTEs <name>e.. and <name>(keys, b0, b1, b2): normal equations of 1, u0, u24 by elimination from the last unknown up."""
    top = f" + {lam}" if penal else ""
    return f"""{name}a AS (SELECT {keys}, count(*){top} AS m00, sum(u0) AS m01, sum(u24) AS m02, sum(u0 * u0) + {lam} AS m11, sum(u0 * u24) AS m12, sum(u24 * u24) + {lam} AS m22, sum({y}) AS g0, sum(u0 * {y}) AS g1, sum(u24 * {y}) AS g2 FROM {src} GROUP BY {keys}),
{name}b AS (SELECT *, m00 - m02 * m02 / m22 AS k00, m01 - m12 * m02 / m22 AS k01, m11 - m12 * m12 / m22 AS k11, g0 - m02 * g2 / m22 AS h0, g1 - m12 * g2 / m22 AS h1 FROM {name}a),
{name}c AS (SELECT *, (h0 - k01 * h1 / k11) / (k00 - k01 * k01 / k11) AS b0 FROM {name}b),
{name}d AS (SELECT *, (h1 - k01 * b0) / k11 AS b1 FROM {name}c),
{name} AS (SELECT *, (g2 - m02 * b0 - m12 * b1) / m22 AS b2 FROM {name}d)"""


def weighed(name: str, src: str, keys: str, y: str = "u168", lam: str = "1.0::DOUBLE") -> str:
    """CTEs <name>s and <name>(keys, b0, b1, b2): ridge of weighted rows (w), the intercept free, from centred sums."""
    p, q, r = f"(s11 - s1 * s1 / n + {lam})", "(s12 - s1 * s2 / n)", f"(s22 - s2 * s2 / n + {lam})"
    v, w = "(s1y - s1 * sy / n)", "(s2y - s2 * sy / n)"
    return f"""{name}s AS MATERIALIZED (SELECT {keys}, sum(w) AS n, sum(w * u0) AS s1, sum(w * u24) AS s2, sum(w * {y}) AS sy, sum(w * u0 * u0) AS s11, sum(w * u0 * u24) AS s12, sum(w * u24 * u24) AS s22, sum(w * u0 * {y}) AS s1y, sum(w * u24 * {y}) AS s2y FROM {src} GROUP BY {keys}),
{name}z AS (SELECT *, ({v} - {q} * {w} / {r}) / ({p} - {q} * {q} / {r}) AS b1 FROM {name}s), {name}y AS (SELECT *, ({w} - {q} * b1) / {r} AS b2 FROM {name}z),
{name} AS MATERIALIZED (SELECT {keys}, (sy - b1 * s1 - b2 * s2) / n AS b0, b1, b2 FROM {name}y)"""


def huber(name: str, src: str, keys: str, rounds: int = 12) -> str:
    """CTEs ending in <name>(keys, b0, b1, b2, done): Huber reweighting unrolled; src holds keys, u0, u24, u168, flr."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    out = [f"{name}r AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS w FROM {src})", weighed(f"{name}q", f"{name}r", keys), f"{name}0 AS MATERIALIZED (SELECT *, false AS done FROM {name}q)"]
    for i in range(1, rounds + 1):
        last, now = f"{name}{i - 1}", "" if i == rounds else i
        out += [
            f"{name}x{i} AS MATERIALIZED (SELECT a.*, u168 - (b0 + b1 * u0 + b2 * u24) AS r FROM {src} a JOIN {last} b ON {on} WHERE NOT done)",
            f"{name}m{i} AS MATERIALIZED (SELECT {keys}, median(r) AS med FROM {name}x{i} GROUP BY {keys})",
            f"{name}d{i} AS MATERIALIZED (SELECT {own}, 1.345::DOUBLE * greatest(1.4826::DOUBLE * median(abs(r - med)), any_value(flr)) AS delta FROM {name}x{i} a JOIN {name}m{i} b ON {on} GROUP BY {own})",
            f"{name}w{i} AS (SELECT a.*, CASE WHEN abs(r) <= delta THEN 1.0::DOUBLE ELSE delta / greatest(abs(r), 1e-12::DOUBLE) END AS w FROM {name}x{i} a JOIN {name}d{i} b ON {on})",
            weighed(f"{name}n{i}", f"{name}w{i}", keys),
            f"{name}{now} AS MATERIALIZED (SELECT {own}, coalesce(b.b0, a.b0) AS b0, coalesce(b.b1, a.b1) AS b1, coalesce(b.b2, a.b2) AS b2, coalesce(greatest(abs(a.b0 - b.b0), abs(a.b1 - b.b1), abs(a.b2 - b.b2)) < 1e-6, true) AS done FROM {last} a LEFT JOIN {name}n{i} b ON {on})",
        ]
    return ",\n".join(out)


def gram(name: str, src: str, key: str, xs: list[str], y: str) -> str:
    """CTEs ending in <name>(key, b0 .. bk): ridge on an intercept (free) and ``xs`` by elimination from the last unknown up."""
    cols, n = ["1", *xs], len(xs) + 1
    first = ", ".join(f"sum({cols[i]} * {cols[j]}){' + 1.0::DOUBLE' if i == j and i else ''} AS a{n}_{i}_{j}" for i in range(n) for j in range(i + 1))
    out = [f"{name}{n} AS (SELECT {key}, {first}, " + ", ".join(f"sum({cols[i]} * {y}) AS g{n}_{i}" for i in range(n)) + f" FROM {src} GROUP BY 1)"]
    for k in range(n - 1, 0, -1):
        f = {i: f"a{k + 1}_{k}_{i} / a{k + 1}_{k}_{k}" for i in range(k)}
        rows = [f"a{k + 1}_{i}_{j} - {f[i]} * a{k + 1}_{k}_{j} AS a{k}_{i}_{j}" for i in range(k) for j in range(i + 1)]
        rows += [f"g{k + 1}_{i} - {f[i]} * g{k + 1}_{k} AS g{k}_{i}" for i in range(k)]
        out.append(f"{name}{k} AS (SELECT *, {', '.join(rows)} FROM {name}{k + 1})")
    before = f"{name}1"
    for k in range(n):
        known = "".join(f" - a{k + 1}_{k}_{j} * b{j}" for j in range(k))
        out.append(f"{name}{'' if k == n - 1 else f'b{k}'} AS (SELECT *, (g{k + 1}_{k}{known}) / a{k + 1}_{k}_{k} AS b{k} FROM {before})")
        before = f"{name}b{k}"
    return ",\n".join(out)
