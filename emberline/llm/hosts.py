"""URL filters: path rules, and trust and distrust propagated over the host link graph; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.tables import cut, joinable, without

# (verdict, host, path) of the standing rules
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING = 0.85
TOLERANCE = 1e-6  # a walk's mass at any host below which it is no longer followed
THRESHOLD = 0.5
STEPS = 4  # links a walk takes between two checkpoints
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)<a\s[^<>]*?href\s*=\s*[\"']?(?:https?:)?//([^/?#\"'\s<>]+)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text, verdict = F.when(fits, rule_host + rule_path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def host_scores(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """(kind, host, own, all): mass that personalised PageRank brings to a host from elsewhere, per kind of edge.

    edges: (kind, src, dst, share), share being the part of src's mass that goes to dst; seeds: (kind, host, seed) of
    every host. Every host restarts with 1 - damping. What starts at a host or passes it becomes its seed's mass (own) to
    the part ``seed`` (0 to 1), so own / all is the part of the mass a host receives that comes from or through seeds,
    whatever the host's size. Restarts of the host itself do not count. The walks are summed length by length until no
    host holds ``tolerance`` or more, which damping brings about.
    """
    zero = F.lit(0.0)
    edges = cut(edges.join(seeds.withColumnRenamed("host", "src"), ["kind", "src"], "left").select("kind", "src", "dst", "share", F.coalesce("seed", zero).alias("seed")))
    state = cut(seeds.select("kind", "host", zero.alias("x"), F.lit(1 - damping).alias("y"), zero.alias("own"), zero.alias("all")))
    mass = F.col("x") + F.col("seed") * (F.col("y") - F.col("x"))
    while True:
        for _ in range(STEPS):
            step = edges.join(state.select("kind", F.col("host").alias("src"), "x", "y").where("y > 0"), ["kind", "src"])
            step = step.select("kind", F.col("dst").alias("host"), (damping * F.col("share") * mass).alias("x"), (damping * F.col("share") * F.col("y")).alias("y"))
            both = step.select("*", F.col("x").alias("own"), F.col("y").alias("all")).unionAll(state.select("kind", "host", zero, zero, "own", "all"))
            state = both.groupBy("kind", "host").agg(*(F.sum(c).alias(c) for c in ("x", "y", "own", "all")))
        state = cut(state)
        most = state.agg(F.max("y")).first()[0]
        if most is None or most < tolerance:
            return state.select("kind", "host", "own", "all")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Adds host, path, rule and verdict (allow or block) to every page.

    A url that a rule fits gets the rule's verdict, the longest rule winning. Hosts with allowed pages are trusted
    seeds and hosts with blocked pages blocked seeds, each by the share of its pages that are. Trust runs along the
    absolute links of the pages' html from host to host, distrust against them. A host's trust (distrust) is the part of
    the mass it receives that comes from or through trusted (blocked) seeds. A host is blocked when its distrust exceeds its trust
    and is at least ``threshold``, however many pages it has; that decides its pages without a rule.

    Links of one host pair are counted once per page and combined per task before the shuffle, so a hot host costs a
    row per task and linked host. Null urls and urls without :// have empty host and path, no rule, and are allowed;
    null html has no link. Repeated pages each count. Equal trust and distrust: allowed. An empty table gives an empty
    result. Extra columns pass through; input columns named like an output column give way.
    """
    pages = without(pages, ["host", "path", "rule", "verdict"])
    url = F.col("url")
    own = pages.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    text, kind = _rule(F.col("host"), F.col("path"), rules)
    own = own.withColumn("rule", text).withColumn("__kind", kind)
    named = own.where("host <> ''")
    hosts = cut(named.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("__kind") == "allow").alias("allow"), F.count_if(F.col("__kind") == "block").alias("block")))
    seeds = hosts.unpivot(["host", "pages"], ["allow", "block"], "kind", "n").select("kind", "host", (F.col("n") / F.col("pages")).alias("seed"))
    linked = named.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), 1), lambda x: F.translate(x, _UPPER, _LOWER)))).alias("dst")).where("src <> dst")
    links = cut(linked.groupBy("src", "dst").agg(F.count("*").alias("n")))
    either = links.select(F.lit("allow").alias("kind"), "src", "dst", "n").unionAll(links.select(F.lit("block"), F.col("dst"), F.col("src"), "n"))
    out_of = either.groupBy("kind", "src").agg(F.sum("n").alias("of"))
    edges = cut(either.join(out_of, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("of")).alias("share")))
    scores = host_scores(edges, seeds)
    part = F.try_divide(F.col("own"), F.col("all"))
    ranked = scores.groupBy("host").agg(F.max(F.when(F.col("kind") == "allow", part)).alias("t"), F.max(F.when(F.col("kind") == "block", part)).alias("d"))
    trust, distrust = (F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("t", "d"))
    bad = ranked.where((distrust > trust) & (distrust >= threshold)).select(F.col("host").alias("__bad"))
    judged = own.join(joinable(bad), F.col("host") == F.col("__bad"), "left")
    verdict = F.coalesce("__kind", F.when(F.col("__bad").isNotNull(), "block"), F.lit("allow"))
    return judged.withColumn("verdict", verdict).drop("__kind", "__bad")


_FITS = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
_KINDS = " ".join(f"WHEN rule = '{h}{p}' THEN '{k}'" for k, h, p in RULES)
_SQL_LINK = LINK.replace("'", "''")
ORACLE = f"""
WITH RECURSIVE split AS (
  SELECT page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), ruled AS (SELECT *, CASE {_FITS} END AS rule FROM split),
own AS (SELECT *, CASE {_KINDS} END AS kind FROM ruled),
host AS (SELECT host, count(*) AS pages, count(*) FILTER (kind = 'allow') AS allow, count(*) FILTER (kind = 'block') AS block FROM own WHERE host <> '' GROUP BY 1),
seed AS (SELECT 'allow' AS kind, host, allow / pages AS seed FROM host UNION ALL SELECT 'block', host, block / pages FROM host),
link AS (
  SELECT src, dst, count(*) AS n FROM (SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{_SQL_LINK}', 1), lambda x: translate(x, '{_UPPER}', '{_LOWER}')))) AS dst FROM own WHERE host <> '')
  WHERE src <> dst GROUP BY 1, 2
), either AS (SELECT 'allow' AS kind, src, dst, n FROM link UNION ALL SELECT 'block', dst, src, n FROM link),
edge AS MATERIALIZED (SELECT e.kind, src, dst, n / sum(n) OVER (PARTITION BY e.kind, src) AS share, coalesce(seed, 0) AS seed FROM either e LEFT JOIN seed s ON s.kind = e.kind AND s.host = e.src),
walk AS (
  SELECT 0 AS length, kind, host, CAST(0 AS DOUBLE) AS x, CAST({1 - DAMPING} AS DOUBLE) AS y FROM seed
  UNION ALL
  SELECT length + 1, kind, host, x, y FROM (
    SELECT length, e.kind, e.dst AS host, sum({DAMPING} * share * (x + seed * (y - x))) AS x, sum({DAMPING} * share * y) AS y
    FROM walk w JOIN edge e ON e.kind = w.kind AND e.src = w.host WHERE length < 120 GROUP BY 1, 2, 3)
), part AS (SELECT kind, host, sum(x) / sum(y) AS part FROM walk WHERE length > 0 GROUP BY 1, 2),
ranked AS (SELECT host, round(coalesce(max(part) FILTER (kind = 'allow'), 0), 6) AS trust, round(coalesce(max(part) FILTER (kind = 'block'), 0), 6) AS distrust FROM part GROUP BY 1),
bad AS (SELECT host FROM ranked WHERE distrust > trust AND distrust >= {THRESHOLD})
SELECT page_id, o.host, path, rule, coalesce(kind, CASE WHEN b.host IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM own o LEFT JOIN bad b ON o.host = b.host
"""
