"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.tables import WORD, cut, is_empty, joinable, without

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = 20
PASSES = 4
NEAR = 0.01
_BITS = 48
_OWN = ["size", "source_size", "target", "copies", "taken"]


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, ...) with each source's target in words; one row per source, sorted in one small task.

    All sizes together are shared by weight, sources taken by code point with null last; a target stops at MAX_COPIES
    times its source. Resharing the excess until none is above is a common level per unit of weight: sources are
    walked from the one that reaches its limit first, and the level is what is left over the weights left.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(every) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    capped = sizes.withColumn("weight", weight).withColumn("cap", MAX_COPIES * F.col("source_size"))
    by_limit = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    walked = capped.select(
        "*",
        F.sum("source_size").over(all_rows).alias("__all"),
        F.coalesce(F.sum("cap").over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__full"),
        F.sum("weight").over(by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("__open"),
        F.row_number().over(by_limit).alias("__at"),
    ).withColumn("__level", (F.col("__all") - F.col("__full")) / F.col("__open"))
    level = F.min(F.when(F.col("__level") * F.col("weight") <= F.col("cap"), F.struct("__at", "__level"))).over(all_rows)["__level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(level, F.lit(0.0)) * F.col("weight"))
    return walked.withColumn("target", target).drop("__all", "__full", "__open", "__at", "__level", "cap", "weight")


def _class(size: Column) -> Column:
    """Length class 0..16: binary digits of the size."""
    return F.least(F.length(F.bin(size)), F.lit(16))


def _boundary(rows: DataFrame, part: Column) -> DataFrame:
    """Per source the bin in which the running words reach ``need``, or its last bin: (source, bin, before)."""
    bins = rows.groupBy("source", part.alias("bin")).agg(F.sum("size").alias("words"), F.first("need").alias("need"), F.first("before").alias("base"))
    run = bins.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("source").orderBy("bin")))
    place = F.struct("bin", (F.col("upto") - F.col("words")).alias("before"))
    found = run.groupBy("source").agg(F.coalesce(F.min(F.when(F.col("upto") >= F.col("need"), place)), F.max(place)).alias("b"))
    return joinable(found.select("source", "b.bin", "b.before"))


def _prefix(rows: DataFrame) -> DataFrame:
    """(source, hi, words): the longest run of rows (source, size, need, __rank) in rank order whose words fit ``need``.

    Two histograms of 4096 bins over the rank find the bin in 16 million where the run ends; only that one is sorted.
    """
    rows = rows.withColumn("before", F.lit(0).cast("long"))
    for shift in (36, 24):
        bin_ = F.shiftright("__rank", shift)
        rows = rows.drop("bin").join(_boundary(rows, bin_).withColumnRenamed("before", "below"), "source").where(bin_ == F.col("bin")).drop("before").withColumnRenamed("below", "before")
    ranks = rows.groupBy("source", "bin", "need", "before", "__rank").agg(F.sum("size").alias("words"))
    upto = ranks.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source").orderBy("__rank")))
    fits = F.col("upto") <= F.col("need")
    ends = F.coalesce(F.max(F.when(fits, F.col("__rank"))), F.shiftleft(F.first("bin"), 24) - 1)
    return upto.groupBy("source").agg(ends.alias("hi"), F.coalesce(F.max(F.when(fits, F.col("upto"))), F.first("before")).alias("words"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Adds size (words), source_size, target (words of its source), copies and taken (= copies * size) to every row.

    A source with rate r = target / source_size gives a document r + (w - mean w) * min(r, 3 - r) expected copies:
    w is its length class over 16 and mean w the word-weighted mean of its source, so longer documents are preferred
    and the expected words are the target exactly. The whole part is allocated for certain. The fraction p is an
    inclusion probability: documents are ranked by the odds of a random number over the odds of p, and the best
    ranked are taken while the source's words stay within the target. Where a document too large for the rest ends
    that more than NEAR short of the target, ranking goes on among the later ones that fit, PASSES times at most. The
    sample is closed by the one later document whose size comes nearest to the words still missing, if it brings them
    nearer. Random numbers are hashes of seed, doc_id and text, so reruns agree, and rows alike in both are taken alike.

    No source is sorted or meets in one task: see ``_prefix``.

    A null or word-less text has size 0 and no copy; a null source is a source, the last one; null ids are hashed as
    such. Equal ranks are taken together. An empty table gives an empty result. Extra columns pass through; input
    columns named like an output column give way.
    """
    docs = without(docs, _OWN)
    own = docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    mark = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit("-")))
    own = own.withColumn("__h", F.conv(F.substring(F.md5(mark), 1, 12), 16, 10).cast("long"))
    narrow = cut(own.select("source", "size", "__h"))
    sums = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * _class(F.col("size"))).alias("__classed"))
    plan = joinable(source_targets(sums))
    found = narrow.withColumnRenamed("source", "__s").join(plan, F.col("__s").eqNullSafe(F.col("source"))).where("size > 0").select("source", "size", "target", *_expected())
    certain = found.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("__whole")).alias("words"))
    # sources are numbered from here on, so that null needs no care
    named = joinable(plan.join(certain.select(F.col("source").alias("__s"), "words"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "source_size", "target", "__classed", (F.col("target") - F.coalesce("words", F.lit(0))).alias("need"), F.monotonically_increasing_id().alias("sid")))
    drawn = cut(found.where("__p > 0").join(named.select(F.col("source").alias("__s"), "need", "sid"), F.col("source").eqNullSafe(F.col("__s"))).select(F.col("sid").alias("source"), "size", "need", "__rank"))
    state = named.select(F.col("sid").alias("source"), F.col("need").alias("gap"), (NEAR * F.col("target")).alias("goal"), F.lit(-1).cast("long").alias("lo"), F.expr("array() :: array<struct<lo: bigint, hi: bigint, cap: double>>").alias("passes"))
    for _ in range(PASSES):
        open_ = state.where("gap > goal")
        if is_empty(open_):
            break
        fitting = drawn.join(open_, "source").where("__rank > lo and size <= gap").select("source", "size", "__rank", F.col("gap").alias("need"))
        done = _prefix(fitting)
        taken = F.struct("lo", "hi", F.col("gap").alias("cap"))
        state = joinable(state.join(done, "source", "left").select("source", (F.col("gap") - F.coalesce("words", F.lit(0))).alias("gap"), "goal", F.coalesce("hi", "lo").alias("lo"), F.when(F.col("hi").isNotNull(), F.concat("passes", F.array(taken))).otherwise(F.col("passes")).alias("passes")))
    miss = F.abs(F.col("size") - F.col("gap"))
    closing = drawn.join(state, "source").where((F.col("__rank") > F.col("lo")) & (miss < F.col("gap"))).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), F.col("__rank").alias("one"))).alias("c"))
    chosen = state.join(closing, "source", "left").select(F.col("source").alias("sid"), "passes", F.coalesce("c.one", F.lit(-1)).alias("__one"))
    final = joinable(named.join(chosen, "sid").select(F.col("source").alias("__s"), "source_size", "target", "__classed", F.col("passes").alias("__passes"), "__one"))
    whole, p, rank = _expected()
    out = own.join(final, F.col("source").eqNullSafe(F.col("__s"))).withColumns({"__whole": whole, "__p": p}).withColumn("__rank", rank)
    in_pass = F.exists("__passes", lambda x: (F.col("__rank") > x["lo"]) & (F.col("__rank") <= x["hi"]) & (F.col("size") <= x["cap"]))
    extra = ((F.col("__p") > 0) & (in_pass | (F.col("__rank") == F.col("__one")))).cast("long")
    copies = F.when(F.col("size") > 0, F.col("__whole") + extra).otherwise(0).cast("long")
    return out.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).drop("__h", "__s", "__classed", "__passes", "__one", "__whole", "__p", "__rank")


def _expected() -> tuple[Column, Column, Column]:
    """Whole copies, inclusion probability of one more, and the Pareto rank as an integer of 48 bits."""
    size, rate = F.col("size"), F.try_divide(F.col("target"), F.col("source_size").cast("double"))
    preference = (_class(size) - F.try_divide(F.col("__classed").cast("double"), F.col("source_size").cast("double"))) / 16
    expected = F.coalesce(rate + preference * F.least(rate, MAX_COPIES - rate), F.lit(0.0))
    whole = F.floor(expected)
    p = expected - whole
    u = (F.col("__h") + 0.5) / float(1 << _BITS)
    odds = F.try_divide(u / (1 - u), F.try_divide(p, 1 - p))
    rank = F.when(p > 0, F.floor(odds / (1 + odds) * float(1 << _BITS)))
    return whole.alias("__whole"), p.alias("__p"), rank.alias("__rank")


_PASS_SQL = "".join(
    f""",
e{k} AS (
  SELECT r.source, rank, sum(sum(size)) OVER (PARTITION BY r.source ORDER BY rank) AS upto FROM ranked r JOIN st{k - 1} s ON r.source IS NOT DISTINCT FROM s.source
  WHERE p > 0 AND size > 0 AND gap > goal AND rank > lo AND size <= gap GROUP BY r.source, rank
), h{k} AS (SELECT e.source, max(rank) AS hi, max(upto) AS words FROM e{k} e JOIN st{k - 1} s ON e.source IS NOT DISTINCT FROM s.source WHERE upto <= gap GROUP BY 1),
st{k} AS (SELECT s.source, gap - coalesce(words, 0) AS gap, goal, coalesce(hi, lo) AS lo FROM st{k - 1} s LEFT JOIN h{k} h ON s.source IS NOT DISTINCT FROM h.source)"""
    for k in range(1, PASSES + 1)
)
_TAKEN_SQL = " OR ".join(f"(rank > st{k - 1}.lo AND rank <= st{k}.lo AND size <= st{k - 1}.gap)" for k in range(1, PASSES + 1))
_JOIN_SQL = " ".join(f"JOIN st{k} ON r.source IS NOT DISTINCT FROM st{k}.source" for k in range(PASSES + 1))
ORACLE = f"""
WITH own AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(md5(text), '-')), 1, 12) AS BIGINT) AS h
  FROM documents
), sums AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * least(length(bin(size)), 16)) AS BIGINT) AS classed FROM own GROUP BY 1
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {MAX_COPIES} * source_size AS cap FROM sums
), walked AS (
  SELECT *, row_number() OVER by_limit AS pos, (sum(source_size) OVER () - coalesce(sum(cap) OVER (by_limit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (by_limit ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW by_limit AS (ORDER BY cap / weight, source NULLS LAST)
), goal AS (
  SELECT source, source_size, classed, least(CAST(cap AS DOUBLE), weight * coalesce((SELECT level FROM walked WHERE level * weight <= cap ORDER BY pos LIMIT 1), 0.0)) AS target FROM walked
), expected AS (
  SELECT o.*, g.source_size, g.target, coalesce(g.target / nullif(g.source_size, 0)
    + (least(length(bin(o.size)), 16) - CAST(g.classed AS DOUBLE) / nullif(g.source_size, 0)) / 16 * least(g.target / nullif(g.source_size, 0), {MAX_COPIES} - g.target / nullif(g.source_size, 0)), 0.0) AS e
  FROM own o JOIN goal g ON o.source IS NOT DISTINCT FROM g.source
), parts AS (
  SELECT *, CASE WHEN size > 0 THEN CAST(floor(e) AS BIGINT) ELSE 0 END AS whole, e - floor(e) AS p, (h + 0.5) / 281474976710656.0 AS u FROM expected
), ranked AS (
  SELECT *, CASE WHEN p > 0 THEN CAST(floor((u / (1 - u)) / (p / (1 - p)) / (1 + (u / (1 - u)) / (p / (1 - p))) * 281474976710656.0) AS BIGINT) END AS rank,
    target - sum(whole * size) OVER (PARTITION BY source) AS need FROM parts
), st0 AS (SELECT source, any_value(need) AS gap, {NEAR} * any_value(target) AS goal, -1 AS lo FROM ranked GROUP BY 1){_PASS_SQL},
closing AS (
  SELECT f.source, arg_min(rank, struct_pack(o := abs(size - gap), r := rank)) AS one FROM ranked r JOIN st{PASSES} f ON r.source IS NOT DISTINCT FROM f.source
  WHERE p > 0 AND size > 0 AND rank > lo AND abs(size - gap) < gap GROUP BY f.source
)
SELECT doc_id, size, source_size, target, (whole + CASE WHEN size > 0 AND p > 0 AND ({_TAKEN_SQL} OR rank = coalesce(one, -1)) THEN 1 ELSE 0 END) * size AS taken
FROM ranked r {_JOIN_SQL} LEFT JOIN closing e ON r.source IS NOT DISTINCT FROM e.source
"""
