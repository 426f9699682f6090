"""Exact order statistics per group, without ever holding a large group in one task.

A group, or the interval of a group that holds a wanted rank, is sorted as an array inside
one aggregation once it has at most ``AT_ONCE`` rows.  What is larger is narrowed first:

1. values become integers that order as the values do, so an interval is two integers;
2. a round counts the rows of every open interval in equal steps - as many as its counted
   size asks for - with a map-side combined aggregate, and each wanted rank moves to the
   step that holds it, closed up to the least and largest value found there;
3. rounds end when every interval is small enough or holds one value only.

Equal values of a group are one entry with their number before any of this, unless the caller
knows that all groups are small: what is sorted, written and narrowed are distinct values.

A round divides an interval's span by 16 at least, so there are 16 rounds at most whatever
the values are, and one or two for what instruments measure.  Where every row's place is
needed (ranks of many labels, empirical p-values) rows are dealt by ranges and places come
from prefix counts over the ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.session import cut

AT_ONCE = 25_000
CELLS = 32  # of an octave, in the first count
STEPS = (16, 4096)  # least and most steps of an interval in one round
BROADCAST_ROWS = 20_000


def group_limit(df: DataFrame) -> int:
    """Rows that one aggregation may sort; the results do not depend on it."""
    return int(df.sparkSession.conf.get("emberline.group.limit", str(AT_ONCE)))


def has_large_groups(df: DataFrame, keys: Sequence[str]) -> bool:
    """Probe: is any group larger than the limit?  One combined count, one row back."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return not sizes.where(F.col("__n") > group_limit(df)).limit(1).isEmpty()


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a *materialised* side only when a bounded count proves it small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_by_size(df: DataFrame, keys: Sequence[str], skewed: bool | None):
    """(bounded rows, rows of large groups or None, their keys and sizes or None).

    Unless the caller knows the sizes, the rows are written once, so that counting them does not run their plan twice.
    """
    if skewed is None:
        df = cut(df)
        skewed = has_large_groups(df, keys)
    if not skewed:
        return df, None, None
    large = cut(
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > group_limit(df))
    )
    side = broadcast_if_small(large.select(*keys))
    return join_on(df, side, keys, "left_anti"), join_on(df, side, keys, "left_semi"), large


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on group keys; plain equality keeps an existing partitioning usable."""
    return left.join(right, list(keys), how)


def counted(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """keys, __v, __w: the distinct non-null values of every group and how often each occurs."""
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"), (F.lit(1).cast("bigint") if weight is None else F.col(weight)).alias("__w"))
    return rows.where(F.col("__v").isNotNull()).groupBy(*keys, "__v").agg(F.sum("__w").alias("__w"))


def entries_of(entries: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """keys, n, __x and ``more`` aggregates: ordered ARRAY<STRUCT<v, w>> of the entries of every group."""
    return entries.groupBy(*keys).agg(
        F.sum("__w").alias("n"), *more, F.sort_array(F.collect_list(F.struct(F.col("__v").alias("v"), F.col("__w").alias("w")))).alias("__x")
    )


def at_rank(xs: Column, r: Column) -> Column:
    """Value at 1-based rank ``r`` of an ordered array of entries; NULL where there is none."""
    start = F.struct(r.cast("bigint").alias("left"), F.lit(None).cast("double").alias("v"))

    def step(a: Column, x: Column) -> Column:
        found = F.struct(F.lit(0).cast("bigint").alias("left"), x["v"].alias("v"))
        return F.when(a["left"] < 1, a).when(a["left"] <= x["w"], found).otherwise(F.struct((a["left"] - x["w"]).alias("left"), a["v"].alias("v")))

    return F.aggregate(xs, start, step, lambda a: a["v"])


def middle_of(xs: Column, n: Column, before: Column | None = None) -> Column:
    """The values at ``middle_ranks(n)`` of an ordered array of entries, in one pass; ``before``: rows that precede it."""
    r, none = F.floor(n / 2).cast("bigint"), F.lit(None).cast("double")
    start = F.struct((F.lit(0) if before is None else before).cast("bigint").alias("s"), none.alias("a"), none.alias("b"), none.alias("c"))

    def step(t: Column, x: Column) -> Column:
        upto = t["s"] + x["w"]
        return F.struct(upto.alias("s"), *[F.when((t["s"] < r + i) & (upto >= r + i), x["v"]).otherwise(t[c]).alias(c) for i, c in enumerate("abc")])

    return F.aggregate(xs, start, step, lambda t: F.array(t["a"], t["b"], t["c"]))


def order_key(value: Column) -> Column:
    """63-bit integer that orders as the double does; neighbouring doubles may share one."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value.cast("double") + F.lit(0.0)).cast("bigint")
    return F.shiftright(F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits), 1)


def _inside(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that lie in an interval of their group; intervals of a group do not overlap."""
    both = join_on(rows, broadcast_if_small(cells), keys, "inner")
    return both.where((F.col("__k") >= F.col("__lo")) & (F.col("__k") <= F.col("__hi")))


def _narrowed(rows: DataFrame, keys: list[str], ranks: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(keys, n) and (keys, __pos, __r, __lo, __hi, __c): the interval of every wanted rank, its rank and the entries in there."""
    sizes = cut(rows.groupBy(*keys).agg(F.sum("__w").alias("__n"), F.count(F.lit(1)).alias("__c"), F.min("__k").alias("__lo"), F.max("__k").alias("__hi")))
    spans = sizes.select(*keys, F.posexplode(ranks(F.col("__n"))).alias("__pos", "__r"), "__lo", "__hi", "__c", "__n")
    spans = cut(spans.where((F.col("__r") >= 1) & (F.col("__r") <= F.col("__n"))).drop("__n"))
    limit = group_limit(rows)
    is_open = (F.col("__c") > limit) & (F.col("__lo") < F.col("__hi"))
    columns = [*keys, "__pos", "__r", "__lo", "__hi", "__c"]
    while not spans.where(is_open).isEmpty():
        steps = F.greatest(F.lit(STEPS[0]), F.least(F.lit(STEPS[1]), F.ceil(F.col("__c") * 4 / limit)))
        cells = spans.where(is_open).select(*keys, "__lo", "__hi", F.ceil((F.col("__hi") - F.col("__lo") + 1) / steps).cast("bigint").alias("__width")).distinct()
        found = _inside(rows, cut(cells), keys).withColumn("__b", F.expr("(__k - __lo) div __width"))
        counts = found.groupBy(*keys, "__lo", "__b").agg(F.sum("__w").alias("__m"), F.count(F.lit(1)).alias("__d"), F.min("__k").alias("__min"), F.max("__k").alias("__max"))
        upto = Window.partitionBy(*keys, "__lo").orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("__to", F.sum("__m").over(upto))
        inside = (F.col("__r") <= F.col("__to")) & (F.col("__r") > F.col("__to") - F.col("__m"))
        moved = join_on(spans.where(is_open), counts, [*keys, "__lo"], "inner").where(inside)
        moved = moved.select(*keys, "__pos", (F.col("__r") - F.col("__to") + F.col("__m")).alias("__r"), F.col("__min").alias("__lo"), F.col("__max").alias("__hi"), F.col("__d").alias("__c"))
        spans = cut(spans.where(~is_open).select(*columns).unionByName(moved.select(*columns)))
    return sizes.select(*keys, F.col("__n").alias("n")), spans


def _pick_large(entries: DataFrame, keys: Sequence[str], ranks: Callable[[Column], Column]) -> DataFrame:
    keys = list(keys)
    rows = cut(entries.select(*keys, "__v", "__w", order_key(F.col("__v")).alias("__k")))
    sizes, spans = _narrowed(rows, keys, ranks)
    held = _inside(rows, spans.select(*keys, "__lo", "__hi").distinct(), keys).groupBy(*keys, "__lo").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__v").alias("v"), F.col("__w").alias("w")))).alias("__xs")
    )
    got = join_on(spans, held, [*keys, "__lo"], "inner").select(*keys, "__pos", at_rank(F.col("__xs"), F.col("__r")).alias("__v"))
    got = got.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__pos", "__v"))).alias("__m"))
    out = join_on(sizes, got, keys, "left")
    picks = F.transform(
        F.sequence(F.lit(0), F.size(ranks(F.col("n"))) - 1),
        lambda i: F.try_element_at(F.coalesce(F.col("__m"), F.create_map().cast("map<int,double>")), i.cast("int")),
    )
    return out.select(*keys, F.col("n").cast("bigint").alias("n"), picks.alias("picks"))


def value_cells(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, __b, __m, __min, __max: the rows of every group counted in cells that order as the values do.

    An octave of either sign is ``CELLS`` cells, so there are some hundred of them for what instruments measure and
    never more than 80,000 to a sign; zero is a cell of its own, and so are NaN (last) and the infinities.
    """
    v = F.col("__v")
    size = F.floor(F.least(F.log2(F.abs(v)), F.lit(1025.0)) * CELLS) + CELLS * 1080
    cell = F.when(F.isnan(v), F.lit(CELLS * 2200).cast("bigint")).when(v == 0, F.lit(0).cast("bigint")).when(v > 0, size).otherwise(-size)
    return rows.groupBy(*keys, cell.alias("__b")).agg(F.count(F.lit(1)).alias("__m"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))


def _held_by(cells: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The wanted ranks (__r of __n) moved to the cells of ``keys`` that hold them."""
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    there = cells.withColumn("__upto", F.sum("__m").over(upto))
    inside = (F.col("__r") <= F.col("__upto")) & (F.col("__r") > F.col("__upto") - F.col("__m"))
    return join_on(spans, there, keys, "inner").where(inside)


def pick_middle(rows: DataFrame, cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, mid: the values at ``middle_ranks`` of large groups, from rows (keys, __v) that are read a few times.

    ``cells`` are the ``value_cells`` of the rows. Where the cell of a rank holds too many rows it is divided into equal
    steps; least and greatest value fall into different ones, and a cell spans 1/32 octave, so 12 rounds are the most.
    """
    keys = list(keys)
    limit = group_limit(rows)
    sizes = cells.groupBy(*keys).agg(F.sum("__m").alias("n"))
    sizes = cut(sizes)
    wanted = sizes.select(*keys, F.posexplode(middle_ranks(F.col("n"))).alias("__pos", "__r"), "n").where("__r >= 1 AND __r <= n")

    def moved(there: DataFrame) -> DataFrame:
        return there.select(*keys, "__pos", (F.col("__r") - F.col("__upto") + F.col("__m")).alias("__r"), F.col("__min").alias("__lo"), F.col("__max").alias("__hi"), F.col("__m").alias("__c"))

    spans = cut(moved(_held_by(cells, wanted.drop("n"), keys)))
    is_open = (F.col("__c") > limit) & (F.col("__lo") < F.col("__hi"))
    inside = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    while not spans.where(is_open).isEmpty():
        steps = F.greatest(F.lit(STEPS[0]), F.least(F.lit(STEPS[1]), F.ceil(F.col("__c") * 4 / limit)))
        todo = cut(spans.where(is_open).select(*keys, "__lo", "__hi", steps.alias("__steps")).distinct())
        step = F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.col("__steps"))
        found = join_on(rows, broadcast_if_small(todo), keys, "inner").where(inside)
        found = found.groupBy(*keys, "__lo", step.alias("__b")).agg(F.count(F.lit(1)).alias("__m"), F.min("__v").alias("__min"), F.max("__v").alias("__max"))
        there = _held_by(found, spans.where(is_open).drop("__c", "__hi"), [*keys, "__lo"]).drop("__lo")
        spans = cut(spans.where(~is_open).unionByName(moved(there)))
    held = join_on(rows, broadcast_if_small(spans.select(*keys, "__lo", "__hi").distinct()), keys, "inner").where(inside)
    held = counted(held, [*keys, "__lo"], "__v").groupBy(*keys, "__lo").agg(
        F.sort_array(F.collect_list(F.struct(F.col("__v").alias("v"), F.col("__w").alias("w")))).alias("__xs")
    )
    got = join_on(spans, held, [*keys, "__lo"], "inner").select(*keys, "__pos", at_rank(F.col("__xs"), F.col("__r")).alias("__v"))
    at = [F.max(F.when(F.col("__pos") == i, F.col("__v"))) for i in range(3)]
    return join_on(sizes, got.groupBy(*keys).agg(F.array(*at).alias("mid")), keys, "inner")


def pick_ranks(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    ranks: Callable[[Column], Column],
    skewed: bool | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Values at the 1-based ``ranks(n)`` of every group -> keys, n, picks ARRAY<DOUBLE>; ``weight`` repeats a row."""
    if skewed is False and weight is None:
        xs = df.select(*keys, value).where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("__x"))
        n = F.size("__x").cast("bigint")
        return xs.select(
            *keys,
            n.alias("n"),
            F.transform(ranks(n), lambda r: F.get(F.col("__x"), (r - 1).cast("int"))).alias("picks"),
        )
    small, large, _ = split_by_size(counted(df, keys, value, weight), keys, None)
    out = entries_of(small, keys).select(*keys, "n", F.transform(ranks(F.col("n")), lambda r: at_rank(F.col("__x"), r)).alias("picks"))
    return out if large is None else out.unionByName(_pick_large(large, keys, ranks))


def middle_ranks(n: Column) -> Column:
    """The three ranks around the middle: enough for the median and every leave-one-out median."""
    a = F.floor(n / 2).cast("bigint")
    return F.array(a, a + 1, a + 2)


def median_of_middle(n: Column, mid: Column) -> Column:
    return F.when(n % 2 == 1, mid[1]).when(n > 0, (mid[0] + mid[1]) / 2.0)


def group_median(df, keys, value, name: str = "median", skewed: bool | None = None, weight: str | None = None) -> DataFrame:
    """keys, n, <name>: exact median of the non-null values of every group."""
    got = pick_ranks(df, keys, value, middle_ranks, skewed, weight)
    return got.select(*keys, "n", median_of_middle(F.col("n"), F.col("picks")).alias(name))


def group_median_mad(df, keys, value, skewed: bool | None = None) -> DataFrame:
    """keys, n, median, mad (median absolute deviation about the group median)."""
    keys = list(keys)
    if skewed is False:
        xs = df.select(*keys, value).where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("__x"))
        xs = xs.withColumn("n", F.size("__x").cast("bigint"))
        h, lo = F.floor(F.col("n") / 2).cast("int"), F.floor((F.col("n") - 1) / 2).cast("int")
        xs = xs.withColumn("median", (F.get("__x", lo) + F.get("__x", h)) / 2.0)
        xs = xs.withColumn("__d", F.sort_array(F.transform("__x", lambda x: F.abs(x - F.col("median")))))
        return xs.select(*keys, "n", "median", ((F.get("__d", lo) + F.get("__d", h)) / 2.0).alias("mad"))
    entries = cut(counted(df, keys, value))
    med = cut(group_median(entries, keys, "__v", "median", weight="__w"))
    dev = join_on(entries, broadcast_if_small(med), keys, "inner").select(*keys, F.abs(F.col("__v") - F.col("median")).alias("__d"), "__w")
    mad = group_median(dev, keys, "__d", "mad", weight="__w").drop("n")
    return join_on(med, mad, keys, "inner").select(*keys, "n", "median", "mad")


def group_quantiles(df, keys, value, probs: Sequence[float], skewed: bool | None = None) -> DataFrame:
    """keys, n, q ARRAY<DOUBLE>: exact linearly interpolated quantiles at ``probs``."""

    def ranks(n: Column) -> Column:
        out = []
        for p in probs:
            pos = F.lit(float(p)) * (n - 1)
            out += [F.floor(pos).cast("bigint") + 1, F.ceil(pos).cast("bigint") + 1]
        return F.array(*out)

    got = pick_ranks(df, keys, value, ranks, skewed)
    n, picks = F.col("n"), F.col("picks")
    vals = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (n - 1)
        vals.append(picks[2 * i] + (picks[2 * i + 1] - picks[2 * i]) * (pos - F.floor(pos)))
    return got.select(*keys, "n", F.array(*vals).alias("q"))


def leave_label_out_median(df, keys, label, value, skewed: bool | None = None) -> DataFrame:
    """keys, label, n_in, med_in, n_out, med_out.

    ``med_out`` is the median of the group's members that do *not* carry the label
    (members without a label count as "other" for every label).

    Only a label's own rows are looked at: with the i-th of them at place p of the whole group,
    the r-th row without the label stands at place r + #{i: p - i < r}.
    """
    keys = list(keys)
    rows = df.select(*keys, label, value).where(F.col(value).isNotNull())
    if skewed is None:
        rows = cut(rows)
        skewed = has_large_groups(rows, keys)
    if skewed:
        return _leave_label_out_large(rows, keys, label, value)
    arr = rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(value).alias("v"), F.col(label).alias("l")))).alias("__x")
    )
    each = arr.select(*keys, F.posexplode("__x").alias("__p", "__s")).select(*keys, F.col("__s.l").alias(label), (F.col("__p") + 1).cast("bigint").alias("__p"))
    own = each.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.sort_array(F.collect_list("__p")).alias("__ps"))
    both = join_on(own, arr, keys, "inner").withColumns({"n_in": F.size("__ps").cast("bigint"), "n_out": (F.size("__x") - F.size("__ps")).cast("bigint")})

    def place_in(r: Column) -> Column:
        return F.get(F.col("__ps"), (r - 1).cast("int"))

    def place_out(r: Column) -> Column:
        before = F.filter("__ps", lambda p, i: p - (i + 1) < r)
        return r + F.size(before)

    def med(n: Column, place) -> Column:
        a, b = ((F.get("__x", (place(r) - 1).cast("int")))["v"] for r in middle_pair(n))
        return F.when(n > 0, (a + b) / 2.0)

    return both.select(
        *keys, label, "n_in", med(F.col("n_in"), place_in).alias("med_in"), "n_out", med(F.col("n_out"), place_out).alias("med_out")
    )


def middle_pair(n: Column) -> tuple[Column, Column]:
    """The two ranks whose mean is the median (twice the same for odd sizes)."""
    return F.floor((n + 1) / 2).cast("bigint"), F.floor(n / 2).cast("bigint") + 1


def placed(rows: DataFrame, by: Sequence[tuple[str, Sequence[str]]], order: Sequence[Column]) -> DataFrame:
    """Adds for every (name, keys) the last place of an entry's ``__w`` rows among those of equal keys in ``order``.

    Entries are dealt by ranges of (first keys, order), told by ``__range``, so a group of any size is spread; a place is
    the running sum of ``__w`` in its range plus the rows of earlier ranges, which are counted per range.
    """
    first = by[0][1]
    out = cut(rows.repartitionByRange(*first, *order).withColumn("__range", F.spark_partition_id()))
    for name, keys in by:
        upto = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        here = out.withColumn(name, F.sum("__w").over(upto))
        earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        counts = out.groupBy("__range", *keys).agg(F.sum("__w").alias("__m"))
        counts = cut(counts.select("__range", *keys, F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__before")))
        out = join_on(here, broadcast_if_small(counts), ["__range", *keys], "inner").withColumn(name, F.col(name) + F.col("__before")).drop("__before")
    return out


def _leave_label_out_large(rows, keys, label, value) -> DataFrame:
    rows = rows.withColumns({"__l": F.coalesce(F.col(label).cast("string"), F.lit("")), "__known": F.col(label).isNotNull()})
    rows = counted(rows, [*keys, "__known", "__l", label], value)
    order = [F.col("__v"), F.col("__known"), F.col("__l")]
    ranked = cut(placed(rows, [("__p", keys), ("__i", [*keys, "__known", "__l"])], order))
    sizes = ranked.groupBy(*keys).agg(F.sum("__w").alias("__n"))
    cells = ranked.where("__known").groupBy(*keys, label).agg(F.sum("__w").alias("n_in"))
    cells = cut(join_on(cells, sizes, keys, "inner").withColumn("n_out", F.col("__n") - F.col("n_in")).drop("__n"))
    own = join_on(ranked.where("__known").select(*keys, label, "__p", "__i", "__v", "__w"), broadcast_if_small(cells), [*keys, label], "inner")
    low, high = middle_pair(F.col("n_out"))
    shift = F.col("__p") - F.col("__i")  # the same for all rows of an entry
    in_low, in_high = middle_pair(F.col("n_in"))

    def before(r: Column) -> Column:
        return F.coalesce(F.sum(F.when(shift < r, F.col("__w"))), F.lit(0))

    def holds(r: Column) -> Column:
        return F.min(F.when((F.col("__i") >= r) & (F.col("__i") - F.col("__w") < r), F.col("__v")))

    per = own.groupBy(*keys, label, "n_in", "n_out").agg(
        before(low).alias("__a"), before(high).alias("__b"), ((holds(in_low) + holds(in_high)) / 2.0).alias("med_in")
    )
    per = cut(per.select(*keys, label, "n_in", "n_out", "med_in", F.array(low + F.col("__a"), high + F.col("__b")).alias("__at")))
    there = _at_places(ranked, per.select(*keys, F.explode("__at").alias("__p")).distinct(), keys)
    found = join_on(per.select(*keys, label, F.explode("__at").alias("__p")), there, [*keys, "__p"], "inner")
    found = found.groupBy(*keys, label).agg((F.sum("__v") / F.count(F.lit(1))).alias("med_out"))
    return join_on(per, found, [*keys, label], "left").select(*keys, label, "n_in", "med_in", F.col("n_out").cast("bigint").alias("n_out"), "med_out")


def _at_places(ranked: DataFrame, sought: DataFrame, keys: list[str]) -> DataFrame:
    """keys, __p, __v: the value at every sought place; a place goes to its range, where one ordered pass meets its entry."""
    spans = ranked.groupBy(*keys, "__range").agg(F.min(F.col("__p") - F.col("__w")).alias("__from"), F.max("__p").alias("__to"))
    sought = join_on(sought, broadcast_if_small(cut(spans)), keys, "inner").where("__p > __from AND __p <= __to")
    both = ranked.select(*keys, "__range", "__p", "__v").unionByName(sought.select(*keys, "__range", "__p", F.lit(None).cast("double").alias("__v")))
    down = Window.partitionBy(*keys, "__range").orderBy(F.desc("__p"), F.col("__v").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__at", F.last("__v", ignorenulls=True).over(down))
    return met.where(F.col("__v").isNull()).select(*keys, "__p", F.col("__at").alias("__v"))


def count_at_least(obs: DataFrame, ref: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """obs + (n_ref, n_ge): reference values of the same keys that are >= the observed one.

    Rank merge: both sides are collapsed to (key, score) counts, dealt by ranges and accumulated
    twice - over ranges, then inside a range - so no key's sample meets in one task.
    """
    keys = list(keys)
    refs = ref.select(*keys, F.col(score).alias("__s")).where(F.col("__s").isNotNull())
    both = refs.groupBy(*keys, "__s").agg(F.count(F.lit(1)).alias("__c")).unionByName(
        obs.select(*keys, F.col(score).alias("__s")).where(F.col("__s").isNotNull()).distinct()
        .withColumn("__c", F.lit(0).cast("bigint"))
    )
    both = both.groupBy(*keys, "__s").agg(F.sum("__c").alias("__c"))
    both = cut(both.repartitionByRange(*keys, F.desc("__s")).withColumn("__range", F.spark_partition_id()))
    per = both.groupBy(*keys, "__range").agg(F.sum("__c").alias("__t"))
    above = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = Window.partitionBy(*keys)
    per = cut(per.select(*keys, "__range", F.coalesce(F.sum("__t").over(above), F.lit(0)).alias("__above"), F.sum("__t").over(totals).alias("__n")))
    both = join_on(both, broadcast_if_small(per), [*keys, "__range"], "inner")
    down = Window.partitionBy(*keys, "__range").orderBy(F.desc("__s")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = both.withColumn("n_ge", (F.sum("__c").over(down) + F.col("__above")).cast("bigint"))
    ranked = ranked.select(*keys, F.col("__s").alias(score), "n_ge")
    out = join_on(obs, ranked, [*keys, score], "left")
    whole = broadcast_if_small(per.select(*keys, F.col("__n").alias("n_ref")).distinct())
    return join_on(out, whole, keys, "left").withColumn("n_ref", F.coalesce("n_ref", F.lit(0)))
