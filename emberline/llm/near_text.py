"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard links on full sets, components.

Equal shingle sets form one class first, so any number of copies costs one signature row. Inside a band bucket no
pair list is made: members are linked to a leader, buckets whose members all share a component are done, the others
meet further leaders, and what is still apart is settled exactly by prefix filtering on the rarest shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.components import connected_components
from emberline.llm.shingles import WordHashes, band_keys, circulant_signatures, set_digest, shingle_set, similar
from emberline.llm.tables import is_empty, joinable, kept, slices, text_bytes, without

ROWS = 4
MISS = 1e-5
LEADER_ROUNDS = 3
EARLIER = 32
_SKETCH = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("cls", pa.string()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([("id", pa.int64()), ("members", pa.binary())])
_SHINGLES = pa.schema([("id", pa.int64()), ("root", pa.int64()), ("n", pa.int32()), ("shingle", pa.int64())])


def _sketcher(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            sets = [shingle_set(t, width, memo) for t in text_bytes(batch.column("text"))]
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(circulant_signatures(full, bands * rows), rows)) if full else iter(())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("d"),
                    batch.column("h"),
                    pa.array([set_digest(s) if len(s) else None for s in sets], pa.string()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                schema=_SKETCH,
            )

    return run


def _set_reader(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in slices(batches):
            rows = zip(batch.column("id").to_pylist(), batch.column("cls").to_pylist(), text_bytes(batch.column("text")))
            found = [(i, s) for i, c, t in rows if set_digest(s := shingle_set(t, width, memo)) == c]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s.tobytes() for _, s in found], pa.binary())], schema=_SETS)

    return run


def _verifier(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            a, b = batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) of class ids that pass the exact test, checkpointed.

    Pairs are narrow: while they are small they travel to the sets, and only the sets that some pair names are moved.
    """
    pairs = joinable(pairs)
    needed = joinable(pairs.select(F.col("b").alias("id")).distinct())
    first = sets.join(pairs, F.col("id") == F.col("a")).select("a", "b", F.col("members").alias("set_a"))
    second = sets.join(needed, "id", "left_semi").select(F.col("id").alias("b"), F.col("members").alias("set_b"))
    # the lengths alone rule out many pairs before Python sees them
    shortest, longest = F.least(F.length("set_a"), F.length("set_b")), F.greatest(F.length("set_a"), F.length("set_b"))
    both = first.join(second, "b").where(100 * shortest >= percent * longest)
    return kept(both.select("a", "b", "set_a", "set_b").mapInArrow(_verifier(percent), "a long, b long"))


def _proper(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).where("a <> b").distinct()


def _residual_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of open members (id, root) in different components that share one of their rarest shingles.

    Two sets of similarity p/100 share a shingle among the first n - ceil(n * p/100) + 1 of each in any common
    order; with the order rarest first, near misses of a large family share none and no pair arises. Within a
    shingle's members only those outside its most frequent component are paired.
    """
    shingles = kept(sets.join(joinable(members), "id").mapInArrow(_exploded, "id long, root long, n int, shingle long"), 1_000_000)
    shared = shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    ranked = shingles.join(shared, "shingle", "left")
    # shingles of one member only sort first and can be shared with nobody, so only their number matters
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "shingle"))
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    prefix = ranked.select("id", "root", "n", "shingle", "df", order.alias("at")).where((F.col("at") <= keep) & (F.col("df") > 1)).drop("df")
    # the shingles just before tell whether a pair has met already; beyond EARLIER of them it may come up again
    before = Window.partitionBy("id").orderBy("at").rowsBetween(-EARLIER, -1)
    prefix = kept(prefix.withColumn("earlier", F.collect_list("shingle").over(before)))
    sizes = prefix.groupBy("shingle", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots")).where("roots > 1").select("shingle", "main")
    held = kept(prefix.join(main, "shingle"))
    minor = held.where("root <> main").select("shingle", F.col("id").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("at").alias("ix"), F.col("earlier").alias("ex"))
    other = held.select("shingle", F.col("id").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("at").alias("iy"), F.col("earlier").alias("ey"))
    # the first shared shingle is followed by all the others, of which such a pair has so many
    common = F.ceil((F.col("nx") + F.col("ny")) * percent / (100 + percent))
    fits = (F.col("rx") != F.col("ry")) & (F.col("ix") <= F.col("nx") - common + 1) & (F.col("iy") <= F.col("ny") - common + 1)
    first = ~F.arrays_overlap("ex", "ey")
    return _proper(minor.join(other, "shingle").where(fits & first), "x", "y")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 64):
        sets = [np.frombuffer(m, np.int64) for m in batch.column("members").to_pylist()]
        size = np.array([len(s) for s in sets], np.int32)
        at = np.repeat(np.arange(len(sets)), size)
        cols = [batch.column("id").take(pa.array(at)), batch.column("root").take(pa.array(at)), pa.array(size[at]), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))]
        yield pa.RecordBatch.from_arrays(cols, schema=_SHINGLES)


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands of ``rows`` coordinates so that a pair at the threshold escapes them all with probability below ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Adds n_shingles, class_id, component_id, kept to every row; links need 100 * intersection >= percent * union.

    class_id names the text's shingle set (rows of one class are linked); component_id is the smallest doc_id
    reachable, kept says doc_id = component_id. There are as many bands as ``bands_for`` the threshold says.

    Nulls: a null text is empty; empty texts have no class, are linked with nothing and keep their own id. A null
    doc_id names a component only if none of its rows has an id. Rows repeated whole or in doc_id alone are rows of
    their own. An empty table gives an empty result. Extra columns pass through; input columns named like an output
    column give way to it. Long texts are read whole.
    """
    return _grouped(docs, words, percent).drop("__root")


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """near_duplicates with __root, the number of the row's component, which ids that repeat cannot confuse."""
    docs = without(docs, ["n_shingles", "class_id", "component_id", "kept"])
    rows_of = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text")
    sketch = kept(rows_of.mapInArrow(_sketcher(words, bands_for(percent), ROWS), "d long, h long, cls string, n_shingles long, bands array<long>"))
    # from here on classes go by a number, fixed by the checkpoint
    classes = kept(sketch.where("cls is not null").groupBy("cls").agg(F.min("d").alias("d"), F.min(F.struct(F.col("d").isNull().alias("no"), "d", "h")).alias("at"), F.first("bands").alias("bands")).withColumn("id", F.monotonically_increasing_id()))
    roots = _class_roots(classes, rows_of, words, percent)
    named = classes.select("cls", "id", "d").join(joinable(roots), "id", "left").withColumn("root", F.coalesce("root", "id"))
    least = named.groupBy("root").agg(F.min("d").alias("least"))
    named = named.join(least, "root").select("cls", "least", "root")
    per_doc = sketch.select("d", "h", "cls", "n_shingles").distinct().join(named, "cls", "left")
    labels = per_doc.select("d", "h", "n_shingles", F.col("cls").alias("class_id"), F.when(F.col("cls").isNull(), F.col("d")).otherwise(F.col("least")).alias("component_id"), F.col("root").alias("__root"))
    # ids and text hashes are joined before texts are needed: a caller that asks for ids alone moves no text
    joined = docs.withColumn("__h", F.xxhash64("text")).join(labels, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__h") == F.col("h")))
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("__h", "d", "h")


def one_per_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays.

    Rows that repeat that doc_id inside the component, and those of a component without ids, are reduced to the one with
    the smallest text; all empty texts stay. One doc_id on texts that are no near copies costs none of them. Columns are
    those of ``docs``.
    """
    columns = docs.columns
    found = _grouped(docs, words, percent).where("kept")
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    single = found.where("class_id is not null").groupBy("__root").agg(F.min_by(row, F.col("text")).alias("row"))
    return single.select("row.*").unionByName(found.where("class_id is null").select(*[f"`{c}`" for c in columns]))


def _class_roots(classes: DataFrame, rows_of: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, root) of the classes that are linked with another class."""
    keyed = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("leader")).where("size > 1")
    held = kept(keyed.join(crowded, "bucket"))
    if is_empty(held):
        return classes.sparkSession.createDataFrame([], "id long, root long")
    # a class is read from one of its rows, named by id and text hash: an id that repeats on other texts costs nothing
    located = joinable(classes.select("id", "cls", F.col("at.d").alias("at"), F.col("at.h").alias("hash")).join(joinable(held.select("id").distinct()), "id", "left_semi"))
    sets = kept(rows_of.join(located, F.col("d").eqNullSafe(F.col("at")) & (F.col("h") == F.col("hash"))).select("id", "cls", "text").mapInArrow(_set_reader(words), "id long, members binary").dropDuplicates(["id"]), size="length(members)")
    # one band settles most families; the others then have few pairs left to test
    links = _links(_proper(held.where("band = 0"), "id", "leader"), sets, percent)
    roots = kept(_named(connected_components(links, "a", "b")))
    open_ = held.select("bucket", "id", "size")
    for turn in range(LEADER_ROUNDS):
        open_ = _unsettled(open_, roots)
        if is_empty(open_):
            return roots
        leader = open_.groupBy("bucket").agg(F.min_by(F.struct("id", "root"), F.xxhash64("id", F.lit(turn))).alias("leader"))
        tried = open_.join(leader, "bucket").where("root <> leader.root").select("id", F.col("leader.id").alias("leader"))
        roots = _merged(roots, _links(_proper(tried, "id", "leader"), sets, percent))
        open_ = open_.where("size > 2")  # a bucket of two is settled by its one pair
    open_ = _unsettled(open_, roots)
    if is_empty(open_):
        return roots
    rest = _residual_pairs(open_.select("id", "root").distinct(), sets, percent)
    return _merged(roots, _links(rest, sets, percent))


def _named(components: DataFrame) -> DataFrame:
    return components.select(F.col("node").alias("id"), "root")


def _unsettled(open_: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (bucket, id, size, root) of the buckets that still hold several components."""
    now = open_.select("bucket", "id", "size").join(roots, "id", "left").select("bucket", "id", "size", F.coalesce("root", "id").alias("root"))
    several = now.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("bucket")
    return kept(now.join(several, "bucket"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only the links between different roots are walked."""

    def root_of(side: str) -> DataFrame:
        return roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))

    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    between = kept(between.select(F.coalesce("root_a", "a").alias("x"), F.coalesce("root_b", "b").alias("y")).where("x <> y").distinct())
    if is_empty(between):
        return roots
    moved = kept(connected_components(between, "x", "y").select(F.col("node").alias("root"), F.col("root").alias("new")))
    old = roots.join(moved, "root", "left").select("id", F.coalesce("new", "root").alias("root"))
    return kept(old.unionAll(moved.select(F.col("root").alias("id"), F.col("new").alias("root"))).groupBy("id").agg(F.min("root").alias("root")))
