"""Embedding near-duplicates: a layered small-world graph per shard, every shard searched, exact cosine, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.components import connected_components
from emberline.llm.hnsw import Graph, unit
from emberline.llm.tables import cut, is_empty, slices, without

MIN_SHARDS = 6
SHARD_BYTES = 64 << 20
BEAM = 64
AUDIT_ROWS = 512
AUDIT_RECALL = 0.99
PLANTED = 64
QUERIES = 256  # looked up at once in a shard, fewer where QUERIES times its vectors exceed PAIRS
PAIRS = 6_000_000
_SLACK = 1e-4  # single precision finds candidates, double precision decides
_ROWS = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("cls", pa.string()), ("dim", pa.int32()), ("vec", pa.binary())])


def _vector(value) -> np.ndarray | None:
    """Double vector, or None for one that can be linked with nothing."""
    if not value or any(v is None for v in value):
        return None
    x = np.array(value, np.float64) + 0.0
    return x if np.isfinite(x).all() and np.linalg.norm(x) > 0 and np.isfinite(np.linalg.norm(x)) else None


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1024):
        vectors = [_vector(v) for v in batch.column("v").to_pylist()]
        raw = [None if x is None else x.tobytes() for x in vectors]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("id"),
                batch.column("h"),
                pa.array([None if r is None else hashlib.blake2b(r, digest_size=16).hexdigest() for r in raw], pa.string()),
                pa.array([None if x is None else len(x) for x in vectors], pa.int32()),
                pa.array(raw, pa.binary()),
            ],
            schema=_ROWS,
        )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's graph as one row."""
    rows = rows.sort_values("cls", ignore_index=True)
    raw = _matrix(rows["vec"])
    graph = Graph(unit(raw))
    return pd.DataFrame(
        {
            "dim": rows["dim"][:1],
            "shard": rows["shard"][:1],
            "names": pd.Series(["".join(rows["cls"])], dtype=object),
            "copies": [rows["copies"].to_numpy(np.int64).tobytes()],
            "raw": [raw.tobytes()],
            "layers": [[layer.tobytes() for layer in graph.links]],
        }
    )


def _load(row: dict) -> tuple[Graph, np.ndarray, list[str], np.ndarray]:
    copies = np.frombuffer(row["copies"], np.int64)
    raw = np.frombuffer(row["raw"], np.float64).reshape(len(copies), -1)
    layers = [np.frombuffer(b, np.int32).reshape(len(copies), -1) for b in row["layers"]]
    return Graph(unit(raw), layers), raw, [row["names"][32 * i : 32 * i + 32] for i in range(len(copies))], copies


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _matches(graph: Graph, nodes: np.ndarray, asked: np.ndarray, least: float, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, query row, node) of the matches in one shard, some queries at a time; cosines of the unit vectors
    are checked in double precision."""
    some = max(1, min(QUERIES, PAIRS // max(1, len(nodes))))
    for at in range(0, len(asked), some):
        part = asked[at : at + some]
        q, node = graph.within(unit(part), least - _SLACK, width)
        a = _unit(part)
        sure = np.zeros(len(q), bool)
        for i in range(0, len(q), 50_000):
            s = slice(i, i + 50_000)
            sure[s] = np.einsum("nd,nd->n", a[q[s]], nodes[node[s]]) >= least
        yield at, q[sure], node[sure]


def _unite(up: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``up`` (number -> root) after joining x with y; only pairs of different roots, each once, are walked."""
    x, y = up[x], up[y]
    apart = x != y
    x, y = x[apart], y[apart]
    if not len(x):
        return up
    fresh = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in np.unique(np.stack([x[fresh], y[fresh]], 1), axis=0).tolist():
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    while (up[up] != up).any():
        up = up[up]
    return up


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], dict | None, list[str], np.ndarray | None]]:
    """((dim, shard), graph row, [], None) for a graph, ((dim, shard), None, names, vectors) for queries of its shard."""
    for batch in batches:
        dims, shards, names = (batch.column(c).to_pylist() for c in ("dim", "shard", "cls"))
        kinds = [(d, s, n is None) for d, s, n in zip(dims, shards, names)]
        at = 0
        while at < len(kinds):
            end = at + 1
            while end < len(kinds) and kinds[end] == kinds[at] and not kinds[at][2]:
                end += 1
            if kinds[at][2]:
                yield kinds[at][:2], batch.slice(at, 1).to_pylist()[0], [], None
            else:
                yield kinds[at][:2], None, names[at:end], np.frombuffer(b"".join(batch.column("vec").slice(at, end - at).to_pylist()), np.float64).reshape(end - at, -1)
            at = end


_FOUND = pa.schema([("cls", pa.string()), ("links", pa.int64()), ("to", pa.string())])


def _found(rows: list[tuple[str | None, int, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FOUND)], schema=_FOUND)


def _searcher(least: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query of a shard the number of its links there, and edges that join what the links join, no more.

        A shard's graph comes before its queries, which stream by; the forest over the shard's vectors is all that grows.
        """
        place, names = None, []
        for key, row, own, asked in _runs(batches):
            if row is not None:
                if names:
                    yield _found([(names[i], 0, names[up[i]]) for i in np.flatnonzero(up != np.arange(len(up)))])
                place, (graph, raw, names, copies) = key, _load(row)
                nodes, up, number = _unit(raw), np.arange(len(names)), {x: i for i, x in enumerate(names)}
                continue
            if key != place:  # a shard without vectors of this length
                continue
            for at, q, node in _matches(graph, nodes, asked, least, width):
                part = own[at : at + QUERIES]
                self_ = np.array([number.get(x, -1) for x in part])
                other = self_[q] != node
                q, node = q[other], node[other]
                if not len(q):
                    continue
                links = np.bincount(q, copies[node], minlength=len(part)).astype(np.int64)
                linked, first = np.unique(q, return_index=True)
                anchor = np.full(len(part), -1)
                anchor[linked] = node[first]
                up = _unite(up, anchor[q], node)
                inside = linked[self_[linked] >= 0]
                up = _unite(up, self_[inside], anchor[inside])
                yield _found([(part[i], int(links[i]), None if self_[i] >= 0 else names[anchor[i]]) for i in linked])
        if names:
            yield _found([(names[i], 0, names[up[i]]) for i in np.flatnonzero(up != np.arange(len(up)))])

    return run


def _auditor(least: float, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(name, links found) of the audited vectors in a shard, and (null, found, planted) of neighbours planted there.

        A planted neighbour is a vector of the shard turned by an angle just inside the threshold, in a random direction;
        the search, which does not know it, has to come back with the vector.
        """
        place = None
        for key, row, own, asked in _runs(batches):
            if row is not None:
                place, (graph, raw, names, _) = key, _load(row)
                nodes, number = _unit(raw), {x: i for i, x in enumerate(names)}
                rng = np.random.default_rng(11)
                some = rng.choice(len(names), min(PLANTED, len(names)), replace=False)
                if raw.shape[1] > 1:
                    away = rng.standard_normal((len(some), raw.shape[1]))
                    away = _unit(away - np.einsum("nd,nd->n", away, nodes[some])[:, None] * nodes[some])
                    cosine = least + 0.1 * (1 - least)
                    turned = cosine * nodes[some] + np.sqrt(1 - cosine**2) * away
                    back = sum(int((some[q + at] == node).sum()) for at, q, node in _matches(graph, nodes, turned, least, width))
                    yield _found([(None, back, str(len(some)))])
                continue
            if key != place:
                continue
            for at, q, node in _matches(graph, nodes, asked, least, width):
                part = own[at : at + QUERIES]
                other = np.array([number.get(x, -1) for x in part])[q] != node
                yield _found([(part[i], int(n), None) for i, n in enumerate(np.bincount(q[other], minlength=len(part))) if n])

    return run


def _exact(sample: dict[int, tuple[list[str], np.ndarray]], least: float):
    """(name, links) of the sample's vectors by brute force over all rows of a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(names), np.int64) for d, (names, _) in sample.items()}
        for batch in slices(batches, 2048):
            for v in batch.column("vec").to_pylist():
                x = np.frombuffer(v, np.float64)
                if len(x) in sample:
                    total[len(x)] += sample[len(x)][1] @ (x / np.linalg.norm(x)) >= least
        yield _found([(name, int(n), None) for d, (names, _) in sample.items() for name, n in zip(names, total[d])])

    return run


def near_vectors(vectors: DataFrame, least: float = 0.95, shard_bytes: int = SHARD_BYTES, audit_rows: int = AUDIT_ROWS, audit_recall: float = AUDIT_RECALL) -> DataFrame:
    """Adds n_links, component_id and kept to every row (vec_id, embedding, ...).

    Equal vectors form a class first. Classes are dealt to shards of at most ``shard_bytes``, each shard's graph is
    built in one task and kept in a checkpoint, and every class is looked up in every shard, streaming past its graph. A query's beam
    doubles while it is full of matches, and the starting beam doubles until an audit passes. It has two parts, each to
    reach ``audit_recall``: ``audit_rows`` classes (the first by name hash; a bound on the sample, not on the search) are
    compared with brute force over all rows, and the recall is averaged over those that have a link, so a large family
    counts once; and in every shard PLANTED of its vectors are turned to a cosine just above ``least``, searched for, and
    must be found, so a table without any link is audited as well. Candidates count only if their cosine in double
    precision is ``least`` or more. A task returns per query a count, and edges of a spanning forest instead of pairs.

    n_links: other rows linked directly, equal rows included. component_id: smallest vec_id reachable; kept: vec_id =
    component_id. Vectors that are null, empty, zero or hold null or non-finite components have no link; vectors of
    different lengths are never linked. A null vec_id names no component unless all of one have none. Repeated rows are
    rows of their own. An empty table gives an empty result. Extra columns pass through; input columns named like an
    output column give way.
    """
    vectors = without(vectors, ["n_links", "component_id", "kept"])
    plain = vectors.select(F.col("vec_id").cast("long").alias("id"), F.xxhash64("embedding").alias("h"), F.col("embedding").alias("v"))
    rows = cut(plain.mapInArrow(_classed, "id long, h long, cls string, dim int, vec binary"))
    classes = cut(rows.where("cls is not null").groupBy("cls").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("vec").alias("vec")))
    linked, edges = _search(classes, least, shard_bytes, audit_rows, audit_recall)
    roots = connected_components(edges, "x", "y")
    rooted = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").join(linked, "cls", "left")
    rooted = rooted.select("cls", F.coalesce("root", "cls").alias("root"), "id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    firsts = rooted.groupBy("root").agg(F.min("id").alias("first"))
    labels = rooted.join(firsts, "root").select("cls", "links", "first")
    per_row = rows.select("id", "h", "cls").distinct().join(labels, "cls", "left")
    per_row = per_row.select("id", "h", F.coalesce("links", F.lit(0)).alias("n_links"), F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("first")).alias("component_id"))
    out = vectors.withColumn("__h", F.xxhash64("embedding")).join(per_row, F.col("vec_id").eqNullSafe(F.col("id")) & (F.col("__h") == F.col("h")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).drop("__h", "id", "h")


def _keys(spark: SparkSession, n: int) -> list[int]:
    """Numbers that a repartition into n by their column puts into partition 0, 1, ..., so that no two share one."""
    at = F.pmod(F.hash("id"), F.lit(n))
    found = dict(spark.range(0, 64 * n, 1, 1).groupBy(at.alias("at")).agg(F.min("id")).collect())
    return [found.get(i, i) for i in range(n)]


def _dealt(df: DataFrame, place: Column, n: int) -> DataFrame:
    """``df`` in n partitions by the number ``place``, which stands for its key in the new column deal."""
    return df.withColumn("deal", F.element_at(F.lit(_keys(df.sparkSession, n)), place.cast("int") + 1).cast("long")).repartition(n, "deal")


def _search(classes: DataFrame, least: float, shard_bytes: int, audit_rows: int, audit_recall: float) -> tuple[DataFrame, DataFrame]:
    """(cls, links) of the linked classes, and edges (x, y) between classes."""
    spark = classes.sparkSession
    if is_empty(classes):
        return spark.createDataFrame([], "cls string, links long"), spark.createDataFrame([], "x string, y string")
    size, rows = classes.agg(F.sum(F.length("vec")), F.count("*")).first()
    shards = max(MIN_SHARDS, -(-size // shard_bytes))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("cls"), F.lit(shards)).cast("int"))
    own = _dealt(dealt.select("dim", "shard", "cls", "copies", "vec"), F.col("shard"), shards)  # a shard a task
    graphs = cut(own.groupBy("dim", "shard", "deal").applyInPandas(_build, "dim int, shard int, names string, copies binary, raw binary, layers array<binary>"))

    def search(asked: DataFrame, task, parts: int = 1) -> DataFrame:
        """Every vector asked for in every shard: its queries, in so many parts, stream past a graph that is sent once to each."""
        every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
        sent = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
        graph = graphs.select("dim", "shard", sent, F.lit(None).cast("string").alias("cls"), F.lit(None).cast("binary").alias("vec"), "names", "copies", "raw", "layers")
        part = F.pmod(F.xxhash64("cls", F.lit(2)), F.lit(parts)).cast("int").alias("part")
        queries = asked.select("dim", every, part, "cls", "vec", *(F.lit(None).cast(graph.schema[c].dataType).alias(c) for c in ("names", "copies", "raw", "layers")))
        both = _dealt(graph.unionAll(queries), F.col("shard") * parts + F.col("part"), shards * parts)
        both = both.sortWithinPartitions("deal", "dim", "shard", F.col("cls").isNotNull()).drop("deal", "part")
        return both.mapInArrow(task, "cls string, links long, to string")

    audited = cut(classes.orderBy(F.xxhash64("cls", F.lit(1))).limit(audit_rows).select("cls", "dim", "vec"))
    sample: dict[int, list[tuple[str, bytes]]] = {}
    for cls, dim, vec in audited.collect():
        sample.setdefault(dim, []).append((cls, vec))
    known = classes.mapInArrow(_exact({d: ([c for c, _ in v], _unit(np.frombuffer(b"".join(x for _, x in v), np.float64).reshape(len(v), d))) for d, v in sample.items()}, least), "cls string, links long, to string")
    known = {r.cls: r.links - 1 for r in known.groupBy("cls").agg(F.sum("links").alias("links")).collect() if r.links > 1}  # each finds itself
    width = BEAM
    while width < rows:
        seen = search(audited, _auditor(least, width)).groupBy("cls").agg(F.sum("links").alias("links"), F.sum(F.col("to").cast("long")).alias("planted")).collect()
        hits = {r.cls: r.links for r in seen}
        planted = next((r.links / r.planted for r in seen if r.cls is None), 1.0)
        linked = sum(min(1.0, hits.get(c, 0) / n) for c, n in known.items()) / len(known) if known else 1.0
        if min(planted, linked) >= audit_recall:
            break
        width *= 2
    parts = max(1, -(-spark.sparkContext.defaultParallelism // shards))  # all cores have work where shards are few
    found = cut(search(classes, _searcher(least, width), parts))
    return found.where("links > 0").groupBy("cls").agg(F.sum("links").alias("links")), found.where("to is not null").select(F.col("cls").alias("x"), F.col("to").alias("y"))
