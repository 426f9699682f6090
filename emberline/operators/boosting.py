"""Boosted regression trees, cross-fitted: no row is predicted by a model that saw its lot.

Lots are dealt to ``folds`` groups by a hash of their name; a model is a parameter and the
group it does not see, and all models grow together.  Trees see a row only by its bins, so rows
of equal bins are one cell with their number and their targets' sum.  A level of all trees is one
pass over the cells: every task adds up, per model, node, feature and bin, how many rows there
are and the residuals they have left; a few thousand sums decide all splits.  Every REST trees
what is left is written down, so a pass evaluates the trees since then and not all before.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.ranks import group_quantiles
from emberline.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this module

BINS = 32
REST = 10  # trees until what is left is written down
BLOCK = 65_536  # cells in a row of the blocks table
PART = 400_000  # cells read by a task, about
_SUM = pa.schema([("cell", pa.int64()), ("n", pa.int64()), ("left", pa.float64())])
_SUM_DDL = "cell long, n long, left double"
_BLOCK = pa.schema([("p", pa.int32()), ("grp", pa.int32()), ("codes", pa.binary()), ("n", pa.binary()), ("left", pa.binary())])
_BLOCK_DDL = "p int, grp int, codes binary, n binary, left binary"


@dataclass
class Tree:
    """Splits by heap position (feature -1: none) and the values of the leaves, per (parameter, model)."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray


def _node(tree: Tree, p: int, model: int, codes: np.ndarray, levels: int) -> np.ndarray:
    """Heap position of every cell after so many levels; a node without a split keeps its cells."""
    row, at = np.arange(codes.shape[1]), np.ones(codes.shape[1], np.int64)
    for _ in range(levels):
        j = tree.feature[p, model, at]
        right = codes[np.maximum(j, 0), row] > tree.bin[p, model, at]
        at = np.where(j < 0, at, 2 * at + right)
    return at


def _scorer(trees: Sequence[Tree], p: int, model: int, depth: int, width: int):
    """Function of codes (features down): sum of the trees' values.

    A word has a bit for every inner node of a few trees, set where a row would go right; a feature's words by bin are
    looked up and joined, so a tree costs one look-up of its bits however deep it is.
    """
    inner = (1 << depth) - 1
    some = max(1, 64 // inner)
    words = []
    for at in range(0, len(trees), some) if inner <= 16 else ():
        word, values = np.zeros((width, BINS), np.uint64), []
        for t, tree in enumerate(trees[at : at + some]):
            for node in range(1, 1 << depth):
                if (j := tree.feature[p, model, node]) >= 0:
                    word[j, tree.bin[p, model, node] + 1 :] |= np.uint64(1 << (t * inner + node - 1))
            bits, leaf = np.arange(1 << inner), np.ones(1 << inner, np.int64)
            for _ in range(depth):
                leaf = np.where(tree.feature[p, model, leaf] < 0, leaf, 2 * leaf + (bits >> (leaf - 1) & 1))
            values.append(tree.value[p, model, leaf])
        words.append((word, values))

    def score(codes: np.ndarray) -> np.ndarray:
        out = np.zeros(codes.shape[1])
        for word, values in words:
            bits = word[0][codes[0]]
            for j in range(1, width):
                bits |= word[j][codes[j]]
            for t, value in enumerate(values):
                out += value[(bits >> np.uint64(t * inner)).astype(np.int64) & ((1 << inner) - 1)]
        if inner > 16:  # deep trees are walked
            for tree in trees:
                out += tree.value[p, model, _node(tree, p, model, codes, depth)]
        return out

    return score


def _coder(edges: np.ndarray, schema: pa.Schema):
    """Rows by bins: (__id, p, grp, codes, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, codes = batch.column("p").to_numpy(), np.zeros((batch.num_rows, edges.shape[1]), np.uint8)
            for j in range(edges.shape[1]):
                x = batch.column(f"x{j}").to_numpy()
                for q in np.unique(p):
                    codes[p == q, j] = np.searchsorted(edges[q, j], x[p == q], side="left")
            ends = pa.py_buffer(np.arange(0, codes.size + 1, edges.shape[1], dtype=np.int32))
            packed = pa.Array.from_buffers(pa.binary(), len(codes), [None, ends, pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("p"), batch.column("grp"), packed, batch.column("y")], schema=schema)

    return run


def _codes(column: pa.Array, width: int) -> np.ndarray:
    """Bins, features down."""
    return np.ascontiguousarray(np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width).T)


def _packer(start: np.ndarray, width: int):
    """Blocks of cells of one parameter and group: bins, number of rows, and what each model's start leaves of their targets."""

    def block(p: int, grp: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        codes, n, s = (np.concatenate([part[i] for part in parts], -1) for i in range(3))
        left = s - start[p][:, None] * n
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((p, grp, codes.tobytes(), n.tobytes(), left.tobytes()), _BLOCK)], schema=_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held = None, [], 0
        for batch in batches:
            p, grp = (batch.column(c).to_numpy() for c in ("p", "grp"))
            codes, n, s = _codes(batch.column("codes"), width), batch.column("n").to_numpy(), batch.column("s").to_numpy()
            ends = np.append(np.flatnonzero((p[1:] != p[:-1]) | (grp[1:] != grp[:-1])) + 1, len(p))
            at = 0
            for end in ends if len(p) else ():
                now = int(p[at]), int(grp[at])
                if parts and (now != key or held >= BLOCK):
                    yield block(*key, parts)
                    parts, held = [], 0
                key = now
                parts.append((codes[:, at:end], n[at:end], s[at:end]))
                held, at = held + end - at, end
        if parts:
            yield block(*key, parts)

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(parameter, group, codes, numbers of rows, what is left by model) of every block."""
    for batch in batches:
        for p, grp, codes, n, left in zip(*(c.to_pylist() for c in batch.columns)):
            n = np.frombuffer(n, np.int64)
            yield p, grp, np.frombuffer(codes, np.uint8).reshape(width, -1), n, np.frombuffer(left).reshape(-1, len(n))


def _summer(recent: list[Tree], making: Tree, shape: tuple[int, ...], depth: int, level: int):
    """Sums of one level of the tree in the making; ``recent`` are the trees since what is left was written down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, folds, nodes, width, _ = shape
        n, left, scorers = np.zeros(shape, np.int64), np.zeros(shape), {}
        for p, grp, codes, count, rest in _blocks(batches, width):
            for model in range(folds):
                if model == grp:
                    continue
                if (p, model) not in scorers:
                    scorers[p, model] = _scorer(recent, p, model, depth, width)
                r, node, c, k = rest[model] - count * scorers[p, model](codes), 0, codes, count
                if level:
                    node = _node(making, p, model, codes, level) - nodes
                    inside = node >= 0
                    if not inside.all():
                        r, node, c, k = r[inside], node[inside], codes[:, inside], count[inside]
                for j in range(width):
                    cell = node * BINS + c[j].astype(np.int64)
                    n[p, model, :, j] += np.bincount(cell, k, BINS * nodes).astype(np.int64).reshape(-1, BINS)
                    left[p, model, :, j] += np.bincount(cell, r, BINS * nodes).reshape(-1, BINS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at]), pa.array(left.ravel()[at])], schema=_SUM)

    return run


def _rester(recent: list[Tree], depth: int, width: int):
    """Blocks with what is left after the recent trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, grp, codes, n, left in _blocks(batches, width):
            rest = np.stack([left[m] if m == grp else left[m] - n * _scorer(recent, p, m, depth, width)(codes) for m in range(len(left))])
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((p, grp, codes.tobytes(), n.tobytes(), rest.tobytes()), _BLOCK)], schema=_BLOCK)

    return run


def _predictor(trees: list[Tree], start: np.ndarray, depth: int, width: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {}
        for batch in batches:
            p, grp, out = batch.column("p").to_numpy(), batch.column("grp").to_numpy(), np.zeros(batch.num_rows)
            codes = _codes(batch.column("codes"), width)
            for q, model in {*zip(p.tolist(), grp.tolist())}:
                if (q, model) not in scorers:
                    scorers[q, model] = _scorer(trees, q, model, depth, width)
                own = (p == q) & (grp == model)
                out[own] = start[q, model] + scorers[q, model](codes[:, own])
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(out, from_pandas=True)], schema=schema)

    return run


def _cells(rows: DataFrame) -> DataFrame:
    """Rows to learn from (p, grp, codes, y), those of equal bins once with their number n and their targets' sum s."""
    return rows.where(~F.isnan("y")).groupBy("p", "grp", "codes").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))


def _split(n: np.ndarray, left: np.ndarray, least: int, l2: float) -> tuple[int, int]:
    """(feature, bin) of the best split of a node, (-1, 0) if none gains: rows in bins up to it go left."""
    nl, rl = n.cumsum(1), left.cumsum(1)
    nr, rr = nl[:, -1:] - nl, rl[:, -1:] - rl
    gain = rl**2 / (nl + l2) + rr**2 / (nr + l2) - rl[:, -1:] ** 2 / (nl[:, -1:] + l2)
    gain[(nl < least) | (nr < least)] = -np.inf
    j, b = np.unravel_index(np.argmax(gain), gain.shape)
    return (int(j), int(b)) if gain[j, b] > 1e-12 else (-1, 0)


def cross_fitted(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    fold: str = "lot_id",
    folds: int = 5,
    iterations: int = 50,
    depth: int = 3,
    rate: float = 0.05,
    least: int = 10,
    l2: float = 1.0,
) -> DataFrame:
    """``df`` (parameter_name, fold, features, target) with delta_hat, the boosted forecast of the target.

    Squared loss; trees of ``depth`` levels over BINS bins between exact quantiles; leaves hold ``least`` rows or more.
    Rows without a finite target are forecast and not learned from; rows without all features finite, or without a lot,
    have a null delta_hat.
    """
    spark, width = df.sparkSession, len(features)
    df = cut(df.withColumn("__id", F.monotonically_increasing_id()))
    sound = [F.coalesce(F.abs(F.col(c)) < float("inf"), F.lit(False)) for c in features]
    usable = df.where(F.col(fold).isNotNull())
    for s in sound:
        usable = usable.where(s)
    names = sorted(r[0] for r in usable.select("parameter_name").distinct().collect())
    if not names:
        return df.withColumn("delta_hat", F.lit(None).cast("double")).drop("__id")
    number = F.broadcast(spark.createDataFrame(list(enumerate(names)), "p int, parameter_name string"))
    y = F.when(F.coalesce(F.abs(F.col(target)) < float("inf"), F.lit(False)), F.col(target)).otherwise(F.lit(float("nan")))
    group = F.pmod(F.xxhash64(fold), F.lit(folds)).cast("int")
    rows = usable.join(number, "parameter_name").select("__id", "p", group.alias("grp"), *(F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(features)), y.cast("double").alias("y"))
    rows = cut(rows)

    edges = np.zeros((len(names), width, BINS - 1))
    long = rows.select("p", F.posexplode(F.array(*(f"x{j}" for j in range(width)))).alias("j", "v"))
    for r in group_quantiles(long, ["p", "j"], "v", [i / BINS for i in range(1, BINS)]).collect():
        edges[r.p, r.j] = r.q
    starts = np.zeros((len(names), folds))
    sums = {(r.p, r.grp): (r.n, r.s) for r in rows.where(~F.isnan("y")).groupBy("p", "grp").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}
    for p in range(len(names)):
        for m in range(folds):
            seen = [sums.get((p, g), (0, 0.0)) for g in range(folds) if g != m]
            starts[p, m] = sum(s for _, s in seen) / max(1, sum(n for n, _ in seen))
            if not sum(n for n, _ in seen):
                starts[p, m] = np.nan  # nothing to learn from
    schema = pa.schema([("__id", pa.int64()), ("p", pa.int32()), ("grp", pa.int32()), ("codes", pa.binary()), ("y", pa.float64())])
    rows = cut(rows.mapInArrow(_coder(edges, schema), "__id long, p int, grp int, codes binary, y double"))
    cells = cut(_cells(rows))
    count, cores = cells.count(), spark.sparkContext.defaultParallelism
    parts = cores * -(-count // (PART * cores)) if count > PART else -(-count // (PART // cores))
    blocks = cut(cells.repartition(max(1, parts)).sortWithinPartitions("p", "grp").mapInArrow(_packer(starts, width), _BLOCK_DDL))

    trees: list[Tree] = []
    for done in range(iterations):
        heap = (len(names), folds, 2 << depth)
        making = Tree(np.full(heap, -1), np.zeros(heap, np.int64), np.zeros(heap))
        recent = trees[done - done % REST :]
        if done and not recent:
            blocks = cut(blocks.mapInArrow(_rester(trees[-REST:], depth, width), _BLOCK_DDL))
        for level in range(depth):
            nodes = 1 << level
            shape = (len(names), folds, nodes, width, BINS)
            found = blocks.mapInArrow(_summer(recent, making, shape, depth, level), _SUM_DDL).groupBy("cell").agg(F.sum("n").alias("n"), F.sum("left").alias("left")).toArrow()
            n, left = np.zeros(shape, np.int64), np.zeros(shape)
            at = found.column("cell").to_numpy()
            n.ravel()[at], left.ravel()[at] = found.column("n").to_numpy(), found.column("left").to_numpy()
            for p, m, i in np.ndindex(len(names), folds, nodes):
                node = nodes + i
                if not n[p, m, i].any():
                    continue
                j, b = _split(n[p, m, i], left[p, m, i], least, l2)
                making.feature[p, m, node], making.bin[p, m, node] = j, b
                count, total = n[p, m, i].cumsum(1), left[p, m, i].cumsum(1)
                # values of both children, or of the node itself where it stays a leaf
                if j < 0:
                    making.value[p, m, node] = rate * total[0, -1] / (count[0, -1] + l2)
                else:
                    making.value[p, m, 2 * node] = rate * total[j, b] / (count[j, b] + l2)
                    making.value[p, m, 2 * node + 1] = rate * (total[j, -1] - total[j, b]) / (count[j, -1] - count[j, b] + l2)
        trees.append(making)
    schema = pa.schema([("__id", pa.int64()), ("delta_hat", pa.float64())])
    made = rows.mapInArrow(_predictor(trees, starts, depth, width, schema), "__id long, delta_hat double")
    return df.drop("delta_hat").join(made, "__id", "left").drop("__id")
