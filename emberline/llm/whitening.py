"""Embedding whitening: leading eigenvectors by Chebyshev-filtered subspace iteration over distributed centred products."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.tables import is_empty, slices, stored, without

COMPONENTS = 16
GUARD = 32  # further columns of the iterated block
DEGREE = 12
TOLERANCE = 2e-14  # residual of a component over the largest eigenvalue
SCALE = 64
_LIMIT = 2**62  # levels are held within it
_LONG = 2**63
_WIDTHS = (np.int16, np.int32, np.int64)
_RESULT = "struct<n: long, deviation: long, whitened: array<double>, explained: array<double>, residual: array<double>, identity_error: double>"


def _levels(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(64 c) as int64 matrix) of the usable vectors of a list column, one length after the other."""
    values = vectors.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null entry becomes NaN
    offsets = vectors.offsets.to_numpy()
    lengths = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    for dim in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == dim)
        entries = values[offsets[rows][:, None] + np.arange(dim)]
        good = np.isfinite(entries).all(1)
        with np.errstate(over="ignore"):
            yield rows[good], np.clip(np.floor(SCALE * entries[good]), -_LIMIT, _LIMIT).astype(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, key) of every usable vector; the key is its levels in the narrowest integers that hold them."""
    for batch in slices(batches, 4096):
        dims, keys = [], []
        for _, levels in _levels(batch.column("v")):
            most = np.maximum(levels.max(1, initial=0), -(levels.min(1, initial=0) + 1))
            for row, top in zip(levels, most):
                keys.append(row.astype(next(w for w in _WIDTHS if top <= np.iinfo(w).max)).tobytes())
            dims += [levels.shape[1]] * len(levels)
        yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(keys, pa.binary())], names=["dim", "key"])


def _matrices(batches: Iterator[pa.RecordBatch], dim: int, rows: int = 4096) -> Iterator[np.ndarray]:
    """int64 level matrices of the keys of one length."""
    for batch in slices(batches, rows):
        keys = batch.column("key").to_pylist()
        for width in _WIDTHS:
            own = [k for k in keys if len(k) == dim * np.dtype(width).itemsize]
            if own:
                yield np.frombuffer(b"".join(own), width).reshape(len(own), dim).astype(np.int64)


def _scaled(levels: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * level - sum, exactly: int64 where it fits, else Python integers."""
    most = max(abs(int(levels.max(initial=0))), abs(int(levels.min(initial=0))))
    if n * most + max(map(abs, sums), default=0) < _LONG:
        return n * levels - np.array(sums, np.int64)
    return n * levels.astype(object) - np.array(sums, object)


def _centred(levels: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_scaled(levels, n, sums) / n).astype(np.float64)


def _squares(scaled: np.ndarray) -> list[int]:
    """Exact sum of squares per row."""
    most = max(abs(int(scaled.max(initial=0))), abs(int(scaled.min(initial=0))))
    if scaled.dtype != object and most * most * scaled.shape[1] < _LONG:
        return (scaled * scaled).sum(1).tolist()
    return (scaled.astype(object) ** 2).sum(1).tolist()


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, i, n, total): rows and exact sum of dimension i."""
    rows: dict[int, int] = {}
    sums: dict[int, np.ndarray] = {}
    for batch in slices(batches, 4096):
        for dim in set(batch.column("dim").to_pylist()):
            own = batch.filter(pc.equal(batch.column("dim"), dim))
            for levels in _matrices([own], dim):
                rows[dim] = rows.get(dim, 0) + len(levels)
                high, low = levels >> 31, levels & (2**31 - 1)
                sums[dim] = sums.get(dim, 0) + (high.sum(0).astype(object) << 31) + low.sum(0).astype(object)
    for dim, total in sums.items():
        parts = [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([rows[dim]] * dim, pa.int64()), pa.array([Decimal(int(x)) for x in total], pa.decimal128(38))]
        yield pa.RecordBatch.from_arrays(parts, names=["dim", "i", "n", "total"])


def _product(dim: int, n: int, sums: list[int], block: Broadcast):
    """Per split and dimension i a row of its share of XᵀXQ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, total = block.value, 0.0
        for levels in _matrices(batches, dim):
            x = _centred(levels, n, sums)
            total = total + x.T @ (x @ q)
        if not np.isscalar(total):
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), *(pa.array(c) for c in total.T)], names=["i", *(f"c{j}" for j in range(q.shape[1]))])

    return run


def _moments(dim: int, n: int, sums: list[int], projection: np.ndarray):
    """Per split: rows of [whitened, 1]ᵀ[whitened, 1], and the sum of squares of n * level - sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = projection.shape[1] + 1
        total, spread = np.zeros((width, width)), 0
        for levels in _matrices(batches, dim):
            scaled = _scaled(levels, n, sums)
            p = np.hstack([(scaled / n).astype(np.float64) @ projection, np.ones((len(levels), 1))])
            total += p.T @ p
            spread += sum(_squares(scaled))
        parts = [pa.array(range(width), pa.int32()), pa.array([float(spread)] + [0.0] * (width - 1)), *(pa.array(c) for c in total.T)]
        yield pa.RecordBatch.from_arrays(parts, names=["i", "spread", *(f"c{j}" for j in range(width))])

    return run


def _square(partial: DataFrame, width: int) -> np.ndarray:
    """The partial matrices' sum, in the driver: one row per dimension."""
    found = partial.groupBy("i").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width))).toArrow()
    return np.stack([found.column(f"c{j}").to_numpy() for j in range(width)], 1)[np.argsort(found.column("i").to_numpy())]


def leading_eigenpairs(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues falling, eigenvectors, residual norms) of a positive semidefinite matrix known by ``product(block)``.

    Each round takes the Ritz pairs of the block, then multiplies it by the Chebyshev polynomial that is small on
    [0, least Ritz value of the block], the spectrum not wanted, and grows fast above. Certified once the residual of
    every wanted pair is within ``tolerance`` of the largest eigenvalue, or rounding keeps it from falling any more.
    """
    wanted, size = min(wanted, dim), min(dim, wanted + guard)
    q = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, size)))[0]
    aq, best, stalled = product(q), np.inf, 0
    while True:
        inner = q.T @ aq
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = q @ turn, aq @ turn
        residual = np.linalg.norm(ax - x * values, axis=0)[:wanted]
        top = max(values[0], 0.0)
        worst = residual.max(initial=0.0)
        stalled = stalled + 1 if worst > 0.5 * best else 0
        best = min(best, worst)
        if size == dim or worst <= tolerance * top or stalled >= 2 and worst <= 1e3 * tolerance * top:
            return values[:wanted], x[:, :wanted], residual
        half = max(values[-1], 1e-3 * top / dim) / 2  # the interval is [0, 2 * half]
        step = first = half / (top - half)
        before, now = x, (ax - half * x) * (first / half)
        for _ in range(degree - 1):
            onward = 1 / (2 / first - step)
            before, now = now, 2 * onward / half * (product(now) - half * now) - step * onward * before
            step = onward
        q = np.linalg.qr(now)[0]
        aq = product(q)


@dataclass
class Whitening:
    """What the vectors of one length are transformed by."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: list[float]
    residual: list[float]
    identity_error: float


def fit(keys: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Whitening per vector length from a table of distinct (dim, key)."""
    context = keys.sparkSession.sparkContext
    models = {}
    found: dict[int, list] = {}
    totals = keys.mapInArrow(_totals, "dim int, i int, n long, total decimal(38,0)").groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    for r in totals.orderBy("dim", "i").collect():
        found.setdefault(r.dim, []).append(r)
    for dim, rows in found.items():
        n, sums = rows[0].n, [int(r.total) for r in rows]
        own = keys.where(F.col("dim") == dim).select("key")

        def product(block: np.ndarray) -> np.ndarray:
            sent = context.broadcast(block)
            width = block.shape[1]
            schema = "i int, " + ", ".join(f"c{j} double" for j in range(width))
            out = _square(own.mapInArrow(_product(dim, n, sums, sent), schema), width) / n
            sent.destroy()
            return out

        values, vectors, residual = leading_eigenpairs(product, dim, components)
        real = values > 8 * dim * np.finfo(float).eps * max(values[0], 0.0)
        values, vectors, residual = values[real], vectors[:, real], residual[real]
        projection = vectors / np.sqrt(values)
        width = len(values) + 1
        schema = "i int, spread double, " + ", ".join(f"c{j} double" for j in range(width))
        partial = own.mapInArrow(_moments(dim, n, sums, projection), schema)
        sums_of = partial.groupBy("i").agg(F.sum("spread").alias("spread"), *(F.sum(f"c{j}").alias(f"c{j}") for j in range(width)))
        ordered = sums_of.orderBy("i").collect()
        moments = np.array([[r[f"c{j}"] for j in range(width)] for r in ordered]) / n
        off = moments[:-1, :-1] - np.outer(moments[:-1, -1], moments[:-1, -1]) - np.eye(width - 1)
        trace = ordered[0].spread / n / n / n
        models[dim] = Whitening(n, sums, projection, (values / trace).tolist() if trace else [], residual.tolist(), float(np.abs(off).max(initial=0.0)))
    return models


def _whitener(models: Broadcast):
    @F.arrow_udf(_RESULT)
    def run(vectors: pa.Array) -> pa.Array:
        out: list[dict | None] = [None] * len(vectors)
        for rows, levels in _levels(vectors):
            for at in range(0, len(rows), 4096):
                model = models.value[levels.shape[1]]
                scaled = _scaled(levels[at : at + 4096], model.n, model.sums)
                projected = (scaled / model.n).astype(np.float64) @ model.projection
                for row, d, w in zip(rows[at : at + 4096].tolist(), _squares(scaled), projected.tolist()):
                    out[row] = {"n": model.n, "deviation": d if d < _LONG else None, "whitened": w, "explained": model.explained, "residual": model.residual, "identity_error": model.identity_error}
        doubles = pa.list_(pa.float64())
        return pa.array(out, pa.struct([("n", pa.int64()), ("deviation", pa.int64()), ("whitened", doubles), ("explained", doubles), ("residual", doubles), ("identity_error", pa.float64())]))

    return run


OUTPUTS = ["n", "deviation", "whitened", "explained", "residual", "identity_error"]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, embedding, ...) with a usable vector, and n, deviation, whitened, explained, residual, identity_error.

    An entry c counts as the level x = floor(64 c) + 1000000. The fit list holds each distinct level vector once: n of
    them, with sums S. whitened[j] is x - S/n projected on the unit eigenvector of the fit list's covariance with the
    j-th largest eigenvalue e, over sqrt(e); explained[j] is e over the covariance's trace, residual[j] the norm of
    V v - e v. deviation is the exact sum of (n x - S)^2, null where it exceeds a long. identity_error is the largest
    absolute entry of the whitened fit list's covariance minus the identity.

    Vectors that are null, empty or hold a null or non-finite entry are dropped. Vectors of each length are a fit of
    their own, one after the other. Levels beyond 2^62 count as 2^62. Components with eigenvalue zero (up to rounding)
    do not exist, so arrays are shorter where vectors span fewer dimensions, and empty for a single distinct vector.
    Repeated vectors are fitted once and returned each. An empty table gives an empty result. Extra columns pass
    through; input columns named like an output column give way. Products are distributed passes over the stored fit
    list; the driver holds dimensions x 48 numbers.
    """
    vectors = without(vectors, OUTPUTS)
    keys = stored(vectors.select(F.col("embedding").alias("v")).mapInArrow(_keys, "dim int, key binary").distinct())
    models = {} if is_empty(keys) else fit(keys, components)
    found = _whitener(vectors.sparkSession.sparkContext.broadcast(models))
    out = vectors.withColumn("__w", found("embedding")).where("__w is not null")
    return out.withColumns({c: F.col(f"__w.{c}") for c in OUTPUTS}).drop("__w")
