"""Two-feature regressions without one or two lots, all of them at once: ridge, Huber, and their interval scales.

A fit is a parameter and the lots it does not see.  Leave-one-lot-out needs one fit per lot;
the interval scale inside a fold needs one per pair of lots, as the model that judges lot g
for fold f sees neither (and is the same for fold g and lot f).  Rows are read in place, never
copied per fit, and nothing but sums, brackets and a few values per fit is moved.  The fits of a
parameter hardly differ, so a row's residuals in all of them lie in a short interval: only rows
whose interval meets what a pass looks for are taken fit by fit, the others are counted by lot.

The robust scale of a fit is an exact median: a bracket that holds it is narrowed by counts
until few values are left inside.  From the second iteration on a median is sought around
where it was, which mostly takes one pass.  The driver holds some numbers per fit, so pairs
are for up to some hundred lots.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalars import DIVERGENCE, MAD_SCALE, Z90, inverse_transform
from emberline.registry import DEFAULT_FLOOR, REGISTRY, Registry
from emberline.session import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this module

CELLS = 1_000_000  # rows times fits held at once in a task
STEPS, STEPS_OF_FEW = 64, 4096  # of a bracket, of up to FEW fits
FEW = 8
LEFT = 64  # values of a bracket that are sorted
_SUMS = 9
BLOCK = 65_536  # rows in a row of the blocks table
PART = 400_000  # rows read by a task, about


@dataclass
class Design:
    """Numbered rows (p, lot, x0, x1, y), equal ones once with their number m, and what the numbers stand for.

    blocks: the rows by parameter, columns as bytes; total: rows per parameter.
    """

    rows: DataFrame
    blocks: DataFrame
    total: np.ndarray
    parameters: list[str]
    lots: list[str]

    @property
    def single(self) -> np.ndarray:
        return np.stack([np.arange(len(self.lots))] * 2, 1)

    @property
    def pairs(self) -> np.ndarray:
        return np.stack(np.triu_indices(len(self.lots), 1), 1)


def design(tri: DataFrame, x0: str = "u0", x1: str = "u24", y: str = "u168") -> Design:
    """Rows with a parameter, a lot and three finite numbers, written once."""
    good = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in (x0, x1, y)]
    tri = cut(tri.where(good[0] & good[1] & good[2] & F.col("lot_id").isNotNull()).select("parameter_name", "lot_id", *(F.col(c).cast("double").alias(n) for c, n in ((x0, "x0"), (x1, "x1"), (y, "y")))))
    parameters = sorted(r[0] for r in tri.select("parameter_name").distinct().collect())
    lots = sorted(r[0] for r in tri.select("lot_id").distinct().collect())
    spark = tri.sparkSession
    named = [spark.createDataFrame(list(enumerate(names)), f"{n} int, {c} string") for names, n, c in ((parameters, "p", "parameter_name"), (lots, "lot", "lot_id"))]
    rows = tri.join(F.broadcast(named[0]), "parameter_name").join(named[1], "lot_id")
    rows = rows.groupBy("p", "lot", "x0", "x1", "y").agg(F.count(F.lit(1)).alias("m"))
    rows = cut(rows)
    count, cores = rows.count(), spark.sparkContext.defaultParallelism
    parts = cores * -(-count // (PART * cores)) if count > PART else -(-count // (PART // cores))
    total = np.zeros(len(parameters), np.int64)
    for r in rows.groupBy("p").agg(F.sum("m").alias("m")).collect():
        total[r.p] = r.m
    blocks = rows.repartition(max(1, parts)).sortWithinPartitions("p").mapInArrow(_pack, _BLOCK_DDL)
    return Design(rows, cut(blocks), total, parameters, lots)


_BLOCK = pa.schema([("p", pa.int32()), *((c, pa.binary()) for c in ("lot", "x0", "x1", "y", "m"))])
_BLOCK_DDL = "p int, lot binary, x0 binary, x1 binary, y binary, m binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by parameter, some ten thousand of one parameter as one row."""

    def block(p: int, parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        return _emit(_BLOCK, [p], *([np.concatenate(column).tobytes()] for column in zip(*parts)))

    key, parts, held = None, [], 0
    for batch in batches:
        p, *columns = (c.to_numpy() for c in batch.columns)
        ends = np.append(np.flatnonzero(p[1:] != p[:-1]) + 1, len(p))
        at = 0
        for end in ends if len(p) else ():
            if parts and (p[at] != key or held >= BLOCK):
                yield block(key, parts)
                parts, held = [], 0
            key = int(p[at])
            parts.append([c[at:end] for c in columns])
            held, at = held + end - at, end
    if parts:
        yield block(key, parts)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for p, lot, x0, x1, y, m in zip(*(c.to_pylist() for c in batch.columns)):
            x0, x1, y = (np.frombuffer(c) for c in (x0, x1, y))
            yield p, np.frombuffer(lot, np.int32), np.stack([np.ones(len(y)), x0, x1], 1), y, np.frombuffer(m, np.int64)


def _some(width: int, *columns: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """A few rows at a time, so that rows times fits stay within CELLS."""
    most = max(1, CELLS // max(1, width))
    for i in range(0, len(columns[0]), most):
        yield tuple(c[i : i + most] for c in columns)


Residuals = Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _reach(coef: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the forecast of the mean fit, and how far that of any fit may lie from it, rounding included."""
    coef = coef[np.isfinite(coef).all(1)]
    if not len(coef):
        return np.zeros(len(x)), np.full(len(x), np.inf)
    middle = coef.mean(0)
    along = np.linalg.svd(coef - middle, full_matrices=False)[2]
    apart = np.abs(x @ along.T) @ np.abs((coef - middle) @ along.T).max(0)
    return x @ middle, apart * (1 + 1e-9) + 1e-12 * (np.abs(x) @ np.abs(coef).max(0))


@dataclass
class FitResiduals:
    """Residual of every row (down) in every fit (across), NaN for lots the fit does not see."""

    coef: np.ndarray
    without: np.ndarray
    lots: int

    def __call__(self, p: int, lot: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        c = self.coef[p]
        r = y[:, None] - (c[:, 0] + x[:, 1, None] * c[:, 1] + x[:, 2, None] * c[:, 2])
        r[~self.seen[lot]] = np.nan
        return r

    @property
    def seen(self) -> np.ndarray:
        """Lots (down) that a fit (across) sees."""
        lot = np.arange(self.lots)[:, None]
        return (lot != self.without[:, 0]) & (lot != self.without[:, 1])

    def bounds(self, p: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An interval per row that holds its value in every fit."""
        f, apart = _reach(self.coef[p], x)
        apart = apart + 1e-12 * np.abs(y)
        return y - f - apart, y - f + apart


@dataclass
class NestedResiduals:
    """Residual of every row in the model that sees neither its lot nor the fold's (across); NaN for rows of the fold."""

    coef: np.ndarray
    at: np.ndarray

    def __call__(self, p: int, lot: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        own = self.coef[p][self.at[lot]]  # rows x folds x coefficients
        r = y[:, None] - (own[..., 0] + x[:, 1, None] * own[..., 1] + x[:, 2, None] * own[..., 2])
        r[np.arange(len(lot)), lot] = np.nan
        return r

    @property
    def seen(self) -> np.ndarray:
        return ~np.eye(len(self.at), dtype=bool)

    bounds = FitResiduals.bounds


@dataclass
class Distances:
    """Distance of the residuals from a centre per fit."""

    residuals: FitResiduals | NestedResiduals
    centre: np.ndarray

    def __call__(self, p: int, lot: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.abs(self.residuals(p, lot, x, y) - self.centre[p])

    @property
    def seen(self) -> np.ndarray:
        return self.residuals.seen

    def bounds(self, p: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.residuals.bounds(p, x, y)
        centre = self.centre[p][np.isfinite(self.centre[p])]
        if not len(centre):
            return np.zeros(len(x)), np.full(len(x), np.inf)
        low, high = low - centre.max(), high - centre.min()
        return np.maximum(0.0, np.maximum(low, -high)), np.maximum(high, -low)


@dataclass
class Common:
    """One value per row for all fits of a parameter, the middle of its interval, in four columns."""

    values: FitResiduals | NestedResiduals | Distances

    def __call__(self, p: int, lot: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = self.values.bounds(p, x, y)
        return np.stack([(low + high) / 2] * 4, 1)


def _asked(values: Residuals, p: int, lot: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray | int]:
    """Rows that may be inside the bracket of a fit, and per fit the number of all others below."""
    if not hasattr(values, "bounds"):
        return np.arange(len(lot)), 0
    least, most = values.bounds(p, x, y)
    under = most < low.min()
    seen = values.seen
    below = np.bincount(lot[under], m[under], len(seen)) @ seen
    return np.flatnonzero(~under & (least <= high.max())), below.astype(np.int64)


def _emit(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _weigher(residuals: FitResiduals, delta: np.ndarray | None, shape: tuple[int, int], schema: pa.Schema):
    """Per split, parameter and fit the nine sums of rows weighted 1, or delta / |r| beyond delta."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((*shape, _SUMS)), residuals.seen
        for p, lot, x, y, m in _blocks(batches):
            a, b = x[:, 1], x[:, 2]
            terms = np.stack([x[:, 0], a, b, y, a * a, a * b, b * b, a * y, b * y], 1) * m[:, None]
            plain = np.ones(len(y), bool)
            if delta is not None:
                known = delta[p][np.isfinite(delta[p])]
                if not len(known):
                    continue
                low, high = residuals.bounds(p, x, y)
                plain = np.maximum(high, -low) <= known.min()  # weighted 1 in every fit
            per = np.stack([np.bincount(lot[plain], terms[plain, i], len(seen)) for i in range(_SUMS)], 1)
            total[p] += seen.T @ per
            for lot_, x_, y_, terms_ in _some(shape[1], lot[~plain], x[~plain], y[~plain], terms[~plain]):
                r = np.abs(residuals(p, lot_, x_, y_))
                w = np.where(np.isnan(r), 0.0, np.where(r <= delta[p], 1.0, delta[p] / np.maximum(r, 1e-12)))
                total[p] += w.T @ terms_
        p, fit = np.nonzero(total[:, :, 0])
        yield _emit(schema, p, fit, *total[p, fit].T)

    return run


def _spanner(values: Residuals, shape: tuple[int, int], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, n = np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(shape, np.int64)
        for p, *columns in _blocks(batches):
            for lot, x, y, m in _some(shape[1], *columns):
                v = values(p, lot, x, y)
                seen = ~np.isnan(v)
                low[p] = np.minimum(low[p], np.where(seen, v, np.inf).min(0))
                high[p] = np.maximum(high[p], np.where(seen, v, -np.inf).max(0))
                n[p] += m @ seen
        p, fit = np.nonzero(n)
        yield _emit(schema, p, fit, np.zeros(len(p)), n[p, fit], low[p, fit], high[p, fit], n[p, fit])

    return run


def _steps(low: np.ndarray) -> int:
    return STEPS_OF_FEW if low.shape[1] <= FEW else STEPS


def _counter(values: Residuals, low: np.ndarray, high: np.ndarray, schema: pa.Schema):
    """Per split, parameter, fit and step of the bracket: rows, least and largest value, distinct rows; step -1 is below the bracket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = _steps(low)
        shape = (*low.shape, steps + 1)
        n, d, least, most = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
        for p, *columns in _blocks(batches):
            if not np.isfinite(low[p]).any():
                continue
            near, below = _asked(values, p, *columns, low[p], high[p])
            n[p, :, 0] += below
            for lot, x, y, m in _some(low.shape[1], *(c[near] for c in columns)):
                v = values(p, lot, x, y)
                row, fit = np.nonzero(v <= high[p])
                v = v[row, fit]
                part = (v - low[p, fit]) / (high[p, fit] - low[p, fit]) * steps
                step = np.where(v < low[p, fit], 0, 1 + np.clip(part, 0, steps - 1).astype(np.int64))
                cell = fit * (steps + 1) + step
                n[p] += np.bincount(cell, m[row], minlength=n[p].size).reshape(n[p].shape).astype(np.int64)
                d[p] += np.bincount(cell, minlength=n[p].size).reshape(n[p].shape)
                np.minimum.at(least[p].reshape(-1), cell, v)
                np.maximum.at(most[p].reshape(-1), cell, v)
        p, fit, step = np.nonzero(n)
        yield _emit(schema, p, fit, step - 1, n[p, fit, step], least[p, fit, step], most[p, fit, step], d[p, fit, step])

    return run


def _taker(values: Residuals, low: np.ndarray, high: np.ndarray, schema: pa.Schema):
    """Per split: (p, fit, null, rows below the bracket) and (p, fit, value, rows of it) inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = np.zeros(low.shape, np.int64)
        for p, *columns in _blocks(batches):
            if not np.isfinite(low[p]).any():
                continue
            near, under = _asked(values, p, *columns, low[p], high[p])
            below[p] += under
            for lot, x, y, m in _some(low.shape[1], *(c[near] for c in columns)):
                v = values(p, lot, x, y)
                below[p] += m @ (v < low[p])
                row, fit = np.nonzero((v >= low[p]) & (v <= high[p]))
                if len(row):
                    pairs, which = np.unique(np.stack([fit.astype(float), v[row, fit]], 1), axis=0, return_inverse=True)
                    n = np.bincount(which.reshape(-1), m[row]).astype(np.int64)
                    yield _emit(schema, np.full(len(n), p), pairs[:, 0].astype(np.int32), pairs[:, 1], n)
        p, fit = np.nonzero(below)
        yield _emit(schema, p, fit, [None] * len(p), below[p, fit])

    return run


_CELL = pa.schema([("p", pa.int32()), ("fit", pa.int32()), ("step", pa.int32()), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("d", pa.int64())])
_VALUE = pa.schema([("p", pa.int32()), ("fit", pa.int32()), ("value", pa.float64()), ("n", pa.int64())])
_SUM = pa.schema([("p", pa.int32()), ("fit", pa.int32()), *((f"s{i}", pa.float64()) for i in range(_SUMS))])
_DDL = {
    "cell": "p int, fit int, step int, n long, low double, high double, d long",
    "value": "p int, fit int, value double, n long",
    "sum": "p int, fit int, " + ", ".join(f"s{i} double" for i in range(_SUMS)),
}


def _table(df: DataFrame) -> list[np.ndarray]:
    found = df.toArrow()
    return [found.column(c).to_numpy() for c in found.column_names]


def _sums(d: Design, residuals: FitResiduals, delta: np.ndarray | None, shape: tuple[int, int]) -> np.ndarray:
    found = d.blocks.mapInArrow(_weigher(residuals, delta, shape, _SUM), _DDL["sum"]).groupBy("p", "fit").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(_SUMS)))
    p, fit, *s = _table(found)
    out = np.zeros((*shape, _SUMS))
    out[p, fit] = np.stack(s, 1) if len(p) else 0
    return out


def _solve(s: np.ndarray, lam: float) -> np.ndarray:
    """Coefficients by fit from the nine sums, the intercept free; NaN where fewer than three rows were seen."""
    a = np.stack([s[..., [0, 1, 2]], s[..., [1, 4, 5]], s[..., [2, 5, 6]]], -2) + np.diag([0.0, lam, lam])
    few = s[..., 0] <= 0
    a[few] = np.eye(3)
    out = np.linalg.solve(a, s[..., [3, 7, 8], None])[..., 0]
    out[few] = np.nan
    return out


@dataclass
class Median:
    """Middle values per (parameter, fit), with the half width of a bracket that holds few values, and of one to look in next."""

    value: np.ndarray
    width: np.ndarray
    reach: np.ndarray


def _medians(d: Design, values: Residuals, n: np.ndarray, guess: Median | None = None, ranks: tuple[np.ndarray, np.ndarray] | None = None) -> Median:
    """Exact medians of the rows' values per parameter and fit; n: their counts, zero where no median is asked for.

    ranks: the two places in order, from 0, whose mean is taken instead of the middle ones.
    """
    first, second = ranks or ((n - 1) // 2, n // 2)
    low, high = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
    found, width = np.full(n.shape, np.nan), np.zeros(n.shape)
    missing = n > 0
    if guess is not None:
        low = np.where(missing, guess.value - guess.width, np.inf)
        high = np.where(missing, guess.value + guess.width, -np.inf)
        missing &= ~_settle(d, values, low, high, first, second, found, width)
        look = missing & (guess.reach > guess.width)
        if look.any():
            low, high = np.where(look, guess.value - guess.reach, np.inf), np.where(look, guess.value + guess.reach, -np.inf)
            missing &= ~_narrow(d, values, low, high, first, second, found, width)
    reach = np.zeros(n.shape) if guess is None else guess.width.copy()
    if missing.any() and hasattr(values, "bounds"):
        for low, high in _around(d, values, n, missing):
            low, high = np.where(missing, low, np.inf), np.where(missing, high, -np.inf)
            if (low < high).any():
                reach = np.where(low < high, (high - low) / 2, reach)
                missing &= ~_narrow(d, values, low, high, first, second, found, width)
    if missing.any():
        cells = d.blocks.mapInArrow(_spanner(values, n.shape, _CELL), _DDL["cell"]).groupBy("p", "fit").agg(F.min("low"), F.max("high"))
        p, fit, lo, hi = _table(cells)
        low[...], high[...] = np.inf, -np.inf
        low[p, fit], high[p, fit] = lo, hi
        low[~missing], high[~missing] = np.inf, -np.inf
        _narrow(d, values, low, high, first, second, found, width)
    return Median(found, width, reach)


def _around(d: Design, values: FitResiduals | NestedResiduals | Distances, n: np.ndarray, asked: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Brackets around the median of one common value per row: as far as lots that are alike, and as any lots, may move it."""
    total = np.where(asked.any(1), d.total, 0)
    out = np.maximum(0, d.total - np.where(asked, n, d.total[:, None]).min(1))  # rows that a fit does not see
    shares = [s for far in (3 * np.sqrt(out) + 32, out / 2 + 0.005 * d.total) for s in (-far, far)]
    place = np.clip(np.stack([d.total / 2 + s for s in shares], 1), 0, np.maximum(0, d.total - 1)[:, None]).astype(np.int64)
    at = _medians(d, Common(values), np.repeat(total[:, None], 4, 1), ranks=(place, place)).value
    found = []
    for lo, hi in (at[:, :2].T, at[:, 2:].T):
        pad = 0.25 * (hi - lo)
        good = asked & (pad > 0)[:, None]
        found.append((np.where(good, (lo - pad)[:, None], np.inf), np.where(good, (hi + pad)[:, None], -np.inf)))
    return found


def _narrow(d: Design, values: Residuals, low: np.ndarray, high: np.ndarray, first: np.ndarray, second: np.ndarray, found: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Narrows brackets (low above high: none) by counts until few values are left inside and reads the medians off;
    says where they were found, which is everywhere but where a bracket did not hold its middle ranks."""
    low, high = low.copy(), high.copy()
    done = low == high  # a single value
    found[done] = low[done]
    low[done], high[done] = np.inf, -np.inf
    inside, steps = np.where(low < high, LEFT + 1, 0), _steps(low)
    while (wide := (inside > LEFT) & (low < high)).any():
        cells = d.blocks.mapInArrow(_counter(values, np.where(wide, low, np.inf), np.where(wide, high, -np.inf), _CELL), _DDL["cell"])
        p, fit, step, count, lo, hi, several = _table(cells.groupBy("p", "fit", "step").agg(F.sum("n"), F.min("low"), F.max("high"), F.sum("d")))
        grid, distinct = np.zeros((*low.shape, steps + 1), np.int64), np.zeros((*low.shape, steps + 1), np.int64)
        lows, highs = np.full(grid.shape, np.inf), np.full(grid.shape, -np.inf)
        grid[p, fit, step + 1], lows[p, fit, step + 1], highs[p, fit, step + 1], distinct[p, fit, step + 1] = count, lo, hi, several
        upto = grid.cumsum(-1)
        for q, f in zip(*np.nonzero(wide)):
            a, b = (int(np.searchsorted(upto[q, f], k[q, f], side="right")) for k in (first, second))
            if a == 0 or b > steps:
                low[q, f], high[q, f], inside[q, f] = np.inf, -np.inf, 0
            elif a != b:  # neighbours in order: the last value of one step and the first of the other
                lower, upper = highs[q, f, a], lows[q, f, b]
                found[q, f] = (lower + upper) / 2
                width[q, f] = max(2 * (upper - lower), abs(found[q, f]) * 1e-9, 1e-12)
                done[q, f], low[q, f], high[q, f], inside[q, f] = True, np.inf, -np.inf, 0
            else:
                low[q, f], high[q, f] = lows[q, f, a], highs[q, f, a]
                inside[q, f] = distinct[q, f, a]
    one = low == high
    found[one] = low[one]
    done |= one
    rest = low < high
    if rest.any():
        done |= _settle(d, values, np.where(rest, low, np.inf), np.where(rest, high, -np.inf), first, second, found, width)
    return done


def _settle(d: Design, values: Residuals, low: np.ndarray, high: np.ndarray, first: np.ndarray, second: np.ndarray, found: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Reads the medians off the values inside the brackets; says where both middle ranks lay inside."""
    p, fit, value, n = _table(d.blocks.mapInArrow(_taker(values, low, high, _VALUE), _DDL["value"]).groupBy("p", "fit", "value").agg(F.sum("n")))
    order = np.lexsort((np.nan_to_num(value, nan=-np.inf), fit, p))  # null, the rows below, comes first
    p, fit, value, n = p[order], fit[order], value[order].astype(float), n[order]
    done = np.zeros(low.shape, bool)
    starts = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (fit[1:] != fit[:-1]))) if len(p) else []
    for a, b in zip(starts, [*starts[1:], len(p)]):
        q, f = p[a], fit[a]
        upto = np.cumsum(n[a:b])
        i, j = (np.searchsorted(upto, k[q, f], side="right") for k in (first, second))
        if j < b - a and not np.isnan(value[a + i]):
            found[q, f] = (value[a + i] + value[a + j]) / 2
            inside = value[a:b][~np.isnan(value[a:b])]
            # a bracket for the next search: as wide as some dozen values here, at most twice as wide as this one
            width[q, f] = max((inside[-1] - inside[0]) * min(2.0, 2 * LEFT / max(1, len(inside))), abs(found[q, f]) * 1e-9, 1e-12)
            done[q, f] = True
    return done


def _scale(d: Design, residuals: FitResiduals | NestedResiduals, n: np.ndarray, floors: np.ndarray, guess: tuple[Median, Median] | None = None) -> tuple[np.ndarray, tuple[Median, Median]]:
    """max(1.4826 MAD, floor) of the residuals per parameter and fit."""
    middle = _medians(d, residuals, n, guess and guess[0])
    spread = _medians(d, Distances(residuals, middle.value), n, guess and guess[1])
    return np.maximum(MAD_SCALE * spread.value, floors[:, None]), (middle, spread)


def _floors(d: Design, reg: Registry) -> np.ndarray:
    known = {p.name: p.floor for p in reg.parameters}
    return np.array([known.get(p, DEFAULT_FLOOR) for p in d.parameters])


@dataclass
class Fits:
    """Coefficients (parameter, fit, 3) with rounds and whether they stood still."""

    coef: np.ndarray
    rounds: np.ndarray
    converged: np.ndarray


def ridge_fits(d: Design, without: np.ndarray, lam: float = 1.0) -> tuple[Fits, np.ndarray]:
    """Ridge of every fit, and the rows it sees."""
    shape = (len(d.parameters), len(without))
    s = _sums(d, FitResiduals(np.zeros((*shape, 3)), without, len(d.lots)), None, shape)
    return Fits(_solve(s, lam), np.zeros(shape, int), np.ones(shape, bool)), s[..., 0].astype(np.int64)


def huber_fits(d: Design, without: np.ndarray, lam: float = 1.0, scale: float = 1.345, max_iter: int = 50, tol: float = 1e-6, reg: Registry = REGISTRY) -> Fits:
    """Huber regression of every fit by reweighting, started from ridge; a fit stops once no coefficient moves by tol."""
    start, n = ridge_fits(d, without, lam)
    floors = _floors(d, reg)
    coef, rounds, moving = start.coef, start.rounds, n > 0
    guess: tuple[Median, Median] | None = None
    for _ in range(max_iter):
        if not moving.any():
            break
        at = np.flatnonzero(moving.any(0))  # fits that move in any parameter
        residuals = FitResiduals(coef[:, at], without[at], len(d.lots))
        near = guess and tuple(Median(m.value[:, at], m.width[:, at], m.reach[:, at]) for m in guess)
        sigma, (middle, spread) = _scale(d, residuals, np.where(moving[:, at], n[:, at], 0), floors, near)
        if guess is None:
            guess = tuple(Median(np.full(n.shape, np.nan), np.zeros(n.shape), np.zeros(n.shape)) for _ in range(2))
        for kept, new in zip(guess, (middle, spread)):
            moved = np.nan_to_num(np.abs(new.value - kept.value[:, at]))
            kept.value[:, at], kept.width[:, at], kept.reach[:, at] = new.value, new.width, np.maximum(2 * moved, new.reach)
        new = _solve(_sums(d, residuals, scale * sigma, (len(coef), len(at))), lam)
        go = moving[:, at]
        moved = np.abs(new - coef[:, at]).max(-1)
        coef[:, at] = np.where(go[..., None], new, coef[:, at])
        rounds[:, at] += go
        moving[:, at] = go & ~(moved < tol)
    return Fits(coef, rounds, ~moving)


def nested_sigma(d: Design, pairs: Fits, n: np.ndarray, reg: Registry = REGISTRY) -> np.ndarray:
    """Per parameter and fold: robust scale of the residuals of all other lots, each from the model without both lots."""
    lots = len(d.lots)
    at = np.zeros((lots, lots), np.int64)
    for i, (a, b) in enumerate(d.pairs):
        at[a, b] = at[b, a] = i
    floors = _floors(d, reg)
    return _scale(d, NestedResiduals(pairs.coef, at), n, floors)[0]


def held_out_coefficients(d: Design, model: str, nested: bool = True, lam: float = 1.0, reg: Registry = REGISTRY) -> DataFrame:
    """H4, P10: parameter_name, lot_id, model, b0, b1, b2, sigma_eff, iterations, converged of the model without the lot.

    ``model`` is ridge or huber. With ``nested`` the interval scale comes from the residuals of the fold's own
    leave-one-lot-out models; with fewer than three lots, or without, it is the noise floor.
    """
    fit = (lambda w: ridge_fits(d, w, lam)[0]) if model == "ridge" else (lambda w: huber_fits(d, w, lam, reg=reg))
    n = ridge_fits(d, d.single, lam)[1]
    single = fit(d.single)
    floors = _floors(d, reg)
    sigma = nested_sigma(d, fit(d.pairs), n, reg) if nested and len(d.lots) > 2 else np.repeat(floors[:, None], len(d.lots), 1)
    rows = [
        (d.parameters[p], d.lots[f], model, *map(float, single.coef[p, f]), float(sigma[p, f]), int(single.rounds[p, f]), bool(single.converged[p, f]))
        for p, f in zip(*np.nonzero(n > 0))
    ]
    ddl = "parameter_name string, lot_id string, model string, b0 double, b1 double, b2 double, sigma_eff double, iterations int, converged boolean"
    return d.rows.sparkSession.createDataFrame(rows, ddl)


def bounded_forecast(df: DataFrame, reg: Registry = REGISTRY) -> DataFrame:
    """Predicted, lower and upper from b0, b1, b2 and sigma_eff; a diverged forecast is the 24 h reading with no width."""
    u = F.expr("b0 + b1 * u0 + b2 * u24")
    df = df.withColumn("u_hat", u)
    y, lo, hi = (inverse_transform("parameter_name", F.col("u_hat") + F.lit(k) * F.col("sigma_eff"), reg) for k in (0.0, -Z90, Z90))
    df = df.withColumns({"__y": y, "__lo": lo, "__hi": hi})
    sound = F.coalesce(F.abs("u_hat") <= DIVERGENCE, F.lit(False)) & F.col("__y").isNotNull() & F.col("__lo").isNotNull() & F.col("__hi").isNotNull()
    df = df.withColumn("divergent", ~sound)

    def told(c):
        return F.when(F.col("divergent"), F.col("v24")).otherwise(c)

    df = df.withColumns({"predicted": told(F.col("__y")), "lower": told(F.least("__lo", "__hi")), "upper": told(F.greatest("__lo", "__hi"))})
    return df.drop("__y", "__lo", "__hi")


def held_out_forecasts(tri: DataFrame, models: Sequence[str] = ("ridge", "huber"), nested: bool = True, reg: Registry = REGISTRY) -> DataFrame:
    """H4: rows of ``tri`` (u0, u24, u168, v0, v24, v168) once per model, forecast by the model that did not see their lot.

    Besides ``models`` there are the two arms without training: carry (the 24 h reading) and two_point (its line through
    0 h and 24 h); they have no interval.
    """
    d = design(tri)
    coef = [held_out_coefficients(d, m, nested, reg=reg).drop("iterations", "converged") for m in models]
    trained = coef[0]
    for c in coef[1:]:
        trained = trained.unionByName(c)
    cols = [c for c in tri.columns if c not in ("b0", "b1", "b2", "sigma_eff", "model")]
    out = bounded_forecast(tri.select(*cols).join(F.broadcast(trained), ["parameter_name", "lot_id"]), reg)
    shown = [*cols, "model", "predicted", "lower", "upper", "divergent"]
    out = out.select(*shown)
    for name, value in (("carry", F.col("v24")), ("two_point", 7 * F.col("v24") - 6 * F.col("v0"))):
        none = F.lit(None).cast("double")
        plain = tri.select(*cols, F.lit(name).alias("model"), value.alias("predicted"), none.alias("lower"), none.alias("upper"), F.lit(False).alias("divergent"))
        out = out.unionByName(plain.select(*shown))
    return out
