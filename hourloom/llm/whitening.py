"""Principal components and whitening of vectors by a block Jacobi-Davidson method over distributed centred products.

The covariance is never formed. A product V u is one Spark job over packed blocks of the vectors: every task centres its rows, multiplies, and sends the
sums of its rows; the driver holds only arrays of (dimension x search space), which do not grow with the rows. Each round
projects V on the search space (Rayleigh-Ritz), locks the leading pairs whose residual is at double precision, and widens the space by solutions of the
correction equations (I-QQ')(V-eI)(I-QQ')t = -r. They are solved for all open pairs side by side by a few steps of MINRES, one product a step. When the
space is full, pairs are exact up to rounding. Equal eigenvalues get orthogonal vectors of their common space.

Nulls: a missing vector, or one with a missing, NaN or infinite entry, is left out; a missing vec_id is kept. Repeated vectors count each time. A table without
vectors gives no rows. Vectors of different lengths are an error. Components without variance have a null `whitened`. If there are fewer dimensions than
components asked for, there are as many components as dimensions. A `deviation` beyond a long is null. Texts play no part; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourloom.llm.common import stored

SCALE, SHIFT = 64, 1_000_000
BLOCK = 2048  # vectors of a packed block
INNER_STEPS = 6
RESIDUAL = 64 * np.finfo(float).eps  # of the largest eigenvalue
FLAT = 1e-12  # of the trace: no variance
LONG = 2**63 - 1


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            lists = part.column("vector")
            lengths = np.diff(lists.offsets.to_numpy())
            if lengths.min() != lengths.max():
                raise ValueError("vectors have different lengths")
            whole = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * SCALE)
            if len(whole) and np.abs(whole).max() > 2**62:
                raise ValueError("a scaled entry does not fit a long")
            whole = whole.astype(np.int64)
            kind = next(t for t in ("i1", "i2", "i4", "i8") if not len(whole) or (whole.astype(t) == whole).all())
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("vec_id"))
            columns = [ids, pa.array([kind]), pa.array([int(lengths[0])], pa.int32()), pa.array([whole.astype(kind).tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "kind", "width", "cells"])


def packed(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The usable vectors as blocks (ids, kind, width, cells): floor(64 c) in the fewest bytes that hold a block's numbers. Written once."""
    v = F.col(column).cast("array<double>")
    usable = vectors.select("vec_id", v.alias("vector")).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return stored(usable.mapInArrow(_pack, f"ids array<{kind}>, kind string, width int, cells binary"), "vectors")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        kinds, widths, cells = (batch.column(c) for c in ("kind", "width", "cells"))
        for i in range(batch.num_rows):
            width = widths[i].as_py()
            yield np.frombuffer(cells[i].as_buffer(), kinds[i].as_py()).reshape(-1, width) if width else np.zeros((0, 0))


def _summed(blocks: DataFrame, of_rows: Callable[[np.ndarray], np.ndarray], size: int, whole: bool = False) -> list:
    """Sums over all rows of an array of `size` numbers that `of_rows` gives for a block: added up in the task, then by position."""

    def run(batches):
        total = np.zeros(size, np.int64 if whole else float)
        for rows in _rows(batches):
            total += of_rows(rows).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["at", "value"])

    kind = "bigint" if whole else "double"
    sums = blocks.select("kind", "width", "cells").mapInArrow(run, f"at int, value {kind}").groupBy("at").agg(F.sum("value").alias("value"))
    out = [0] * size
    for x in sums.collect():  # `size` rows
        out[x.at] = x.value
    return out


@dataclass(frozen=True)
class Components:
    n: int
    sums: list[int]  # of floor(64 c), per dimension
    mean: np.ndarray
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # one column per component
    residuals: np.ndarray

    @property
    def projection(self) -> np.ndarray:
        """Columns that whiten; zero where there is no variance."""
        real = self.values > FLAT * max(self.trace, 0.0)
        return self.vectors * np.where(real, 1 / np.sqrt(np.where(real, self.values, 1.0)), 0.0)


def _orthonormal(new: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The part of `new` that is orthogonal to `basis`, as orthonormal columns; what is nearly dependent goes."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
    for _ in range(2):
        new = new - basis @ (basis.T @ new)
        left, strength, _ = np.linalg.svd(new, full_matrices=False)
        new = left[:, strength > 1e-10 * max(float(strength[0]), 1e-300)] if strength.size and strength[0] > 1e-12 else left[:, :0]
    return new


def _corrections(product, q: np.ndarray, values: np.ndarray, residual: np.ndarray, steps: int) -> np.ndarray:
    """MINRES, all columns in step: the t orthogonal to q with the least residual of (V-e)t = -r over a Krylov space of `steps` dimensions."""
    project = lambda x: x - q @ (q.T @ x)
    start = project(-residual)
    norm = np.linalg.norm(start, axis=0)
    live = np.maximum(norm, 1e-300)
    basis = [start / live]
    diagonal, side = [], []
    for _ in range(steps):
        w = project(product(basis[-1]) - basis[-1] * values)
        if side:
            w -= basis[-2] * side[-1]
        diagonal.append((basis[-1] * w).sum(axis=0))
        w -= basis[-1] * diagonal[-1]
        side.append(np.linalg.norm(w, axis=0))
        basis.append(w / np.maximum(side[-1], 1e-300))
    out = np.zeros_like(start)
    for k in range(start.shape[1]):
        t = np.zeros((steps + 1, steps))
        for s in range(steps):
            t[s, s], t[s + 1, s] = diagonal[s][k], side[s][k]
            if s:
                t[s - 1, s] = side[s - 1][k]
        goal = np.zeros(steps + 1)
        goal[0] = norm[k]
        weights = np.linalg.lstsq(t, goal, rcond=None)[0]
        out[:, k] = sum(weights[s] * basis[s][:, k] for s in range(steps))
    return out


def leading(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues (falling), unit eigenvectors and residual norms of the `wanted` largest pairs of a symmetric operator given by its products."""
    wanted = min(wanted, size)
    locked = np.zeros((size, 0))
    values, residuals = [], []
    if not wanted:
        return np.array(values), locked, np.array(residuals)
    random = np.random.default_rng(seed)
    space = np.linalg.qr(random.standard_normal((size, min(wanted + 4, size))))[0]
    image = product(space)
    widest = min(size, max(4 * wanted, 64))
    stuck = 0
    while True:
        small = space.T @ image
        ritz, turn = np.linalg.eigh((small + small.T) / 2)
        ritz, turn = ritz[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        open_pairs = wanted - len(values)
        ahead = min(open_pairs, len(ritz))
        wrong = image[:, :ahead] - space[:, :ahead] * ritz[:ahead]
        wrong -= locked @ (locked.T @ wrong)
        norms = np.linalg.norm(wrong, axis=0)
        largest = max([abs(v) for v in values] + [abs(float(ritz[0])), 1e-300])
        full = space.shape[1] + locked.shape[1] >= size
        ready = np.full(ahead, True) if full or stuck > 3 else norms <= RESIDUAL * largest
        lock = int(np.argmin(ready)) if not ready.all() else ahead  # leading pairs only, so none is passed over
        stuck = 0 if lock else stuck + int(float(norms[0]) <= 1e3 * RESIDUAL * largest)  # rounding may end above the bound
        locked = np.hstack([locked, space[:, :lock]])
        values += ritz[:lock].tolist()
        residuals += norms[:lock].tolist()
        space, image, wrong, ritz = space[:, lock:], image[:, lock:], wrong[:, lock:], ritz[lock:]
        if len(values) == wanted:
            break
        if space.shape[1] + open_pairs > widest:  # restart from the best vectors
            keep = max(2 * open_pairs, 8)
            space, image = space[:, :keep], image[:, :keep]
        ahead -= lock
        if ahead:
            fix = _corrections(product, np.hstack([locked, space[:, :ahead]]), ritz[:ahead], wrong, INNER_STEPS)
        else:
            fix = random.standard_normal((size, open_pairs))
        fresh = _orthonormal(fix, np.hstack([locked, space]))
        if not fresh.shape[1]:
            fresh = _orthonormal(random.standard_normal((size, 1)), np.hstack([locked, space]))
        space, image = np.hstack([space, fresh]), np.hstack([image, product(fresh)])
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], locked[:, order], np.array(residuals)[order]


def fit(blocks: DataFrame, wanted: int = 32) -> Components | None:
    """Leading components of the covariance of all packed vectors (divisor n); None if there are none."""
    widths = blocks.agg(F.min("width").alias("low"), F.max("width").alias("high")).first()
    if widths.low is None:
        return None
    if widths.low != widths.high:
        raise ValueError("vectors have different lengths")
    size = widths.high
    first = lambda rows: np.append(rows.sum(axis=0, dtype=np.int64), len(rows))
    *sums, n = _summed(blocks, first, size + 1, whole=True)
    mean = np.array([s / n for s in sums])
    trace = sum(_summed(blocks, lambda rows: ((rows - mean) ** 2).sum(axis=0), size)) / n

    def product(u: np.ndarray) -> np.ndarray:
        def of_rows(rows):
            centred = rows - mean
            return centred.T @ (centred @ u)

        return np.array(_summed(blocks, of_rows, u.size)).reshape(u.shape) / n

    values, vectors, residuals = leading(product, size, wanted)
    return Components(n, sums, mean, trace, values, vectors, residuals)


def identity_error(blocks: DataFrame, model: Components) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the components that have variance."""
    turn = model.projection
    k = turn.shape[1]

    def of_rows(rows):
        white = (rows - model.mean) @ turn
        return np.append((white.T @ white).ravel(), white.sum(axis=0))

    sums = np.array(_summed(blocks, of_rows, k * k + k)) / model.n
    centre = sums[k * k :]
    off = sums[: k * k].reshape(k, k) - np.outer(centre, centre) - np.eye(k)
    real = (turn != 0).any(axis=0)
    return float(np.abs(off[np.ix_(real, real)]).max()) if real.any() else 0.0


def _deviations(rows: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 in whole numbers; the shift of x falls out of the difference."""
    most = max(int(np.abs(rows).max(initial=0)) * n + max((abs(s) for s in sums), default=0), 1)
    if most**2 * max(rows.shape[1], 1) <= LONG:
        return ((rows.astype(np.int64) * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((int(v) * n - s) ** 2 for v, s in zip(row, sums)) for row in rows.tolist()]
    return [v if v <= LONG else None for v in exact]


def whiten(blocks: DataFrame, model: Components) -> DataFrame:
    """vec_id, component, deviation, whitened, explained: one row per vector and component."""
    turn, k = model.projection, len(model.values)
    flat = ~(turn != 0).any(axis=0)
    explained = model.values / model.trace if model.trace else np.zeros(k)
    id_type = blocks.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i, rows in enumerate(_rows([batch])):
                ids = batch.column("ids")[i].values
                white = (rows - model.mean) @ turn
                each = np.repeat(np.arange(len(rows)), k)
                mask = np.tile(flat, len(rows))
                deviation = pa.array(_deviations(rows, model.n, model.sums), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), deviation.take(pa.array(each)),
                     pa.array(white.ravel(), mask=mask), pa.array(np.tile(explained, len(rows)))],
                    ["vec_id", "component", "deviation", "whitened", "explained"])

    return blocks.mapInArrow(run, f"vec_id {id_type}, component int, deviation bigint, whitened double, explained double")
