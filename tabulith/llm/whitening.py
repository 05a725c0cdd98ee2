"""Whitening of embedding vectors by an incremental eigendecomposition.

The fit list is each distinct integer vector x once; its covariance has the divisor n and is taken around the exact mean
S / n. Every task holds a spectrum (eigenvalues and vectors of the scatter it has seen) and adds centred vectors by rank-one
updates: the roots of the secular equation are found between the old eigenvalues, directions that the new vector does
not touch and equal eigenvalues are deflated, and the vectors follow from the roots. A block of more vectors than dimensions is
first turned into as many rows of the same scatter (QR), so the updates of a task grow with its blocks, not its rows.
Tasks' spectra are merged by Spark in a tree of groups of ``FAN_IN``, again by rank-one updates (each eigenvector times the root
of its eigenvalue). A pass over the fit list then projects the covariance onto the merged basis, adds the small matrices up in the
same tree, and its eigenvectors refine the basis (Rayleigh-Ritz). One more pass measures the whitened covariance.

Vectors that are null, empty, or hold a null or non-finite entry take no part, nor do vectors of another length than the most
common one (ties: the longer). An entry c becomes floor(``scale`` * c) + ``shift``; what lies beyond 2**52 is set to it. Rows with equal vectors or
ids are kept one by one. Components whose eigenvalue is zero up to rounding cannot be whitened and are left out, so one
vector, or copies of one, give no row, and an empty table gives none. ``deviation`` is null where it exceeds a long.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulith.session import cut_lineage, written_once

from .registry import query, table

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: spectra or matrices merged in one task, vectors turned into updates at once
FAN_IN = 16
BLOCK_ROWS = 4096
_LARGEST = float(1 << 52)
_EPS = np.finfo(float).eps


# --- spectra ---------------------------------------------------------------------------------------------------------

def _secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z2 / (d - m) = 0 for ascending distinct d, as (nearest d's index, distance from it)."""
    n = len(d)
    upper = np.append(d[1:], d[-1] + z2.sum())
    width = upper - d
    middle = d + width / 2
    at_middle = 1 + (z2 / (d[None, :] - middle[:, None])).sum(axis=1)
    # the function rises between poles: a negative middle puts the root into the upper half
    high = (at_middle < 0) & (np.arange(n) < n - 1)
    origin = np.where(high, np.arange(n) + 1, np.arange(n))
    gaps = d[None, :] - d[origin][:, None]
    lo = np.where(high, -width / 2, np.where(at_middle < 0, width / 2, 0.0))
    hi = np.where(high, 0.0, np.where(at_middle < 0, width, width / 2))
    t = (lo + hi) / 2
    for _ in range(80):
        value = 1 + (z2 / (gaps - t[:, None])).sum(axis=1)
        lo, hi = np.where(value < 0, t, lo), np.where(value < 0, hi, t)
        t = (lo + hi) / 2
        if (hi - lo <= 4 * _EPS * np.maximum(np.abs(t), _EPS * width)).all():
            break
    return origin, t


def rank_one_update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (ascending values, vectors in columns) of ``vectors @ diag(values) @ vectors.T + v v^T``."""
    z = vectors.T @ v
    norm2 = float(z @ z)
    if norm2 == 0.0:
        return values, vectors
    small = 8 * _EPS * max(abs(values[-1]), norm2)
    values, vectors = values.copy(), vectors.copy()
    # deflation: rotate equal eigenvalues so that only one of them is touched
    active = np.flatnonzero(np.abs(z) * np.sqrt(norm2) > small)
    last = -1
    for i in active:
        if last >= 0 and values[i] - values[last] <= small:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            a, b = vectors[:, last].copy(), vectors[:, i].copy()
            vectors[:, last], vectors[:, i] = c * a - s * b, s * a + c * b
            z[last], z[i] = 0.0, r
            values[last] = values[i] = (values[last] + values[i]) / 2
        last = i
    active = np.flatnonzero(np.abs(z) * np.sqrt(norm2) > small)
    if not len(active):  # too small to be told from rounding
        return values, vectors
    d, z2 = values[active], z[active] ** 2
    origin, t = _secular_roots(d, z2)
    # differences between old eigenvalues and roots without cancellation, then a vector that has these roots exactly
    diff = (d[:, None] - d[origin][None, :]) - t[None, :]
    diff = np.where(diff == 0, -_EPS * max(small, np.finfo(float).tiny), diff)
    gap = d[:, None] - d[None, :]
    np.fill_diagonal(gap, 1.0)
    ratio = np.abs(diff / gap)
    exact = np.sqrt(np.prod(np.where(np.isfinite(ratio), ratio, 1.0), axis=1))
    turn = (np.sign(z[active]) * exact)[:, None] / diff
    turn /= np.linalg.norm(turn, axis=0)
    values[active] = d[origin] + t
    vectors[:, active] = vectors[:, active] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


def _absorb(spectrum: tuple[np.ndarray, np.ndarray] | None, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum with the scatter of centred rows added, row by row."""
    dims = rows.shape[1]
    if len(rows) > dims:
        rows = np.linalg.qr(rows, mode="r")
    values, vectors = spectrum if spectrum is not None else (np.zeros(dims), np.eye(dims))
    for v in rows:
        values, vectors = rank_one_update(values, vectors, v)
    return values, vectors


# --- partial results -------------------------------------------------------------------------------------------------

_PART = "part long, body binary"


def _packed(part: int, *arrays: np.ndarray) -> pa.RecordBatch:
    body = np.concatenate([a.ravel() for a in arrays]).astype("<f8").tobytes()
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([body], pa.binary())], names=["part", "body"])


def _merged(parts: DataFrame, join: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray | None:
    """One result of all tasks' results, merged in groups of ``FAN_IN`` over several rounds. Each is a few squares of
    dimensions large, whatever the number of rows."""
    def one(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bodies = [np.frombuffer(b, "<f8") for batch in batches for b in batch.column(1).to_pylist()]
        yield _packed(key[0].as_py(), join(bodies))

    parts = cut_lineage(parts)
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        parts = parts.select(F.expr(f"part div {FAN_IN}").alias("part"), "body").groupBy("part").applyInArrow(one, _PART)
        left = -(-left // FAN_IN)
    row = parts.first()
    return None if row is None else np.frombuffer(row.body, "<f8")


def _summed(bodies: list[np.ndarray]) -> np.ndarray:
    return np.sum(bodies, axis=0)


def _matrix(column: pa.Array, kind: str = "i8") -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[np.ndarray]:
    """Vectors in blocks of about ``BLOCK_ROWS``, put together from smaller batches."""
    held, rows = [], 0
    for batch in batches:
        for at in range(0, len(batch), BLOCK_ROWS):
            part = batch.slice(at, BLOCK_ROWS)
            held.append(_matrix(part.column(column)))
            rows += len(part)
            if rows >= BLOCK_ROWS:
                yield np.concatenate(held)
                held, rows = [], 0
    if rows:
        yield np.concatenate(held)


@dataclass
class Fit:
    """n, exact sums, eigenvalues by falling size, unit vectors in columns, trace, and the measured identity error."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, as whole numbers around the mean's whole part first, so that nothing is lost by a large shift."""
    whole = np.array([s // n for s in sums], np.int64)
    return (x - whole) - np.array([s % n / n for s in sums])


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``rows`` with their vector as longs in ``x``; rows without a whole finite vector, or of another length than most, are left out."""
    limit = F.lit(_LARGEST)
    number = lambda c: c.cast("double")
    usable = F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.exists(
        vector, lambda c: c.isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf")))
    kept = rows.where(usable)
    lengths = kept.groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    whole = F.transform(vector, lambda c: F.floor(F.greatest(-limit, F.least(limit, number(c) * scale))).cast("long") + shift)
    return kept.where(F.size(vector) == (lengths.dims if lengths else 0)).withColumn("x", whole)


def _exact_sums(fit: DataFrame, dims: int) -> tuple[int, list[int]]:
    # high and low halves are summed apart, so no sum can overflow
    low, high = F.col("c").bitwiseAND(F.lit((1 << 30) - 1)), F.shiftright("c", 30)
    found = (fit.select(F.posexplode("x").alias("i", "c")).groupBy("i")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(low).alias("low"), F.sum(high).alias("high")).collect())
    sums = [0] * dims
    for r in found:  # one row per dimension
        sums[r.i] = (r.high << 30) + r.low
    return found[0].n if found else 0, sums


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Fit over the distinct values of ``x``; None if there are none, or all are equal."""
    fit = written_once(vectors.select("x").distinct(), "fit")
    first = fit.first()
    if first is None:
        return None
    dims = len(first.x)
    n, sums = _exact_sums(fit, dims)

    def spectrum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for x in _blocks(batches, 0):
            found = _absorb(found, _centred(x, n, sums))
        if found is not None:
            yield _packed(TaskContext.get().partitionId(), *found)

    def combine(bodies: list[np.ndarray]) -> np.ndarray:
        found = None
        for body in bodies:
            values, vectors = body[:dims], body[dims:].reshape(dims, dims)
            if found is None:
                found = values, vectors
                continue
            for value, v in zip(values, vectors.T):
                if value > 0:
                    found = rank_one_update(*found, v * np.sqrt(value))
        return np.concatenate([found[0], found[1].ravel()])

    merged = _merged(fit.mapInArrow(spectrum, _PART), combine)
    basis = np.linalg.qr(merged[dims:].reshape(dims, dims)[:, ::-1])[0]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, 0):
            y = _centred(x, n, sums) @ basis
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield _packed(TaskContext.get().partitionId(), total)

    ritz = _merged(fit.mapInArrow(projected, _PART), _summed).reshape(dims, dims) / n
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    trace = float(np.trace(ritz))
    keep = min(components, int((values > dims * _EPS * max(trace, 0.0)).sum()))
    if not keep:
        return None
    found = Fit(n, sums, values[:keep], (basis @ turn)[:, :keep], trace, 0.0)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _blocks(batches, 0):
            y = found.whitened(x)
            both = np.vstack([y.T @ y, y.sum(axis=0)])
            total = both if total is None else total + both
        if total is not None:
            yield _packed(TaskContext.get().partitionId(), total)

    both = _merged(fit.mapInArrow(check, _PART), _summed).reshape(keep + 1, keep) / n
    found.error = float(np.abs(both[:keep] - np.outer(both[keep], both[keep]) - np.eye(keep)).max())
    return found


def whiten(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``."""
    schema = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    vectors = integer_vectors(rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("embedding")))
    found = fit_whitening(vectors, components)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    n, sums, keep = found.n, found.sums, len(found.values)
    explained = found.values / found.trace

    def deviations(x: np.ndarray) -> pa.Array:
        # whole numbers: in longs where the largest possible sum fits, else as Python's
        near = [s // n for s in sums]
        far = [max(abs(int(lo) - m), abs(int(hi) - m)) + 1 for lo, hi, m in zip(x.min(axis=0), x.max(axis=0), near)]
        if sum((n * f) ** 2 for f in far) < 1 << 63:
            off = n * (x - np.array(near, np.int64)) - np.array([s - n * m for s, m in zip(sums, near)], np.int64)
            return pa.array((off * off).sum(axis=1), pa.int64())
        exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = _matrix(part.column(1))
                take = pa.array(np.repeat(np.arange(len(x)), keep))
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(take), pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(take), n, np.int64)), deviations(x).take(take), pa.array(found.whitened(x).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(take), found.error))], names=[c.split()[0] for c in schema.split(", ")])

    return vectors.select("vec_id", "x").mapInArrow(run, schema)


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
