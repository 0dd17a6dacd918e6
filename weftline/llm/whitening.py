"""Whitening of embeddings: the leading eigenvectors of their covariance by Jacobi-Davidson.

The covariance is never built. Products with it run as Spark jobs: every task multiplies its centred vectors with a block
of directions and hands on one small matrix. Around these, on the driver, with matrices of (dimensions x some directions)
only: a subspace with Rayleigh-Ritz pairs; for every wanted pair that has not converged, a correction equation, projected
against the wanted directions and solved by a few steps of MINRES, all of them with the same products; leading pairs are
locked once their residual is down to rounding, and the search goes on orthogonally to them until all are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, quoted, table

#: Components; entries become floor(SCALE * c) + OFFSET; larger ones than 2^LIMIT count as that.
COMPONENTS, SCALE, OFFSET, LIMIT = 16, 64, 1_000_000, 60
#: Residual, relative to the largest eigenvalue, at which a pair is locked; variances below this share of it count as none.
TOLERANCE, NO_VARIANCE = 1e-13, 1e-12
#: Directions beyond the wanted ones, subspace in multiples of them, steps of MINRES, residual that ends them, outer rounds.
SPARE, SPAN, STEPS, EASY, ROUNDS = 4, 5, 6, 0.02, 300
#: Vectors of one packed row, and bytes that one task of a product reads.
PACK_BYTES, TASK_BYTES = 1 << 20, 64 << 20


def minres(product: Callable, theta: np.ndarray, r: np.ndarray, against: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Corrections t, one for each column of r and orthogonal to `against`, that make r + (A - theta) t smallest over the
    Krylov space of at most `steps` products; one product serves all columns."""

    def project(x: np.ndarray) -> np.ndarray:
        x = x - against @ (against.T @ x)
        return x - against @ (against.T @ x)

    r = project(r)
    size = np.linalg.norm(r, axis=0)
    k, tiny = r.shape[1], np.finfo(float).tiny
    basis = [r / np.maximum(size, tiny)]
    t = np.zeros((steps + 1, steps, k))
    best = np.zeros_like(r)
    for j in range(steps):
        w = project(product(basis[j]) - basis[j] * theta)
        full = np.linalg.norm(w, axis=0)
        for i in range(j + 1):  # the Lanczos recurrence, kept orthogonal to all earlier vectors
            h = np.sum(basis[i] * w, axis=0)
            t[i, j] += h
            w = w - basis[i] * h
        for i in range(j + 1):
            h = np.sum(basis[i] * w, axis=0)
            t[i, j] += h
            w = w - basis[i] * h
        beta = np.linalg.norm(w, axis=0)
        beta[beta <= 1e-14 * full] = 0.0
        t[j + 1, j] = beta
        left = np.zeros(k)
        for c in range(k):
            goal = np.zeros(j + 2)
            goal[0] = -size[c]
            small = t[: j + 2, : j + 1, c]
            y = np.linalg.lstsq(small, goal, rcond=None)[0]
            best[:, c] = sum(basis[i][:, c] * y[i] for i in range(j + 1))
            left[c] = np.linalg.norm(small @ y - goal)
        if np.all(left <= EASY * size) or not beta.any():
            break
        basis.append(np.where(beta > 0, w / np.where(beta > 0, beta, 1.0), 0.0))
    return best


def orthonormal(x: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of x add to the orthonormal columns of `against`."""
    for _ in range(2):
        x = x - against @ (against.T @ x)
        size = np.linalg.norm(x, axis=0)
        x = x[:, size > 0] / size[size > 0]
    if not x.shape[1]:
        return x
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    u = u[:, s > 1e-10 * s[0]]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0]


def leading(product: Callable, d: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues (falling) and unit eigenvectors of the symmetric d x d matrix that product(W) multiplies by."""
    rng = np.random.default_rng(seed)
    k, most = min(k, d), min(d, max(SPAN * k, k + 2 * SPARE))
    locked, values = np.zeros((d, 0)), np.zeros(0)
    b = np.linalg.qr(rng.standard_normal((d, min(d, k + SPARE))))[0]
    ab = product(b)
    for _ in range(ROUNDS):
        small = b.T @ ab
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        b, ab = b @ s, ab @ s
        rest = ab - b * theta
        rest -= locked @ (locked.T @ rest)
        size, scale = np.linalg.norm(rest, axis=0), max([abs(theta).max(), *values[:1]])
        good, n = size <= TOLERANCE * scale, 0
        while n < len(theta) and good[n] and len(values) + n < k:  # from the top on, so that none is passed over
            n += 1
        locked, values = np.hstack([locked, b[:, :n]]), np.concatenate([values, theta[:n]])
        b, ab, rest, theta, good = b[:, n:], ab[:, n:], rest[:, n:], theta[n:], good[n:]
        want = k - len(values)
        if not want:
            break
        open_ = np.flatnonzero(~good[:want])
        steps = minres(product, theta[open_], rest[:, open_], np.hstack([locked, b[:, :want]]))
        if b.shape[1] + len(open_) > most - len(values) and b.shape[1] + len(values) < d and most < d:
            keep = want + SPARE
            b, ab = b[:, :keep], ab[:, :keep]
        more = orthonormal(steps, np.hstack([locked, b]))
        if not more.shape[1]:  # the residuals lie within rounding of the subspace: look elsewhere, or start products anew
            more = orthonormal(rng.standard_normal((d, want)), np.hstack([locked, b])) if b.shape[1] + len(values) < d else more
            b = np.linalg.qr(b - locked @ (locked.T @ b))[0]
            ab = product(b)
        if more.shape[1]:
            b, ab = np.hstack([b, more]), np.hstack([ab, product(more)])
    else:
        raise RuntimeError(f"{k - len(values)} of {k} components have not converged")
    order = np.argsort(-values, kind="stable")
    return values[order], locked[:, order]


@dataclass
class Fitted:
    """n distinct vectors, their sums in every dimension (exact), the trace of their covariance, eigenvalues (falling), unit
    eigenvectors in columns, and how far the whitened covariance is from the identity."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def directions(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: the whole part of the mean goes in integers, so that large offsets cost no digits."""
    whole = [s // n for s in sums]
    return (x - np.array(whole, np.int64)).astype(np.float64) - np.array([(s - w * n) / n for s, w in zip(sums, whole)])


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x (array of longs) of the rows whose vector is there and has only finite entries."""
    v = F.col(quoted(vec_col)).cast("array<double>")
    fit = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    edge = F.lit(float(1 << LIMIT))
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * SCALE, edge), -edge)) + F.lit(OFFSET).cast("long"))
    return vectors.where(v.isNotNull() & fit).select(F.col(quoted(id_col)).cast("long").alias("vec_id"), whole.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of one list column (no nulls, d entries each) without a copy."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def pack(distinct: DataFrame, d: int) -> DataFrame:
    """The vectors as blocks of at most PACK_BYTES: m (rows x d longs, little-endian)."""
    rows = max(PACK_BYTES // (8 * d), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.ascontiguousarray(matrix(b.column(0), d), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + rows].tobytes() for i in range(0, len(x), rows)], pa.binary())], names=["m"])

    return distinct.select("x").mapInArrow(run, "m binary")


def summed(blocks: DataFrame, d: int, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of f(rows) over all blocks, entry by entry; what reaches the driver has the size of one f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for m in b.column(0):
                part = f(np.frombuffer(m.as_buffer(), "<i8").reshape(-1, d))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    rows = blocks.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(rows))
    for r in rows:
        out[r["at"]] = r["v"]
    return out


def sums_of(blocks: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums in every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            for m in b.column(0):
                x = np.frombuffer(m.as_buffer(), "<i8").reshape(-1, d)
                n += len(x)
                # halves of 32 bits, which cannot overflow within a block
                high, low = (x >> 32).sum(axis=0).tolist(), (x & 0xFFFFFFFF).sum(axis=0).tolist()
                total = [t + (h << 32) + v for t, h, v in zip(total, high, low)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int64()), pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))], names=["at", "v"])

    rows = {r["at"]: int(r["v"]) for r in blocks.mapInArrow(run, "at long, v decimal(38,0)").groupBy("at").agg(F.sum("v").cast("decimal(38,0)").alias("v")).collect()}
    return rows.get(-1, 0), [rows.get(i, 0) for i in range(d)]


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Fitted | None:
    """Fit on every distinct vector of quantised rows with d entries once; None if they do not vary.

    The distinct vectors are shuffled once (repeated ones are merged before) and written to the checkpoint folder in
    blocks. Every product is one pass over them: 1 + rounds x (steps + 1) passes.
    """
    blocks = cut(pack(rows.select("x").distinct(), d))
    n, sums = sums_of(blocks, d)
    if not n:
        return None
    tasks = max(math.ceil(n * d * 8 / TASK_BYTES), min(blocks.rdd.getNumPartitions(), blocks.sparkSession.sparkContext.defaultParallelism))
    blocks = blocks.coalesce(tasks)

    def product(w: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ w)

        return summed(blocks, d, part).reshape(d, -1) / n

    trace = float(summed(blocks, d, lambda x: np.array([np.square(_centred(x, n, sums)).sum()]))[0]) / n
    if trace <= 0:
        return None
    values, vectors = leading(product, d, components)
    kept = values > NO_VARIANCE * values[0]
    out = Fitted(n, sums, trace, values[kept], vectors[:, kept], 0.0)
    to, k = out.directions(), int(kept.sum())

    def spread(x: np.ndarray) -> np.ndarray:
        y = _centred(x, n, sums) @ to
        return np.concatenate([y.sum(axis=0), (y.T @ y).ravel()])

    s = summed(blocks, d, spread) / n
    # the mean is zero but for rounding, so its square can be taken off afterwards
    out.identity_error = float(np.abs(s[k:].reshape(k, k) - np.outer(s[:k], s[:k]) - np.eye(k)).max())
    return out


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond the range of a long."""
    whole = [s // n for s in sums]
    shifted, rest = x - np.array(whole, np.int64), [s - w * n for s, w in zip(sums, whole)]
    bound = float(np.abs(shifted).max(initial=0) + 1) * n
    if bound * bound * x.shape[1] < 2.0**62:
        return np.square(shifted * n - np.array(rest, np.int64)).sum(axis=1).tolist()
    out = [sum((n * v - r) ** 2 for v, r in zip(row, rest)) for row in shifted.tolist()]
    return [v if v < 1 << 63 else None for v in out]


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row with a usable vector and each component (from 1, by falling variance), as SCHEMA.

    A vector is usable if it is there, holds only finite entries and has as many as most of these have (ties: the larger
    number). Entries beyond 2^60 / 64 count as that. Each distinct vector counts once in the fit, whatever its ids; rows
    that repeat, null ids included, each give their own rows. Components without variance (fewer distinct vectors than
    components, or constant dimensions) give no rows: the others' whitened covariance is the identity. A table without two
    different usable vectors, and an empty one, gives no rows. A deviation beyond the range of a long is null. Other
    columns are not read.
    """
    spark = vectors.sparkSession
    rows = quantised(vectors, id_col, vec_col)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    rows = rows.where(F.size("x") == d)
    model = fit(rows, d, components) if d else None
    if model is None:
        return spark.createDataFrame([], SCHEMA)
    to, k = model.directions(), len(model.values)
    explained = model.values / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), d)
            y = model.centred(x) @ to
            times = np.repeat(np.arange(len(x)), k)
            columns = [b.column(0).take(pa.array(times)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(times), model.n))]
            columns += [pa.array(deviations(x, model.n, model.sums), pa.int64()).take(pa.array(times)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(times), model.identity_error))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return rows.mapInArrow(run, SCHEMA)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
