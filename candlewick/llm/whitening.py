"""Embedding whitening: a distributed centred scatter, cyclic Jacobi rotations on the driver, a broadcast matrix.

Entries are scaled to whole numbers, so that sums and scatters are exact in whatever order tasks add them: the
covariance is the same for every partitioning, rounded once from its exact fraction. What reaches the driver is one
d by d matrix for vectors of d entries (MAX_DIM bounds d); vectors never do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_batches

#: Longest vectors: a scatter of this side takes 32 MB in a task and some 200 MB on the driver.
MAX_DIM = 2048
#: Exact sums travel as two limbs, so that a sum of 64-bit squares over any number of rows fits decimals of 38 digits.
LIMB = 60
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """What a fit found: rows, exact sums of scaled entries, eigenvalues in falling order, and the projection (d by k)."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    explained: np.ndarray
    matrix: np.ndarray


def usable(vector: str) -> Column:
    """Vectors that are there and hold neither NULLs nor anything that isn't finite."""
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, bad)


def scaled(vector: str, scale: float = 1024.0) -> Column:
    """Entries as whole numbers: floor(scale * entry); beyond 64 bits the least or largest long. Shifts cancel in all that follows."""
    return F.transform(vector, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))


def _matrix(column: pa.ListArray, d: int | None = None) -> np.ndarray:
    """Rows of longs; a vector shorter than the longest is filled up with zeros."""
    offsets = column.offsets.to_numpy()
    sizes, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    d = int(sizes.max(initial=0)) if d is None else d
    if len(sizes) and (sizes == d).all():
        return flat.reshape(len(sizes), d)
    out = np.zeros((len(sizes), d), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y.T @ y without error: in doubles where no sum can leave 53 bits, else in Python's whole numbers."""
    most = int(np.abs(y).max(initial=0)) if y.dtype != object else 1 << 63
    if most * most * max(len(y), 1) < 1 << 53:
        z = y.astype(float)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T.dot(z)


def _centred(y: np.ndarray, centre: list[int]) -> np.ndarray:
    """y minus whole-numbered centres; in Python's whole numbers where 64 bits could overflow."""
    far = max(map(abs, centre), default=0) + int(np.abs(y.astype(float)).max(initial=0)) >= 1 << 62
    return (y.astype(object) if far else y) - np.array(centre, dtype=object if far else np.int64)


def _limbs(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, values = zip(*rows, strict=True) if rows else ((), (), ())
    kind = pa.decimal128(38, 0)
    high, low = [Decimal(v >> LIMB) for v in values], [Decimal(v & ((1 << LIMB) - 1)) for v in values]
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, kind), pa.array(low, kind)], names=["i", "j", "high", "low"])


def _summed(parts: DataFrame) -> dict[tuple[int, int], int]:
    """One row a task and cell, added up by cell; at most MAX_DIM squared cells."""
    total = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    return {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in total.toLocalIterator()}


def jacobi(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    A sweep meets every pair once, as rounds of disjoint pairs in round-robin order. It ends when each off-diagonal is
    within rounding of the root of its two diagonals' product, which keeps small eigenvalues accurate relative to
    themselves. Ties keep the order of their columns.
    """
    d = len(a)
    a, v = np.array(a, dtype=float), np.eye(d)
    ring = list(range(d + d % 2))
    for _ in range(sweeps):
        rotated = False
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(min(p, q), max(p, q)) for p, q in zip(ring[:half], reversed(ring[half:]), strict=True) if max(p, q) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = (np.array(x, dtype=int) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
            off = a[p, q]
            big = np.abs(off) > EPS * np.sqrt(np.abs(a[p, p] * a[q, q]))
            if not big.any():
                continue
            rotated = True
            p, q, off = p[big], q[big], off[big]
            theta = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            dp, dq = a[p, p] - t * off, a[q, q] + t * off
            a[:, p], a[:, q] = a[:, p] * c - a[:, q] * s, a[:, p] * s + a[:, q] * c
            a[p, :], a[q, :] = a[p, :] * c[:, None] - a[q, :] * s[:, None], a[p, :] * s[:, None] + a[q, :] * c[:, None]
            a[p, q] = a[q, p] = 0.0
            a[p, p], a[q, q] = dp, dq
            v[:, p], v[:, q] = v[:, p] * c - v[:, q] * s, v[:, p] * s + v[:, q] * c
        if not rotated:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    return e[order], v[:, order]


def _rank(cov: np.ndarray) -> int:
    """How many eigenvalues aren't zero: those of the correlations beyond rounding, which doesn't mistake small variances for none."""
    dev = np.sqrt(np.diag(cov))
    moves = dev > 0
    if not moves.any():
        return 0
    e, _ = jacobi(cov[np.ix_(moves, moves)] / np.outer(dev[moves], dev[moves]))
    return int((e > 8 * len(e) * EPS).sum())


def fit(vectors: DataFrame, vector: str = "embedding", components: int = 8, scale: float = 1024.0) -> Whitening:
    """The whitening of all usable vectors, by two passes: exact sums, then the scatter around whole-numbered means.

    The means' remainders are taken off as an exact fraction, so the covariance (divisor n) is that around the true means.
    """
    y = vectors.where(usable(vector)).select(scaled(vector, scale).alias("y"))
    schema = "i int, j int, high decimal(38,0), low decimal(38,0)"

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, dtype=object)
        for batch in batches:
            m = _matrix(batch.column(0))
            n += len(m)
            if m.shape[1] > MAX_DIM:
                raise ValueError(f"a vector of {m.shape[1]} entries; the longest allowed has {MAX_DIM}")
            near = m.size == 0 or int(np.abs(m.astype(float)).max()) < (1 << 62) // max(len(m), 1)
            part = (m.sum(axis=0, dtype=np.int64) if near else m.astype(object).sum(axis=0)).astype(object)
            if len(part) > len(total):
                total = np.concatenate([total, np.zeros(len(part) - len(total), dtype=object)])
            total[: len(part)] += part
        if n:
            yield _limbs([(-1, -1, n), *((i, -1, int(s)) for i, s in enumerate(total))])

    found = _summed(in_batches(y, sums, schema))
    n, d = found.pop((-1, -1), 0), len(found)
    total = [found[i, -1] for i in range(d)]
    if not n or not d:
        return Whitening(n, total, np.zeros(0), np.zeros(0), np.zeros((d, 0)))
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * c for s, c in zip(total, centre, strict=True)]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.zeros((d, d), dtype=object)
        seen = False
        for batch in batches:
            part += _exact_product(_centred(_matrix(batch.column(0), d), centre))
            seen = True
        if seen:
            yield _limbs([(i, j, int(part[i, j])) for i in range(d) for j in range(i, d)])

    cells = _summed(in_batches(y, scatter, schema))
    cov = np.zeros((d, d))
    for (i, j), s in cells.items():
        cov[i, j] = cov[j, i] = (n * s - rest[i] * rest[j]) / (n * n)
    e, v = jacobi(cov)
    rank, trace = _rank(cov), float(np.trace(cov))
    k = min(components, d)
    e = np.where(np.arange(d) < rank, e, 0.0)[:k]
    with np.errstate(divide="ignore", invalid="ignore"):
        matrix = v[:, :k] / np.sqrt(e)
    return Whitening(n, total, e, e / trace if trace else np.zeros(k), matrix)


def whiten(vectors: DataFrame, found: Whitening, vector: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """Usable rows of ``vectors`` with deviation (decimal: sum of (n*x - S)^2 over the entries, exact) and whitened (array of doubles).

    An entry of whitened whose eigenvalue is zero has no direction and is NULL; a deviation of more than 38 digits is NULL.
    Columns of these names are replaced.
    """
    spark, n, sums = vectors.sparkSession, found.n, found.sums
    d, k = found.matrix.shape
    centre = [(2 * s + n) // (2 * n) for s in sums]
    offset = np.array([(s - n * c) / n for s, c in zip(sums, centre, strict=True)])
    shared = spark.sparkContext.broadcast(np.where(np.isfinite(found.matrix), found.matrix, 0.0))
    empty = found.eigenvalues <= 0
    kept = vectors.where(usable(vector)).drop("deviation", "whitened")
    y = free_name(kept.columns, "_y")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(batch.num_columns - 1), d)
            z = _centred(m, centre)
            w = (z.astype(float) - offset) @ shared.value if d else np.zeros((len(m), 0))
            far = n * int(np.abs(z.astype(float)).max(initial=0) + 1)
            if far * far * max(d, 1) < 1 << 63:
                off = n * z.astype(np.int64) - np.array([s - n * c for s, c in zip(sums, centre, strict=True)], dtype=np.int64)
                deviation = (off * off).sum(axis=1).tolist()
            else:
                off = n * z.astype(object) - np.array([s - n * c for s, c in zip(sums, centre, strict=True)], dtype=object)
                deviation = [int(x) for x in (off * off).sum(axis=1)]
            exact = pa.array([Decimal(x) if x < 10**38 else None for x in deviation], pa.decimal128(38, 0))
            values = pa.array(w.ravel(), pa.float64(), mask=np.tile(empty, len(m)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * k, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], exact, lists], names=[*names, "deviation", "whitened"])

    schema = kept.withColumn("deviation", F.lit(None).cast("decimal(38,0)")).withColumn("whitened", F.lit(None).cast("array<double>")).schema
    return in_batches(kept.withColumn(y, scaled(vector, scale)), run, schema)


def identity_error(whitened: DataFrame, found: Whitening) -> float | None:
    """Largest absolute entry of whitened's covariance (divisor n, centred) minus the identity, over components that have a direction."""
    live = [i for i, e in enumerate(found.eigenvalues) if e > 0]
    if not live:
        return None
    at = lambda i: F.col("whitened")[i]
    r = whitened.agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i in live for j in live if i <= j]).first()
    return max(abs(r[f"c{i}_{j}"] - (i == j)) for i in live for j in live if i <= j)


def whitened_rows(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """One row per usable row of ``vectors`` and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is NULL or holds a NULL or non-finite entry are dropped; repeated rows and rows that share an id,
    or have none, each count and are returned. Vectors shorter than the longest are filled up with zeros; those of more
    than MAX_DIM entries are an error. There are as many components as entries, ``components`` at most; one without
    variance has whitened NULL and explained 0 (all of them where all vectors are equal). deviation is NULL where a
    long can't hold it. An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias(id_col), F.col(vector).alias("vector"))
    found = fit(rows, "vector", components)
    made = whiten(rows, found, "vector")
    error = identity_error(made, found)
    share = F.array(*[F.lit(float(x)) for x in found.explained]).cast("array<double>")
    return made.select(id_col, "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        id_col, (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened", F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
