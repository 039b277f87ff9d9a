"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi.

``fit`` reads the vectors twice: integer sums per dimension first, then the
scatter of the centred vectors, each summed within tasks and then by Spark.
The driver holds the scatter alone (dimension squared, whatever the rows):
``components`` factors it by pivoted Cholesky and rotates the columns of the
triangular factor until they are orthogonal.  Their squared norms are the
eigenvalues of the scatter, the normalised columns its eigenvectors.
``transform`` projects every vector; no vector crosses a shuffle.

A component c becomes the whole number floor(1024 * c) + 100000, so sums,
means and deviations are exact.  Centring subtracts whole numbers first and the
fraction of the mean after, before anything is multiplied.

Defined results: null vectors, vectors with null or non-finite components and
vectors with a whole number of 62 bits or more take no part; so do vectors whose
length is not the most frequent one (of equally frequent ones the longest) and
empty vectors.  Null ids stay null and repeated rows give repeated results.
Components of no variance do not exist: fewer than eight may come back, none for
a single vector, equal vectors or an empty table.  A deviation beyond 38 digits
is null.  The sign of a component makes its largest entry positive.  Each task and
the driver hold matrices of dimension x dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recolens.llm.frames import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
_LIMIT = 2.0 ** 62
_DEVIATION = pa.decimal128(38, 0)
ROWS = ("vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
        "explained double, identity_error double")


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) alone; further columns cannot clash."""
    kind = dict(df.dtypes)[vector_col]
    vec = F.col(vector_col) if kind in ("array<float>", "array<double>") else F.col(vector_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("embedding"))


def whole_matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, whole numbers) of the usable vectors, one matrix for each length."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]):
        rows = np.nonzero(sizes == size)[0]
        with np.errstate(over="ignore", invalid="ignore"):
            whole = np.floor(SCALE * flat[starts[rows][:, None] + np.arange(size)])
            good = (np.abs(whole) < _LIMIT).all(axis=1)
        yield rows[good], whole[good].astype(np.int64) + SHIFT


@dataclass
class Whitening:
    n: int
    sums: list[int]            # exact, per dimension
    axes: np.ndarray           # dimension x components, unit columns
    eigenvalues: np.ndarray    # of the covariance, falling
    trace: float

    def centred(self, whole: np.ndarray) -> np.ndarray:
        return centred(whole, self.n, self.sums)


def centred(whole: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n: whole parts are subtracted exactly, the fraction of the mean last."""
    mean = np.array([s // n for s in sums], dtype=np.int64)
    return (whole - mean).astype(np.float64) - np.array([s % n / n for s in sums])


def dimension_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Count and exact sums per dimension over vectors of the most frequent length."""
    schema = pa.schema([("size", pa.int32()), ("dim", pa.int32()), ("n", pa.int64()),
                        ("hi", pa.int64()), ("lo", pa.int64())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for _, whole in whole_matrices(batch.column(0)):
                at = sums.setdefault(whole.shape[1], [0, 0, 0])
                at[0] += len(whole)
                at[1] = at[1] + (whole >> 32).sum(axis=0)
                at[2] = at[2] + (whole & 0xFFFFFFFF).sum(axis=0)
        for size, (n, hi, lo) in sums.items():
            yield pa.record_batch([pa.array(np.full(size, size, np.int32)), pa.array(np.arange(size, dtype=np.int32)),
                                   pa.array(np.full(size, n, np.int64)), pa.array(hi), pa.array(lo)], schema=schema)

    totals = written(rows.select("embedding").mapInArrow(partial, "size int, dim int, n long, hi long, lo long")
                     .groupBy("size", "dim").agg(*(F.sum(c).alias(c) for c in ("n", "hi", "lo"))), "whitening-sums")
    best = totals.where("dim = 0 and n > 0").orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return 0, []
    own = totals.where(F.col("size") == best.size).orderBy("dim").collect()
    return best.n, [(r.hi << 32) + r.lo for r in own]


def scatter(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sum of outer products of the centred vectors, one partial sum a task."""
    dims = len(sums)
    schema = pa.schema([("i", pa.int32()), ("part", pa.list_(pa.float64()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims))
        for batch in batches:
            for _, whole in whole_matrices(batch.column(0)):
                if whole.shape[1] == dims:
                    c = centred(whole, n, sums)
                    total += c.T @ c
        yield pa.record_batch([pa.array(np.arange(dims, dtype=np.int32)),
                               pa.array([total[i, i:] for i in range(dims)], pa.list_(pa.float64()))], schema=schema)

    cells = (rows.select("embedding").mapInArrow(partial, "i int, part array<double>")
             .select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")))
    out = np.zeros((dims, dims))
    for r in cells.collect():
        out[r.i, r.i + r.j] = out[r.i + r.j, r.i] = r.v
    return out


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L @ L.T, largest remaining diagonal first.

    L has as many columns as ``a`` has rank: it ends where no diagonal is left
    above the rounding of the first."""
    a, size = a.copy(), len(a)
    order, low = np.arange(size), np.zeros((size, size))
    least = size * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(size):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return low[:, :k], order
        for m in (a, low):
            m[[k, p]] = m[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1:, k] = a[k + 1:, k] / low[k, k]
        a[k + 1:, k + 1:] -= np.outer(low[k + 1:, k], low[k + 1:, k])
    return low, order


def orthogonal_columns(w: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """One-sided Jacobi: rotate pairs of columns until all are orthogonal.

    A round turns disjoint pairs at once; the rounds of a sweep meet every pair
    once, as in a tournament."""
    w, size = w.copy(), w.shape[1]
    players = np.arange(size + size % 2)
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(players) - 1, 0)):
            i, j = players[:len(players) // 2], players[::-1][:len(players) // 2]
            both = (i < size) & (j < size)
            i, j = i[both], j[both]
            p, q = w[:, i], w[:, j]
            pp, qq, pq = (p * p).sum(axis=0), (q * q).sum(axis=0), (p * q).sum(axis=0)
            cosine = np.abs(pq) / np.sqrt(np.maximum(pp * qq, np.finfo(float).tiny))
            worst = max(worst, cosine.max(initial=0.0))
            turn = cosine > 1e-16
            zeta = (qq - pp) / np.where(turn, 2 * pq, 1.0)
            tan = np.where(turn, np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            cos = 1 / np.hypot(1.0, tan)
            w[:, i], w[:, j] = cos * (p - tan * q), cos * (q + tan * p)
            players[1:] = np.roll(players[1:], 1)
        if worst < 1e-15:
            break
    return w


def components(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a scatter, the ``k`` largest first."""
    low, order = pivoted_cholesky(a)
    w = orthogonal_columns(low)
    norms = np.sqrt((w * w).sum(axis=0))
    first = np.argsort(-norms, kind="stable")[:k]
    axes = np.zeros((len(a), len(first)))
    axes[order] = w[:, first] / norms[first]
    largest = np.abs(axes).argmax(axis=0) if len(first) else np.zeros(0, int)
    return norms[first] ** 2, axes * np.where(axes[largest, np.arange(len(first))] < 0, -1.0, 1.0)


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The ``k`` largest components of all usable vectors; None without any."""
    n, sums = dimension_sums(rows)
    if not n:
        return None
    a = scatter(rows, n, sums)
    values, axes = components(a, k)
    return Whitening(n, sums, axes, values / n, float(np.trace(a)) / n)


def deviations(whole: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums over dimensions of (n * x - S)^2, exact; null beyond 38 digits."""
    bound = max(n * int(np.abs(whole).max(initial=0)), max(map(abs, sums))) * 2
    if bound * bound * len(sums) < 1 << 63:
        off = n * whole - np.array(sums, dtype=np.int64)
        return pa.array((off * off).sum(axis=1)).cast(_DEVIATION)
    mean = np.array([s // n for s in sums], dtype=np.int64)
    rest = np.array([s % n for s in sums], dtype=object)
    off = whole - mean
    if (n * (int(np.abs(off).max(initial=0)) + 1)) ** 2 * len(sums) < 1 << 63:
        off = n * off - rest.astype(np.int64)
        return pa.array((off * off).sum(axis=1)).cast(_DEVIATION)
    off = n * off.astype(object) - rest
    return pa.array([Decimal(v) if v < 10 ** 38 else None for v in (off * off).sum(axis=1)], _DEVIATION)


def transform(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, whitened): the list of whitened components of each vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("deviation", _DEVIATION), ("whitened", pa.list_(pa.float64()))])
    to_unit = model.axes / np.sqrt(model.eigenvalues)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, whole in whole_matrices(batch.column(1)):
                if whole.shape[1] == len(model.sums) and len(at):
                    out = model.centred(whole) @ to_unit
                    ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                    yield pa.record_batch([batch.column(0).take(pa.array(at)), deviations(whole, model.n, model.sums),
                                           pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], schema=schema)

    return rows.mapInArrow(project, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    w = [F.col("whitened")[i] for i in range(k)]
    means = white.agg(*(F.avg(c) for c in w)).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = white.agg(*(F.avg((w[i] - F.lit(means[i])) * (w[j] - F.lit(means[j]))) for i, j in pairs)).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, cov))


def whiten(df: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component: vec_id, component, n, deviation,
    whitened, explained (share of the variance), identity_error."""
    rows = vectors(df)
    model = fit(rows, k)
    if model is None or not len(model.eigenvalues):
        return df.sparkSession.createDataFrame([], ROWS)
    white = written(transform(rows, model), "whitened")
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.eigenvalues))
    error = identity_error(white, len(model.eigenvalues))
    return (white.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
            .select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", shares[F.col("i")].alias("explained"), F.lit(error).alias("identity_error")))
