"""Embedding whitening by refined eigenvectors (operator 11).

An entry c of a vector becomes the whole number x = floor(64 c) + 1000000. Sums and the covariance of x
are added up by Spark tasks. Vectors are centred by the whole number nearest to the mean before
they are multiplied, so that products and their sums are whole numbers that doubles hold exactly,
as long as they stay below 2**53 (10**11 vectors of length one); the rest of the mean, at most one
half, is taken out afterwards. What comes to the driver is one number per pair of dimensions.

There the eigenvectors of the float32 covariance are refined by the iteration of Ogita and Aishima: with
R = I - X'X and S = X'AX the eigenvalues are l_i = s_ii / (1 - r_ii), and X moves by X E with

    e_ij = (s_ij + l_j r_ij) / (l_j - l_i),    or r_ij / 2 where l_i and l_j are too close to tell apart.

Each step doubles the correct digits. Close eigenvalues form clusters. The matrix restricted to a
cluster, less the cluster's middle, is solved by itself, where its small gaps are large, and the
vectors of the cluster are turned accordingly. Products are made of slices of few bits, so that every product of
slices is exact in double precision; their sums are kept in extended precision.

A vector counts if it holds no null, NaN or infinite entry; entries of 2**34 and more in size leave no
room for exact sums and count as infinite. All vectors have as many entries as most have (of
equally frequent lengths the longer); others miss entries, or have some to spare, and are dropped
like those with nulls. A component without variance has null in place of its whitened value, since nothing can be
divided by it, and ``explained`` is null where there is no variance at all. ``deviation`` is null where
a long does not hold it, which takes more than 10**8 vectors. Ids may be null or repeat: every row is a vector of its own.
Extra columns are not looked at. An empty table, or one without a usable vector, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtrail.llm.common import quoted
from jobtrail.sources.shared import stored

STEPS = 64
SHIFT = 1_000_000
#: Entries of this size and more count as infinite.
LARGEST = float(1 << 34)
COMPONENTS = 32
#: Slices of a matrix in an exact product, and rounds of refinement at most.
SLICES = 3
ROUNDS = 12
#: Corrections below this are rounding.
SETTLED = 2.0**-58
#: An eigenvalue is no variance if it is this small a part of the largest, per dimension.
NOTHING = 2.0**-50

Extended = np.longdouble


@dataclass(frozen=True)
class Whitening:
    """What was fitted: ``sums`` of x over ``n`` vectors, unit ``vectors`` as columns, ``values`` falling."""

    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def live(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > NOTHING * len(self.sums) * max(float(self.values[0]), 0.0)


# --- eigenvectors ---


def _slices(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """Matrices whose sum is ``a``; every row of one is a whole number of ``bits`` bits times a power of two."""
    rest, found = a, []
    for _ in range(SLICES):
        top = np.abs(rest).max(axis=1, keepdims=True).astype(np.float64)
        grid = np.exp2((np.frexp(top)[1] - bits).astype(np.float64))
        part = np.rint(rest / grid) * grid
        found.append(part.astype(np.float64))
        rest = rest - part
    return found


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` in extended precision, by double-precision products without rounding."""
    bits = (53 - int(np.ceil(np.log2(max(a.shape[1], 2))))) // 2
    left, right = _slices(a, bits), _slices(b.T, bits)
    pairs = [(i, j) for i in range(SLICES) for j in range(SLICES) if i + j < SLICES]
    total = np.zeros((a.shape[0], b.shape[1]), Extended)
    for i, j in sorted(pairs, key=sum, reverse=True):
        total += left[i] @ right[j].T
    return total


def _clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Places of values that hang together by gaps of at most ``apart``, where there are several."""
    order = np.argsort(values)
    cuts = np.nonzero(np.diff(values[order]) > apart)[0] + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix, values falling; the vectors are columns."""
    scale = np.abs(matrix).max()
    one = np.eye(len(matrix), dtype=Extended)
    if not scale:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = matrix.astype(Extended) / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Extended)
    norm = np.sqrt((a * a).sum())
    for _ in range(ROUNDS):
        r = one - product(x.T, x)
        s = product(x.T, product(a, x))
        # Rounding is not symmetric, and over a small gap that would bend the vectors.
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(np.diag(s))
        apart = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= apart
        e = np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
        x = x + product(x, e)
        moved = np.abs(e).max()
        for part in _clusters(values, apart):
            own = x[:, part]
            middle = values[part].mean()
            small = product(own.T, product(a, own)) - middle * product(own.T, own)
            size = np.abs(small).max()
            if size:
                turn = np.linalg.eigh((small / size).astype(np.float64))[1].astype(Extended)
                x[:, part] = product(own, turn)
        if moved < SETTLED:
            break
    x = x + product(x, (one - product(x.T, x)) / 2)
    order = np.argsort(-values, kind="stable")
    x = x[:, order].astype(np.float64)
    # Either sign will do; the same one every time is the one that makes the largest entry positive.
    largest = x[np.abs(x).argmax(axis=0), np.arange(len(x))]
    return (values[order] * scale).astype(np.float64), x * np.where(largest < 0, -1.0, 1.0)


# --- fitting ---


def _usable(vectors: DataFrame, key: str | None, vector: str) -> DataFrame:
    keys = [] if key is None else [quoted(key).alias("id")]
    rows = vectors.select(*keys, quoted(vector).cast("array<double>").alias("vector"))
    # A null entry gives null and NaN is greater than all, so both drop the row.
    return rows.where(F.forall("vector", lambda c: F.abs(c) < LARGEST) & (F.size("vector") > 0))


def _steps(column: pa.ListArray, dim: int) -> np.ndarray:
    """floor(64 c) of all entries, a row per vector."""
    return np.floor(STEPS * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(0)
        sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
        dims = np.unique(sizes)
        parts = [_steps(column.filter(pa.array(sizes == dim)), int(dim)) for dim in dims]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(dims, pa.int32()),
                pa.array([len(part) for part in parts], pa.int64()),
                pa.array([part.astype(np.int64).sum(axis=0) for part in parts], pa.list_(pa.int64())),
            ],
            ["dim", "n", "sums"],
        )


def _added(rows: DataFrame) -> np.ndarray:
    """The matrix whose rows tasks give parts of: ``rows`` (i, part) with part an array."""
    cells = rows.select("i", F.posexplode("part").alias("j", "v"))
    cells = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    i, j, v = (cells[name].to_numpy() for name in ("i", "j", "v"))
    matrix = np.zeros((i.max() + 1, j.max() + 1))
    matrix[i, j] = v
    return matrix


def _products(rows: DataFrame, change) -> np.ndarray:
    """Sum of the outer products of all vectors, each ``change``d, and in a last row the vectors' sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            y = change(batch.column(0))
            total = total + np.vstack([y.T @ y, y.sum(axis=0)])
        if not np.isscalar(total):
            parts = pa.array(list(total), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), parts], ["i", "part"])

    return _added(rows.mapInArrow(run, "i int, part array<double>"))


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Fitted to all usable vectors; None without any."""
    rows = _usable(vectors, None, vector)
    found = stored(rows.mapInArrow(_sums, "dim int, n long, sums array<long>"), "vector-sums")
    kinds = found.groupBy("dim").agg(F.sum("n").alias("n"))
    most = kinds.orderBy(F.col("n").desc(), F.col("dim").desc()).first()
    if most is None:
        return None
    n, dim = most.n, most.dim
    each = found.where(F.col("dim") == dim).select(F.posexplode("sums").alias("j", "v"))
    sums = {row.j: int(row.v) for row in each.groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()}
    sums = [sums[j] for j in range(dim)]
    centre, rest = _centre(sums, n)

    same = rows.where(F.size("vector") == dim)
    total = _products(same, lambda column: _steps(column, dim) - centre)[:-1]
    covariance = total.astype(Extended) / n - np.outer(rest, rest)
    values, basis = eigenvectors((covariance + covariance.T) / 2)
    kept = slice(0, components)
    return Whitening(
        n, tuple(total + n * SHIFT for total in sums), basis[:, kept], values[kept], float(np.trace(covariance))
    )


def _centre(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole number nearest to each mean, and what the mean is more than that."""
    whole = [(2 * total + n) // (2 * n) for total in sums]
    rest = [Extended(total - n * near) / n for total, near in zip(sums, whole)]
    return np.array(whole, np.float64), np.array(rest, Extended)


# --- whitening ---


def _deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sum over dimensions of (n y - rest)**2 in whole numbers; None where a long does not hold it."""
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
    if len(rest) * most**2 < 1 << 63:
        off = n * y.astype(np.int64) - np.array(rest, np.int64)
        return (off * off).sum(axis=1).tolist()
    off = n * y.astype(np.int64).astype(object) - np.array(rest, object)
    return [total if total < 1 << 63 else None for total in (off * off).sum(axis=1)]


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable vector and component."""
    fitted = fit(vectors, vector, components)
    names = ("component int", "n long", "deviation long", "whitened double", "explained double", "identity_error double")
    if fitted is None:
        schema = T.StructType([vectors.select(quoted(key)).schema[0], *T._parse_datatype_string(", ".join(names))])
        return vectors.sparkSession.createDataFrame([], schema)
    return apply(vectors, fitted, key, vector)


def apply(vectors: DataFrame, fitted: Whitening, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The vectors' whitened components under what was fitted."""
    n, dim = fitted.n, len(fitted.sums)
    sums = [total - n * SHIFT for total in fitted.sums]
    centre, more = _centre(sums, n)
    rest = [total - n * int(near) for total, near in zip(sums, centre)]
    more = more.astype(np.float64)
    live = fitted.live
    weights = fitted.vectors[:, live] / np.sqrt(fitted.values[live])
    count = len(fitted.values)

    rows = _usable(vectors, key, vector).where(F.size("vector") == dim)
    error = None
    if live.any():
        moments = _products(rows.select("vector"), lambda column: (_steps(column, dim) - centre - more) @ weights)
        mean = moments[-1] / n
        error = float(np.abs(moments[:-1] / n - np.outer(mean, mean) - np.eye(len(mean))).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _steps(batch.column(1), dim) - centre
            white = np.full((len(y), count), np.nan)
            white[:, live] = (y - more) @ weights
            flat = pa.array(white.reshape(-1), mask=np.isnan(white.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(_deviations(y, n, rest), pa.int64()),
                    pa.ListArray.from_arrays(np.arange(0, white.size + 1, count, dtype=np.int32), flat),
                ],
                ["id", "deviation", "whitened"],
            )

    ids = rows.schema["id"].dataType
    schema = T.StructType(
        [T.StructField("id", ids), T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    )
    done = rows.mapInArrow(run, schema).select("id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = [float(value / fitted.trace) if fitted.trace > 0 else None for value in fitted.values]
    share = F.get(F.array(*(F.lit(share).cast("double") for share in shares)), F.col("place"))
    return done.select(
        F.col("id").alias(key),
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
