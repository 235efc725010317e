"""Whitening of embeddings: distributed centred covariance, eigenpairs by Householder, Sturm counts and inverse
iteration, projection of every row."""

from __future__ import annotations

import decimal
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ready

COMPONENTS = 4
#: Entries of a vector are counted in units of 1 / SCALE.
SCALE = 256
EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and subdiagonal of Q' A Q for a symmetric A, and the Householder vectors whose reflections make up Q."""
    a, mirrors = matrix.astype(float).copy(), []
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        size = np.linalg.norm(v)
        if np.any(v[1:]):
            v[0] += math.copysign(size, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            p -= (v @ p) * v
            rest -= 2 * (np.outer(v, p) + np.outer(p, v))
            a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
            a[k, k + 1 :] = a[k + 1 :, k]
        else:
            v = np.zeros_like(v)
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, off: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm count: how many eigenvalues of the tridiagonal matrix are less than each x (signs of its pivots)."""
    tiny = EPS * EPS * float(np.abs(diagonal).max() + np.abs(off).max(initial=0))
    pivot = diagonal[0] - x
    count = (pivot < 0).astype(int)
    for d, e in zip(diagonal[1:], off, strict=True):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = d - x - e * e / pivot
        count += pivot < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k greatest eigenvalues, falling, by bisection of the Gershgorin interval on Sturm counts."""
    n = len(diagonal)
    reach = np.concatenate((np.abs(off), [0.0])) + np.concatenate(([0.0], np.abs(off)))
    low, high = np.full(k, (diagonal - reach).min()), np.full(k, (diagonal + reach).max() + EPS)
    wanted = n - 1 - np.arange(k)  # so many eigenvalues are less than the one looked for
    for _ in range(2000):
        middle = low + (high - low) / 2
        if np.all((middle <= low) | (middle >= high)):
            break
        less = below(diagonal, off, middle) <= wanted
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return low + (high - low) / 2


def solved(diagonal: np.ndarray, off: np.ndarray, shift: float, right: np.ndarray, tiny: float) -> np.ndarray:
    """Solution of (T - shift) y = right by elimination with row exchanges; pivots of nearly 0 become tiny."""
    n = len(diagonal)
    a, b, c, y = diagonal - shift, np.append(off, 0.0), np.zeros(n), right.copy()  # pivot, next and second next column
    lower = off
    for i in range(n - 1):
        if abs(lower[i]) > abs(a[i]):
            a[i], under = lower[i], a[i]
            b[i], a[i + 1] = a[i + 1], b[i]
            c[i], b[i + 1] = (b[i + 1], 0.0) if i + 1 < n - 1 else (0.0, 0.0)
            y[i], y[i + 1] = y[i + 1], y[i]
        else:
            under = lower[i]
        a[i] = a[i] if abs(a[i]) > tiny else math.copysign(tiny, a[i])
        f = under / a[i]
        a[i + 1] -= f * b[i]
        b[i + 1] -= f * c[i]
        y[i + 1] -= f * y[i]
    a[-1] = a[-1] if abs(a[-1]) > tiny else math.copysign(tiny, a[-1])
    for i in range(n - 1, -1, -1):
        y[i] = (y[i] - (b[i] * y[i + 1] if i + 1 < n else 0.0) - (c[i] * y[i + 2] if i + 2 < n else 0.0)) / a[i]
    return y


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) by inverse iteration from seeded starts; eigenvalues closer than a thousandth of the norm
    form a cluster, in which each vector is made orthogonal to the earlier ones after every step."""
    n, norm = len(diagonal), float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0))
    tiny, start = EPS * norm, np.random.default_rng(12)
    out, cluster, last = [], 0, math.inf
    for i, value in enumerate(values):
        if i and values[i - 1] - value > 1e-3 * norm:
            cluster, last = i, math.inf
        last = min(value, last - 4 * tiny)  # equal values of a cluster are parted a little
        y = start.standard_normal(n)
        for _ in range(6):
            y = solved(diagonal, off, last, y / np.linalg.norm(y), tiny)
            y /= np.abs(y).max()
            for _ in range(2):
                for z in out[cluster:]:
                    y -= (z @ y) * z
        out.append(y / np.linalg.norm(y))
    return np.array(out).reshape(len(values), n)


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest eigenvalues (falling) of a symmetric matrix and unit eigenvectors as rows."""
    k, scale = min(k, len(matrix)), float(np.abs(matrix).max(initial=0))
    if not scale:
        return np.zeros(k), np.eye(k, len(matrix))
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    vectors = leading_vectors(diagonal, off, values)
    for first, v in reversed(list(enumerate(mirrors, start=1))):
        part = vectors[:, first:]
        part -= 2 * np.outer(part @ v, v)
    return values * scale, vectors


def matrix_of(vectors: pa.Array, dims: int) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones end in zeros."""
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if np.all(lengths == dims):
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims), flat.dtype)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def blocks(batches, column: str, dims: int):
    for batch in batches:
        if batch.num_rows:
            yield matrix_of(batch.column(column), dims)


def totals(fit: DataFrame) -> tuple[int, dict[int, int]]:
    """Number of vectors and exact sums of the dimensions: one row a dimension from each partition."""

    def partial(batches):
        n, sums = 0, {}
        for batch in batches:
            vectors = batch.column("x")
            x = matrix_of(vectors, max(vectors.value_lengths().to_pylist(), default=0))
            n += len(x)
            wide = len(x) and np.abs(x.astype(float)).max(initial=0) * len(x) >= 1 << 62
            for i, v in enumerate((x.astype(object) if wide else x).sum(axis=0)):
                sums[i] = sums.get(i, 0) + int(v)
        values = [decimal.Decimal(v) for v in (n, *sums.values())]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *sums], pa.int32()), pa.array(values, pa.decimal128(38, 0))], ["i", "s"])

    rows = fit.mapInArrow(partial, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    found = {r.i: int(r.s) for r in rows.toLocalIterator()}  # one row a dimension
    return found.pop(-1, 0), found


def products(fit: DataFrame, dims: int, centre: list[int]) -> np.ndarray:
    """Sum over the vectors of (x - centre)(x - centre)'. centre holds whole numbers, so that all terms are whole and
    sums below 2**53 are exact in whatever order they come. A partition sends its upper triangle; Spark adds them up."""

    def partial(batches):
        c, total = np.array(centre, float), np.zeros((dims, dims))
        for x in blocks(batches, "x", dims):
            d = x.astype(float) - c
            total += d.T @ d
        i, j = np.triu_indices(dims)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    out = np.zeros((dims, dims))
    for r in fit.mapInArrow(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toLocalIterator():
        out[r.i, r.j] = out[r.j, r.i] = r.v  # dims * (dims + 1) / 2 rows, whatever the table's size
    return out


def identity_error(fit: DataFrame, model: Whitener) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity. Every partition sends its
    count, means and centred products; parts are joined by the products of their means' deviations."""
    k, dims = len(model.values), len(model.sums)

    def partial(batches):
        n, mean, spread = 0, np.zeros(k), np.zeros((k, k))
        for x in blocks(batches, "x", dims):
            w = model.project(x)
            m, size = w.mean(axis=0), len(w)
            spread += (w - m).T @ (w - m) + np.outer(m - mean, m - mean) * (n * size / (n + size))
            mean, n = mean + (m - mean) * (size / (n + size)), n + size
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([spread.ravel().tolist()])], ["n", "mean", "spread"])

    rows = fit.mapInArrow(partial, "n long, mean array<double>, spread array<double>")
    rows = cut(rows.withColumn("part", F.monotonically_increasing_id()))
    mean = rows.select("n", F.posexplode("mean").alias("i", "m")).groupBy("i").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    off = rows.select("part", "n", F.posexplode("mean").alias("i", "m")).join(F.broadcast(mean), "i")  # k rows
    off = off.select("part", "n", "i", (F.col("m") - F.col("mean")).alias("off"))
    pairs = off.join(off.select("part", F.col("i").alias("j"), F.col("off").alias("other")), "part")
    between = pairs.select("i", "j", (F.col("n") * F.col("off") * F.col("other")).alias("v"))
    within = rows.select(F.posexplode("spread").alias("at", "v")).select(F.floor(F.col("at") / k).alias("i"), (F.col("at") % k).alias("j"), "v")
    entries = within.union(between).groupBy("i", "j").agg((F.sum("v") / model.n).alias("v"))
    return entries.agg(F.max(F.abs(F.col("v") - (F.col("i") == F.col("j")).cast("double"))).alias("e")).first().e


class Whitener(NamedTuple):
    """What a projection needs: size and sums of the fit list, eigenvalues, components (rows), trace of the covariance."""

    n: int
    sums: tuple
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Coordinates of rows. A row's sums run over its own entries alone, so that batches can't change them."""
        centred = x - np.array([s / self.n for s in self.sums])
        return np.stack([(centred * v).sum(axis=1) for v in self.vectors], axis=1) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum of (n x - S)**2 of each row; null beyond 64 bits."""
        largest = self.n * int(np.abs(x.astype(object)).max(initial=0)) + max(map(abs, self.sums), default=0)
        if len(self.sums) * largest**2 < 1 << 63:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums, strict=True)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def quantised(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite entries, and those entries as whole units (column x)."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    whole = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * SCALE))
    return rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda v: bad(v.cast("double")))).withColumn("x", whole)


def fit_whitener(fit: DataFrame, components: int = COMPONENTS) -> Whitener:
    """Eigenpairs of the covariance of a table of whole vectors x (divisor n).

    Vectors are centred on the whole numbers next to the means before they are multiplied; what is left of the means,
    below 1, is taken out afterwards. Only sums and products of the dimensions reach the driver: dims squared numbers,
    for a thousand dimensions 8 MB. Components whose eigenvalue is rounding noise (a constant table, fewer vectors than
    components) are left out.
    """
    n, found = totals(fit)
    dims = len(found)
    s = tuple(found[i] for i in range(dims))
    if not n or not dims:
        return Whitener(n, s, np.zeros(0), np.zeros((0, dims)), 0.0)
    centre = [round(v / n) for v in s]
    rest = np.array([(v - c * n) / n for v, c in zip(s, centre, strict=True)])
    covariance = products(fit, dims, centre) / n - np.outer(rest, rest)
    trace = float(np.trace(covariance))
    values, vectors = leading_pairs(covariance, components)
    real = values > dims * EPS * max(trace, 0.0) * 8
    return Whitener(n, s, values[real], vectors[real], trace)


PART = pa.struct([("component", pa.int32()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64())])


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, carry: tuple = ("*",)) -> DataFrame:
    """Whitened coordinates of every vector: rows (row: the columns to carry, component, n, deviation, whitened,
    explained, identity_error), one for each component.

    Entries count in whole units of 1/SCALE, rounded down. Each distinct vector enters the fit once, however many rows
    repeat it. Rows whose vector is null or has null or non-finite entries are left out; vectors shorter than the longest
    end in zeros; an empty table, or one without variance, gives no rows. Signs of components are arbitrary but the same
    for all rows, and runs agree (identity_error but for rounding). The model that tasks receive is components x dims numbers.
    """
    ready(rows.sparkSession)
    packed = quantised(rows.select(F.struct(*carry).alias("row"), F.col(vector).alias("_vector")), "_vector")
    fit = cut(packed.select("x").distinct())
    model = fit_whitener(fit, components)
    error = identity_error(fit, model) if len(model.values) else None
    dims, kinds = len(model.sums), pa.list_(PART)

    @F.arrow_udf("array<struct<component:int,deviation:long,whitened:double,explained:double>>")
    def projected(x: pa.Array) -> pa.Array:
        if not len(x) or not len(model.values):
            return pa.array([[]] * len(x), kinds)
        values = matrix_of(x, dims)
        k = len(model.values)
        parts = [pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array([d for d in model.deviation(values) for _ in range(k)], pa.int64()),
                 pa.array(model.project(values).ravel()), pa.array(np.tile(model.values / model.trace, len(x)))]
        return pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * k + 1, k, dtype=np.int32)), pa.StructArray.from_arrays(parts, fields=list(PART)))

    out = packed.select("row", F.explode(projected(F.col("x"))).alias("c"))
    return out.select("row", "c.component", F.lit(model.n).cast("long").alias("n"), "c.deviation", "c.whitened", "c.explained",
                      F.lit(error).cast("double").alias("identity_error"))


def op12_embedding_whitening(rows: DataFrame) -> DataFrame:
    out = whiten(rows, carry=("vec_id",))
    return out.select("row.vec_id", *[c for c in out.columns if c != "row"])
