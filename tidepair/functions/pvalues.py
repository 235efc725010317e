"""Arrow scalar functions for tail probabilities of already aggregated rows."""

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz), vectorised; rows leave when they stand still."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    out, at = np.ones_like(x), np.arange(len(x))
    c = np.ones_like(x)
    d = 1.0 / away(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / away(1.0 + num * d)
            c = away(1.0 + num / c)
            h = h * d * c
        moving = ~(np.abs(d * c - 1.0) < 2e-15)
        out[at] = h
        if not moving.any():
            break
        at, a, b, x, c, d, h = (v[moving] for v in (at, a, b, x, c, d, h))
    return out


def _lgamma(v):
    some, at = np.unique(np.ravel(v), return_inverse=True)
    return np.array([math.lgamma(t) for t in some])[at]


def reg_beta(a, b, x):
    """Regularised incomplete beta I_x(a, b) for arrays."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x))
        flip = x > (a + 1) / (a + b + 2)
        aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
        part = front * _beta_fraction(aa, bb, xx) / aa
    out = np.where(flip, 1 - part, part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


@F.pandas_udf(DoubleType())
def student_t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null where t is null or df < 1."""
    ok = t.notna() & df.notna() & (df >= 1)
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        v, n = t[ok].to_numpy(float), df[ok].to_numpy(float)
        out[ok] = np.where(np.isinf(v), 0.0, reg_beta(n / 2, 0.5, n / (n + v * v)))
    return out.where(ok, None)


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)) if pd.notna(v) else None).astype(float)


def _hyper(a, row, col, n):
    """log P(a) of the hypergeometric with margins row, col, total n."""
    lg = math.lgamma
    choose = lambda x, y: lg(x + 1) - lg(y + 1) - lg(x - y + 1)
    return choose(row, a) + choose(n - row, col - a) - choose(n, col)


def _walk(a, row, col, n, direction, stop):
    """Sum of P from a in one direction; stops once terms cannot matter or leave the support."""
    low, high = max(0, row + col - n), min(row, col)
    total, k, term = 0.0, a, math.exp(_hyper(a, row, col, n)) if low <= a <= high else 0.0
    while low <= k <= high and term > 0.0:
        total += term
        if term < total * 1e-18 and stop:
            break
        if direction > 0:
            term *= (row - k) * (col - k) / ((k + 1.0) * (n - row - col + k + 1.0))
        else:
            term *= k * (n - row - col + k) / ((row - k + 1.0) * (col - k + 1.0))
        k += direction
    return total


def _far_edge(a, row, col, n, limit):
    """First point beyond the mode, on the other side of a, whose P <= limit (binary search)."""
    low, high = max(0, row + col - n), min(row, col)
    mode = min(max((row + 1) * (col + 1) // (n + 2), low), high)
    if a <= mode:
        lo, hi = mode, high + 1
        while lo < hi:
            mid = (lo + hi) // 2
            if mid > high or _hyper(mid, row, col, n) <= limit:
                hi = mid
            else:
                lo = mid + 1
        return lo, 1
    lo, hi = low - 1, mode
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if mid < low or _hyper(mid, row, col, n) <= limit:
            lo = mid
        else:
            hi = mid - 1
    return lo, -1


def fisher_p(a, b, c, d):
    """Two-sided Fisher exact p of [[a, b], [c, d]]: mass of tables no likelier than the seen one."""
    a, b, c, d = int(a), int(b), int(c), int(d)
    row, col, n = a + b, a + c, a + b + c + d
    if min(row, col, n - row, n - col) == 0:
        return 1.0
    limit = _hyper(a, row, col, n) + 1e-7
    far, step = _far_edge(a, row, col, n, limit)
    near = _walk(a, row, col, n, -step, True)
    return min(1.0, near + _walk(far, row, col, n, step, True)) if near < 1 else 1.0


@F.pandas_udf(DoubleType())
def fisher_exact_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_p(*v) for v in zip(a, b, c, d)], dtype=float)


def _u_counts(m, n):
    """Number of orderings per Mann-Whitney U for sizes m, n."""
    counts = np.zeros(m * n + 1)
    counts[0] = 1.0
    for j in range(1, m + 1):  # Gaussian binomial: times (1 - q^(n+j)) / (1 - q^j)
        if n + j <= m * n:
            counts[n + j:] -= counts[:-(n + j)].copy()
        padded = np.concatenate([counts, np.zeros(-len(counts) % j)])
        counts = np.cumsum(padded.reshape(-1, j), axis=0).ravel()[: m * n + 1]
    return counts


@F.pandas_udf(DoubleType())
def mannwhitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, tie_sum: pd.Series) -> pd.Series:
    """Two-sided p: exact when a side has <= 8 values and no ties, else normal with ties and continuity.

    tie_sum = sum of t^3 - t over tied values.
    """
    out = []
    for stat, a, b, ties in zip(u, n1, n2, tie_sum):
        if pd.isna(stat) or not a or not b:
            out.append(None)
            continue
        a, b = int(a), int(b)
        top = max(stat, a * b - stat)
        if min(a, b) <= 8 and not ties:
            counts = _u_counts(min(a, b), max(a, b))
            out.append(float(min(1.0, 2 * counts[int(math.ceil(top)):].sum() / counts.sum())))
            continue
        n = a + b
        var = a * b / 12.0 * ((n + 1) - ties / (n * (n - 1)))
        z = (top - a * b / 2.0 - 0.5) / math.sqrt(var) if var > 0 else 0.0
        out.append(min(1.0, math.erfc(max(z, 0.0) / math.sqrt(2))) if var > 0 else 1.0)
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def wilcoxon_p(w: pd.Series, n: pd.Series, tie_sum: pd.Series) -> pd.Series:
    """Two-sided signed-rank p of w = min(W+, W-): exact for n <= 50 without ties, else normal."""
    out = []
    for stat, size, ties in zip(w, n, tie_sum):
        if pd.isna(stat) or not size:
            out.append(None)
            continue
        size = int(size)
        if size <= 50 and not ties:
            counts = np.zeros(size * (size + 1) // 2 + 1)
            counts[0] = 1.0
            for r in range(1, size + 1):
                counts[r:] += counts[:-r].copy()
            out.append(float(min(1.0, 2 * counts[: int(stat) + 1].sum() / 2.0 ** size)))
            continue
        var = size * (size + 1) * (2 * size + 1) / 24.0 - ties / 48.0
        z = (stat - size * (size + 1) / 4.0) / math.sqrt(var)
        out.append(min(1.0, math.erfc(abs(z) / math.sqrt(2))))
    return pd.Series(out, dtype=float)


def blake_fold(folds: int, seed: int):
    """Arrow function group -> fold by an 8-byte BLAKE2b digest of 'seed:group' (big endian)."""

    @F.pandas_udf(IntegerType())
    def fold(group: pd.Series) -> pd.Series:
        digest = lambda g: hashlib.blake2b(f"{seed}:{g}".encode(), digest_size=8).digest()
        return group.map(lambda g: int.from_bytes(digest(g), "big") % folds)

    return fold


@F.pandas_udf(DoubleType())
def hypergeom_greater(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """P(overlap >= a) of the table [[a, b], [c, d]]."""
    def tail(a, b, c, d):
        a, row, col, n = int(a), int(a + b), int(a + c), int(a + b + c + d)
        low = max(0, row + col - n)
        if a <= low:
            return 1.0
        upper = _walk(a, row, col, n, 1, False)
        mode = (row + 1) * (col + 1) / (n + 2)
        return min(1.0, upper if a > mode else 1.0 - _walk(a - 1, row, col, n, -1, False))

    return pd.Series([tail(*v) for v in zip(a, b, c, d)], dtype=float)
