"""Special functions and hash uniforms as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SHIFT = 7


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: the recurrence moves x by 7, then Stirling's series; absolute error about 1e-11 up to x = 2000.

    x is bound once as a lambda's variable: written out, it would stand some twenty times in the expression, and a few such terms
    exceed the size of a method that Spark compiles.
    """
    return F.element_at(F.transform(F.array(x.cast("double")), _lgamma), 1)


def _lgamma(x: Column) -> Column:
    z = x + _SHIFT
    product = reduce(lambda a, b: a * b, [x + k for k in range(1, _SHIFT)], x)
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    return F.when((x == 1) | (x == 2), F.lit(0.0)).otherwise((z - 0.5) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(product))


def lbinom(n: Column, k: Column) -> Column:
    """ln of n choose k; 0 if n = 0, k = 0 or k > n."""
    return F.when((n == 0) | (k == 0) | (k > n), F.lit(0.0)).otherwise(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))


def log_q_approx(n: Column, k: Column) -> Column:
    """ln of the number of partitions of n into at most k parts, by the small-k formula; n and k are at least 1, k at most n."""
    n = F.greatest(n.cast("double"), F.lit(1.0))
    k = F.least(F.greatest(k.cast("double"), F.lit(1.0)), n)
    return lbinom(n - 1, k - 1) - lgamma(k + 1)


def cell_entropy(m: Column, d_out: Column, d_in: Column) -> Column:
    """m (ln m - ln d_out - ln d_in), 0 where m is 0."""
    return F.when(m == 0, F.lit(0.0)).otherwise(m * (F.log(m) - (F.log(d_out) + F.log(d_in))))


def safe_log(x: Column) -> Column:
    """ln x, 0 at 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.log(x))


def hash_uniform(seed: int | str, *columns: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of md5(seed|columns): the same in every engine and for any partitioning."""
    text = F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


#: Below this total, partitions are counted; above it, the asymptotic form of Szekeres holds to a few thousandths.
EXACT_PARTITIONS = 200


@lru_cache(1)
def _partition_counts() -> np.ndarray:
    """ln of the number of partitions of n into at most k parts, n and k up to EXACT_PARTITIONS."""
    size = EXACT_PARTITIONS + 1
    count = np.zeros((size, size), object)
    count[0, :] = 1
    for k in range(1, size):
        for n in range(1, size):
            count[n, k] = count[n, k - 1] + (count[n - k, k] if n >= k else 0)
    return np.array([[math.log(c) if c > 0 else 0.0 for c in row] for row in count])


def spence(x):
    """The dilogarithm Li2(1 - x) for 0 <= x <= 1: a quadrature of t / (e^t - 1) from -ln(1 - x) on, exact to about 1e-13."""
    y = 1.0 - np.asarray(x, float)
    node, weight = _NODES
    # Li2(y) = integral of -ln(1 - s) / s over 0 <= s <= y, with s = y u^2 so that the end at 1 is smooth
    u = (node + 1) / 2
    s = y[..., None] * (1 - (1 - u) ** 3)
    ds = y[..., None] * 3 * (1 - u) ** 2
    with np.errstate(divide="ignore", invalid="ignore"):
        f = np.where(s > 1e-12, -np.log1p(-np.minimum(s, 1 - 1e-300)) / np.where(s > 0, s, 1.0), 1.0)
    f = np.where(np.isfinite(f), f, 0.0)
    out = (f * ds * (weight / 2)).sum(axis=-1)
    return float(out) if out.ndim == 0 else out


_NODES = np.polynomial.legendre.leggauss(64)


def _saddle(u: np.ndarray) -> np.ndarray:
    """The root v > 0 of v = u sqrt(Li2(1 - e^-v)), by bisection of all at once: the right side grows slower than v."""
    lo, hi = np.zeros(len(u)), u * math.pi / math.sqrt(6) + 1e-9
    for _ in range(60):
        mid = (lo + hi) / 2
        below = mid < u * np.sqrt(spence(np.exp(-mid)))
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def log_q_values(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    """ln q(n, k), q the number of partitions of n into at most k parts: 0 for n <= 0 or k < 1.

    Counted for small n; for k under the fourth root of n by the number of compositions over k!; otherwise the asymptotic form
    q ~ f(u) exp(sqrt(n) g(u)) / n, u = k / sqrt(n), with v as above, f = v / (2 pi sqrt(2) u) / sqrt(1 - (1 + u^2 / 2) e^-v) and
    g = 2 v / u - u ln(1 - e^-v).
    """
    n, k = np.asarray(n, np.int64), np.asarray(k, np.int64)
    out = np.zeros(len(n))
    some = (n > 0) & (k > 0)
    k = np.minimum(k, np.maximum(n, 1))
    exact = some & (n <= EXACT_PARTITIONS)
    out[exact] = _partition_counts()[n[exact], k[exact]]
    few = some & ~exact & (k < np.maximum(n, 1) ** 0.25)
    out[few] = [math.lgamma(a) - math.lgamma(b) - math.lgamma(a - b + 1) - math.lgamma(b + 1) for a, b in zip(n[few].tolist(), k[few].tolist(), strict=True)]
    rest = some & ~exact & ~few
    if rest.any():
        a = n[rest].astype(float)
        u = k[rest] / np.sqrt(a)
        v = _saddle(u)
        tail = np.exp(-v)
        f = np.log(v) - np.log(2 * math.pi * math.sqrt(2) * u) - np.log1p(-(1 + u * u / 2) * tail) / 2
        out[rest] = f + np.sqrt(a) * (2 * v / u - u * np.log1p(-tail)) - np.log(a)
    return out


def log_q_value(n: int, k: int) -> float:
    return float(log_q_values(np.array([n]), np.array([k]))[0])


@F.pandas_udf(T.DoubleType())
def log_q(n: pd.Series, k: pd.Series) -> pd.Series:
    """The full ln q(n, k); a root search, so Arrow batches it, and each different pair is computed once."""
    pairs, back = np.unique(np.stack([n.to_numpy(np.int64), k.to_numpy(np.int64)]), axis=1, return_inverse=True)
    return pd.Series(log_q_values(pairs[0], pairs[1])[back.ravel()])
