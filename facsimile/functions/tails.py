"""Tail probabilities of the two tests, as Arrow-batched functions over one row per column."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def chi_square_tail(statistic: float, freedom: float) -> float:
    """P(X >= statistic): the regularised upper incomplete gamma function."""
    a, x = freedom / 2.0, statistic / 2.0
    if x <= 0:
        return 1.0
    lead = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        # power series of the lower function
        term = total = 1.0 / a
        step = a
        while abs(term) > abs(total) * 1e-16:
            step += 1
            term *= x / step
            total += term
        return max(0.0, 1.0 - lead * total)
    # continued fraction of the upper function (modified Lentz)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    fraction = d
    for i in range(1, 10_000_000):
        numerator = -i * (i - a)
        b += 2
        d = 1 / (numerator * d + b or 1e-300)
        c = b + numerator / c or 1e-300
        fraction *= d * c
        if abs(d * c - 1) < 1e-15:
            return lead * fraction
    raise ArithmeticError(f"no convergence for shape {a} at {x}")


def kolmogorov_tail(distance: float, n: float, m: float) -> float:
    """Two-sided p-value of the two-sample distance: limiting series with a finite-size argument.

    Within about 1e-3 of the exact distribution for samples above 50; smaller ones are ``kolmogorov_exact``'s.
    """
    size = n * m / (n + m)
    root = math.sqrt(size)
    z = distance * root
    z += 1 / (6 * root) + (z - 1) / (4 * size)
    if z < 0.2:
        return 1.0
    total = sum((-1) ** (j - 1) * math.exp(-2 * j * j * z * z) for j in range(1, 101))
    return min(1.0, max(0.0, 2 * total))


#: Fixed value: samples up to this size get the exact p-value, as published.
EXACT_ROWS = 10_000


def kolmogorov_exact(distance: float, n: int, m: int) -> float:
    """Two-sided p-value of the two-sample distance without ties: the share of orderings whose distance is as large.

    An ordering is a lattice path from (0, 0) to (n, m).  ``out[i]`` is the share of the paths to a point (i, s - i) that
    have left the band |i/n - j/m| < distance; it follows from the two points before it, as the last step came
    from the first sample with probability i/s.  One diagonal at a time, so memory is one row of the smaller sample.
    """
    if n > m:
        n, m = m, n
    g = math.gcd(n, m)
    width = round(distance * (n // g) * m)
    if width <= 0:
        return 1.0
    i = np.arange(n + 1)
    out = np.zeros(n + 1)
    for s in range(1, n + m + 1):
        low, high = max(0, s - m), min(n, s)
        at = i[low : high + 1]
        stay = np.where(at <= s - 1, out[low : high + 1], 0.0)
        came = np.concatenate([[0.0 if low == 0 else out[low - 1]], out[low:high]])
        following = (at * came + (s - at) * stay) / s
        following[np.abs(at * (m // g) - (s - at) * (n // g)) >= width] = 1.0
        out[low : high + 1] = following
    return float(min(1.0, max(0.0, out[n])))


@F.pandas_udf(T.DoubleType())
def chi_square_p(statistic: pd.Series, freedom: pd.Series) -> pd.Series:
    return pd.Series([
        None if pd.isna(s) or pd.isna(f) or f < 1 else chi_square_tail(float(s), float(f))
        for s, f in zip(statistic, freedom)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def kolmogorov_p(distance: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Exact up to EXACT_ROWS values in either sample, limiting beyond."""
    return pd.Series([
        None if pd.isna(d) else kolmogorov_exact(float(d), int(a), int(b)) if max(a, b) <= EXACT_ROWS
        else kolmogorov_tail(float(d), float(a), float(b))
        for d, a, b in zip(distance, n, m)
    ], dtype="float64")
