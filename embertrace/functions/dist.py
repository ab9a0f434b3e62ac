"""Tail probabilities in plain Python (they finish one-row results), as survival functions to keep small values exact."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return min(1.0, math.erfc(abs(z) / math.sqrt(2)))


def gamma_sf(a: float, x: float) -> float:
    """Upper regularised incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def chi2_sf(x: float, k: float) -> float:
    return gamma_sf(k / 2, x / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def tail(f, *args: Column) -> Column:
    """Apply a tail function to columns; null where an argument is null."""
    def batch(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in frame.itertuples(index=False)], dtype="float64")

    def one(a: pd.Series) -> pd.Series:
        return batch(a.to_frame())

    def two(a: pd.Series, b: pd.Series) -> pd.Series:
        return batch(pd.concat([a, b], axis=1))

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return batch(pd.concat([a, b, c], axis=1))

    return F.pandas_udf((one, two, three)[len(args) - 1], "double")(*args)
