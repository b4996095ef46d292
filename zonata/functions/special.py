"""Tails of distributions in NumPy, for the few rows a test results in."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _series_gamma(a: float, x: float) -> float:
    term = total = 1 / a
    n = a
    while abs(term) > abs(total) * 1e-16:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _fraction_gamma(a: float, x: float) -> float:
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_sf(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution."""
    if x is None or df is None or math.isnan(x) or df <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    return 1 - _series_gamma(a, h) if h < a + 1 else _fraction_gamma(a, h)


def _fraction_beta(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    h = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction_beta(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction_beta(b, a, 1 - x) / b


def f_sf(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution."""
    if f is None or math.isnan(f) or df2 <= 0:
        return math.nan
    return 1.0 if f <= 0 else beta_reg(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(200)


def _cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(-z / math.sqrt(2))


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """Distribution of the range of k standard normals."""
    z = 8.5 * _NODES
    phi = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    inner = np.clip(_cdf(z)[None] - _cdf(z[None] - w[:, None]), 0, 1) ** (k - 1)
    return np.clip(k * 8.5 * (inner * (phi * _WEIGHTS)[None]).sum(1), 0, 1)


def studentized_range_sf(q: float, k: int, df: float) -> float:
    """Upper tail of the studentized range: the normal range mixed over the distribution of the scale."""
    if q is None or math.isnan(q) or df <= 0:
        return math.nan
    if q <= 0:
        return 1.0
    spread = 8 / math.sqrt(2 * df)
    lo, hi = max(1e-9, 1 - spread), 1 + spread if df > 4 else 12.0
    s = (hi - lo) / 2 * _NODES + (hi + lo) / 2
    log_density = math.log(2) + df / 2 * math.log(df / 2) - math.lgamma(df / 2) + (df - 1) * np.log(s) - df * s * s / 2
    return float(np.clip(1 - ((hi - lo) / 2 * _WEIGHTS * np.exp(log_density) * _range_cdf(q * s, k)).sum(), 0, 1))


def normal_quantile(p: float) -> float:
    """Inverse normal distribution by Newton steps on erfc."""
    if not 0 < p < 1:
        return math.nan
    x = math.sqrt(-2 * math.log(min(p, 1 - p))) * (1 if p > 0.5 else -1)
    for _ in range(60):
        step = (1 - normal_sf(x) - p) / (math.exp(-x * x / 2) / math.sqrt(2 * math.pi))
        x -= max(-1.0, min(1.0, step))
        if abs(step) < 1e-14:
            break
    return x


def _mapped(function, *columns: pd.Series) -> pd.Series:
    return pd.Series([function(*row) for row in zip(*columns, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(chi2_sf, x, df)


@F.pandas_udf(DoubleType())
def f_tail(x: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _mapped(f_sf, x, df1, df2)


@F.pandas_udf(DoubleType())
def normal_tail(z: pd.Series) -> pd.Series:
    return _mapped(normal_sf, z)


@F.pandas_udf(DoubleType())
def range_tail(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(lambda a, b, c: studentized_range_sf(a, int(b), c), q, k, df)


@F.pandas_udf(DoubleType())
def normal_point(p: pd.Series) -> pd.Series:
    return _mapped(normal_quantile, p)
