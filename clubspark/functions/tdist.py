"""Student's t distribution for a handful of already aggregated rows."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these helpers with the UDFs; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    floor = 1e-300
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), floor)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > floor else floor)
            c = c if abs(c) > floor else floor
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def _log_gamma_ratio(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)); for a half and a large a by its series, where differences lose digits."""
    if b == 0.5 and a > 1e3:
        return 0.5 * math.log(a) - 1.0 / (8.0 * a) + 1.0 / (192.0 * a**3)
    return math.lgamma(a + b) - math.lgamma(a)


def incomplete_beta(a: float, b: float, x: float, rest: float | None = None) -> float:
    """I_x(a, b); ``rest`` is 1 - x where the caller knows it with more digits."""
    rest = 1.0 - x if rest is None else rest
    if x <= 0.0 or rest <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    log_x = math.log1p(-rest) if rest < 0.5 else math.log(x)
    front = math.exp(_log_gamma_ratio(a, b) - math.lgamma(b) + a * log_x + b * math.log(rest))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|); above 10 million degrees of freedom the normal tail with its first term in 1/df."""
    if df > 1e7:
        x = abs(t)
        density = math.exp(-x * x / 2.0) / math.sqrt(2.0 * math.pi)
        return math.erfc(x / math.sqrt(2.0)) + density * (x**3 + x) / (2.0 * df)
    whole = df + t * t
    return incomplete_beta(df / 2.0, 0.5, df / whole, t * t / whole)


def upper_quantile(tail: float, df: float) -> float:
    """t with P(|T| >= t) = tail, by bisection."""
    lo, hi = 0.0, 1.0
    while two_sided_p(hi, df) > tail:
        hi *= 2.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        lo, hi = (mid, hi) if two_sided_p(mid, df) > tail else (lo, mid)
    return (lo + hi) / 2.0


def _rowwise(fn, a: pd.Series, b: pd.Series) -> pd.Series:
    known = a.notna() & b.notna() & (b > 0)
    return pd.Series([fn(x, y) if ok else None for x, y, ok in zip(a, b, known)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(two_sided_p, t, df)


@F.pandas_udf(T.DoubleType())
def t_critical_95(df: pd.Series) -> pd.Series:
    """Half width of a 95 % interval in standard errors."""
    return _rowwise(upper_quantile, pd.Series([0.05] * len(df)), df)
