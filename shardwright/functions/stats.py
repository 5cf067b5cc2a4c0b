"""Distribution functions for significance tests (no scipy on the cluster).

Used only on aggregated rows (one row per run group), through Arrow-batched
pandas UDFs.  The regularised incomplete beta and gamma functions come from
the series and continued fractions of the Digital Library of Mathematical
Functions (8.17.22, 8.11.4, 8.9.2), evaluated until they no longer change;
quantiles by bisection in a bracket that grows until it holds the answer.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOST_TERMS = 5_000_000


def _fraction(terms: Iterable[tuple[float, float]]) -> float:
    """Continued fraction a1/(b1 + a2/(b2 + ...)) from its (a, b), forwards by ratios of successive convergents."""
    value, up, down = 1.0, math.inf, 0.0
    for k, (a, b) in enumerate(itertools.islice(terms, MOST_TERMS)):
        if k == 0:
            down, up, value = 1.0 / b, math.inf, a / b
            continue
        down = 1.0 / ((b + a * down) or 1e-300)
        up = (b + a / up) or 1e-300
        step = up * down
        value *= step
        if abs(step - 1.0) < 1e-15:
            return value
    raise ArithmeticError("a continued fraction has not settled")


def _beta_terms(a: float, b: float, x: float) -> Iterable[tuple[float, float]]:
    yield 1.0, 1.0
    for k in itertools.count(0):
        yield -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)), 1.0
        m = k + 1
        yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0 or x >= 1.0:
        return float(x >= 1.0)
    if x > (a + 1.0) / (a + b + 2.0):  # where the fraction converges fast for the mirrored arguments
        return 1.0 - betainc(b, a, 1.0 - x)
    log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    return math.exp(log_front) / a * _fraction(_beta_terms(a, b, x))


def t_cdf(t: float, df: float) -> float:
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 1.0 if t > 0 else 0.0
    x = df / (df + t * t)
    tail = 0.5 * betainc(df / 2.0, 0.5, x)
    return 1.0 - tail if t > 0 else tail


def _quantile(cdf: Callable[[float], float], q: float, low: float, high: float) -> float:
    """Bisection; the ends move outwards until the answer lies between them."""
    while cdf(high) < q:
        high *= 2.0
    while low < 0.0 and cdf(low) > q:
        low *= 2.0
    while True:
        middle = 0.5 * (low + high)
        if middle in (low, high):
            return middle
        low, high = (middle, high) if cdf(middle) < q else (low, middle)


def t_ppf(q: float, df: float) -> float:
    """Quantile of Student's t."""
    if not (0.0 < q < 1.0) or df <= 0:
        return float("nan")
    if q == 0.5:
        return 0.0
    # the small tail is the exact one
    return _quantile(lambda t: t_cdf(t, df), q, -1.0, 0.0) if q < 0.5 else -t_ppf(1.0 - q, df)


def _gamma_terms(a: float, x: float) -> Iterable[tuple[float, float]]:
    yield 1.0, x + 1.0 - a
    for k in itertools.count(1):
        yield k * (a - k), x + 2 * k + 1.0 - a


def gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x)."""
    if x <= 0:
        return 0.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x >= a + 1.0:
        return 1.0 - math.exp(log_front) * _fraction(_gamma_terms(a, x))
    term = total = 1.0 / a
    for k in range(1, MOST_TERMS):
        term *= x / (a + k)
        total += term
        if term < total * 1e-17:
            return total * math.exp(log_front)
    raise ArithmeticError("a series has not settled")


def chi2_ppf(q: float, df: float) -> float:
    if not (0.0 < q < 1.0) or df <= 0:
        return float("nan")
    return _quantile(lambda x: gammainc(df / 2.0, x / 2.0), q, 0.0, df + 10.0)


def _vec(fn, *arrs):
    return np.array([fn(*vals) if all(v is not None and not pd.isna(v) for v in vals) else np.nan
                     for vals in zip(*arrs)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_cdf_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_vec(t_cdf, t.to_numpy(), df.to_numpy()))


@F.pandas_udf(T.DoubleType())
def t_ppf_udf(q: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_vec(t_ppf, q.to_numpy(), df.to_numpy()))


@F.pandas_udf(T.DoubleType())
def chi2_ppf_udf(q: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(_vec(chi2_ppf, q.to_numpy(), df.to_numpy()))


def p_less(t: Column, df: Column) -> Column:
    """One-sided p for H1: mean < target."""
    return t_cdf_udf(t, df)


def p_two_sided(t: Column, df: Column) -> Column:
    return F.lit(2.0) * t_cdf_udf(-F.abs(t), df)
