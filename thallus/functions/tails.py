"""Upper-tail probabilities for result rows (one row per term, pair or taxon)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction (modified Lentz)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_tail(b, a, 1 - x)
    tiny = 1e-300
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    ) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def f_tail(f: float, df1: float, df2: float) -> float:
    if not (df1 > 0 and df2 > 0) or math.isnan(f):
        return math.nan
    return beta_tail(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return f_tail(t * t, 1, df)


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: float) -> float:
    """Upper regularised incomplete gamma Q(df/2, x/2)."""
    if math.isnan(x) or not df > 0:
        return math.nan
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - scale * total
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        value *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * value


def rank_sum_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact rank-sum p for untied samples: ways to reach each U by adding one value at a time."""
    ways = np.zeros((n2 + 1, n1 * n2 + 1))
    ways[:, 0] = 1.0
    for _ in range(n1):
        fresh = np.zeros_like(ways)
        fresh[0] = ways[0]
        for j in range(1, n2 + 1):
            fresh[j] = fresh[j - 1]
            fresh[j, j:] += ways[j, : n1 * n2 + 1 - j]
        ways = fresh
    share = ways[n2] / ways[n2].sum()
    u = min(u, n1 * n2 - u)
    return min(1.0, 2 * share[: int(math.floor(u)) + 1].sum())


def _row_wise(function, *cols: Column) -> Column:
    @F.pandas_udf("double")
    def tail(first: pd.Series, *rest: pd.Series) -> pd.Series:
        rows = zip(first, *rest)
        return pd.Series([None if any(pd.isna(v) for v in row) else function(*row) for row in rows], dtype="float64")

    return tail(*cols)


def f_p(f: Column, df1: Column, df2: Column) -> Column:
    return _row_wise(f_tail, f, df1, df2)


def t_p(t: Column, df: Column) -> Column:
    return _row_wise(t_tail, t, df)


def normal_p(z: Column) -> Column:
    return _row_wise(normal_tail, z)


def chi2_p(x: Column, df: Column) -> Column:
    return _row_wise(chi2_tail, x, df)
