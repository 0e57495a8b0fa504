"""Tail probabilities of the test statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def kolmogorov_tail(x: Column, terms: int = 40) -> Column:
    """Asymptotic two-sided tail of the Kolmogorov distribution."""
    acc = F.lit(0.0)
    for k in range(1, terms + 1):
        acc = acc + F.lit(2.0 if k % 2 else -2.0) * F.exp(F.lit(-2.0 * k * k) * x * x)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(acc, F.lit(0.0)), F.lit(1.0)))


def ks_pvalue(stat: Column, n1: Column, n2: Column) -> Column:
    return kolmogorov_tail(stat * F.sqrt(n1 * n2 / (n1 + n2)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            t = 1.0
        elif i % 2 == 0:
            t = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            t = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / (1.0 + t * d or tiny)
        c = 1.0 + t / c or tiny
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation: Student t with n - 2 degrees of freedom."""
    if n < 3 or r is None or math.isnan(r):
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def correlation_pvalue(r: Column, n: Column) -> Column:
    """On result rows (one per group), not on samples."""
    @pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, int(b)) for a, b in zip(rs, ns)])
    return p(r, n)
