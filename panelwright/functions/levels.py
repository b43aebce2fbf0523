"""Interval levels and quantiles."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelwright.operators.frame import ArgumentError

FAN = tuple(range(51, 100, 3))
#: Quantiles are tabulated up to this many degrees of freedom; beyond, the expansion in 1/df is exact to 1e-9.
TABLE_DF = 60


def normalize_levels(level, fan: bool = False) -> list[float]:
    """Percentages in ascending order; fractions are percentages too."""
    given = FAN if fan else [level] if isinstance(level, (int, float)) else list(level)
    if not given:
        return []
    out = sorted({float(x) for x in given})
    if out[0] > 0 and out[-1] < 1:
        out = [round(100 * x, 10) for x in out]
    if out[0] <= 0 or out[-1] > 99.99:
        raise ArgumentError("levels lie above 0 and at most at 99.99")
    return out


def label(level: float) -> str:
    """0.8 and 80 -> '80'; 97.5 -> '97_5'."""
    level = 100 * level if level < 1 else level
    return f"{level:g}".replace(".", "_")


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    out = d
    for i in range(1, 500):
        for num in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def t_cdf(x: float, df: float) -> float:
    """Student's distribution function."""
    a, b, z = df / 2, 0.5, df / (df + x * x)
    if z >= 1:
        return 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(z) + b * math.log1p(-z))
    tail = front * _betacf(a, b, z) / a if z < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - z) / b
    return 1 - tail / 2 if x > 0 else tail / 2


@lru_cache(maxsize=4096)
def t_inverse(p: float, df: float) -> float:
    """Student's quantile by bisection."""
    if p < 0.5:
        return -t_inverse(1 - p, df)
    lo, hi = 0.0, 2.0
    while t_cdf(hi, df) < p and hi < 1e12:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def t_quantile(df: Column, p: float) -> Column:
    """Quantile of a column of whole degrees of freedom: a table at plan time, and the Cornish-Fisher expansion after it."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    terms = [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    series = F.lit(z)
    for k, t in enumerate(terms):
        series = series + F.lit(t) / F.pow(df.cast("double"), F.lit(float(k + 1)))
    table = F.array(*[F.lit(t_inverse(p, d)) for d in range(1, TABLE_DF + 1)])
    return F.when(df <= TABLE_DF, F.get(table, (df - 1).cast("int"))).otherwise(series)
