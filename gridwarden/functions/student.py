"""Student's t for any degrees of freedom: two-sided p-values and quantiles.

The p-value is the regularised incomplete beta function I_x(df / 2, 1 / 2) at x = df / (df + t^2),
from its continued fraction.  Callers apply these to one row for each group, never to data rows.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql.functions import pandas_udf


def _fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function, by the modified Lentz method."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(tiny, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    h = d
    for m in range(1, 100_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """I_x(a, b)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _fraction(b, a, 1 - x) / b


def two_sided(t: float, df: float) -> float:
    """Probability of a larger |t|; nan without a degree of freedom."""
    if df is None or t is None or df < 1 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return math.erfc(abs(t) / math.sqrt(2)) if df > 1e8 else beta_share(df / 2, 0.5, df / (df + t * t))


def quantile(df: float, share: float = 0.95) -> float:
    """The t that |t| exceeds with probability 1 - share, by bisection; nan without a degree of freedom."""
    if df is None or df < 1:
        return math.nan
    lo, hi = 0.0, 1.0
    while two_sided(hi, df) > 1 - share:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if mid in (lo, hi):
            break
        lo, hi = (mid, hi) if two_sided(mid, df) > 1 - share else (lo, mid)
    return (lo + hi) / 2


def two_sided_udf():
    @pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else two_sided(float(a), float(b)) for a, b in zip(t, df)], dtype="float64")

    return p


def quantile_udf(share: float = 0.95):
    @pandas_udf("double")
    def q(df: pd.Series) -> pd.Series:
        known = {n: quantile(float(n), share) for n in set(df.dropna().tolist()) if n >= 1}
        return pd.Series([known.get(n) for n in df], dtype="float64")

    return q
