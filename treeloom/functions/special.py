"""Tails of distributions that Spark SQL has no functions for, as plain and Arrow-backed functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

#: Tables as probable as the observed one, up to rounding, count into a two-sided tail.
SLACK = 1e-7


def chi2_sf(x: float, df: float) -> float:
    """P(X >= x) of a chi-square distribution: the regularised upper incomplete gamma of (df/2, x/2)."""
    if df <= 0 or x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:  # series of the lower function
        term = total = 1 / a
        k = a
        while term > total * 1e-17:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300  # continued fraction of the upper one, by Lentz
    b = z + 1 - a
    c, d = 1 / tiny, 1 / b
    out = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * out


#: Standard deviations from the mode beyond which a probability counts as nought.
FAR = 40


def _two_sided(low: int, high: int, mode: int, deviation: float, seen: int, ratio) -> float:
    """The chance of all outcomes no more probable than ``seen``; ``ratio(x)`` is P(x + 1) / P(x), of an array.

    Only outcomes within FAR deviations of the mode are held, whatever the range from ``low`` to ``high``.
    """
    reach = int(FAR * deviation) + 50
    low, high = max(low, mode - reach), min(high, mode + reach)
    if not low <= seen <= high:
        return 0.0
    steps = np.log(ratio(np.arange(low, high, dtype=float)))
    p = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(p - p.max())
    return float(min(1.0, p[p <= p[seen - low] * (1 + SLACK)].sum() / p.sum()))


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's exact test of [[a, b], [c, d]]: the chance of all tables no more probable."""
    row, column, n = a + b, a + c, a + b + c + d
    low, high = max(0, row + column - n), min(row, column)
    if low == high:
        return 1.0
    mode = min(max((row + 1) * (column + 1) // (n + 2), low), high)
    deviation = math.sqrt(row / n * column / n * (n - row) * (n - column) / max(n - 1, 1))
    return _two_sided(low, high, mode, deviation, a, lambda x: (row - x) * (column - x) / ((x + 1) * (n - row - column + x + 1)))


def sign_test(positive: int, n: int) -> float:
    """Two-sided exact binomial test of a fair coin; 1 where there are no trials."""
    return _two_sided(0, n, n // 2, math.sqrt(n) / 2, positive, lambda x: (n - x) / (x + 1)) if n else 1.0


def signed_rank_p(w: float, n: int, ties: float) -> float:
    """The two-sided normal p of a signed-rank statistic; ``ties`` is the sum of k^3 - k over groups of k equal sizes."""
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(2 * spread)) if spread > 0 else 1.0


def wilcoxon(differences: np.ndarray) -> tuple[float, float]:
    """Signed-rank statistic min(W+, W-) and its two-sided normal p-value, corrected for ties; zeros dropped."""
    d = np.asarray(differences, float)
    d = d[d != 0]
    if not len(d):
        return 0.0, 1.0
    _, inverse, count = np.unique(np.abs(d), return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[inverse]
    w = float(min(rank[d > 0].sum(), rank[d < 0].sum()))
    return w, signed_rank_p(w, len(d), float((count.astype(float) ** 3 - count).sum()))


@F.pandas_udf(T.DoubleType())
def chi2_tail(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else chi2_sf(a, b) for a, b in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fisher_tail(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([fisher_two_sided(*map(int, x)) for x in zip(a, b, c, d, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sign_tail(positive: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([sign_test(int(a), int(b)) for a, b in zip(positive, n, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def signed_rank_tail(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(float(a), int(b), float(c)) for a, b, c in zip(w, n, ties, strict=True)], dtype="float64")
