"""Tail probabilities of the test statistics, for Pandas functions over small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function I_x(a, b), by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(tiny, 1 - (a + b) * x / (a + 1))
    total = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * total


def t_two_sided(t: float, df: float) -> float:
    return beta_tail(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def kolmogorov_tail(d: float, n1: float, n2: float) -> float:
    """Two-sided asymptotic probability of a two-sample distance of at least ``d``."""
    en = math.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + 0.11 / en) * d
    if x < 1e-3:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


#: Sample sizes up to which a Kolmogorov-Smirnov distance has its exact probability; beyond them it has the asymptotic one.
EXACT_KS = 10_000
#: U has its exact probability without ties if the smaller sample has at most so many values and U at most so many.
EXACT_U, EXACT_U_RANGE = 8, 100_000


def kolmogorov_exact(d: float, n1: int, n2: int) -> float:
    """Probability that the orders of two samples, all equally likely, have a distance of at least ``d``.

    Orders are lattice paths from (0, 0) to (n1, n2). The share of paths to (i, j) that were outside follows from those to
    (i - 1, j) and (i, j - 1), a diagonal i + j at a time, so nothing overflows and small probabilities keep their digits.
    """
    common = math.gcd(n1, n2)
    far = round(d * (n1 // common) * n2) * common
    if far <= 0:
        return 1.0
    total = n1 + n2
    i = np.arange(n1 + 1, dtype=np.float64)
    share = np.ones(n1 + 2)  # of place i at i + 1; outside the band it stays 1
    share[1] = 0.0
    for s in range(1, total + 1):
        lo, hi = max(0, s - n2, (s * n1 - far) // total + 1), min(n1, s, -((-s * n1 - far) // total) - 1)
        fresh = ((s - i[lo : hi + 1]) * share[lo + 1 : hi + 2] + i[lo : hi + 1] * share[lo : hi + 1]) / s
        share[lo + 1 : hi + 2] = fresh
        share[lo] = 1.0
    return float(share[n1 + 1])


def u_at_most(u: float, n1: int, n2: int) -> float:
    """Exact probability that U of two samples without ties is at most ``u``, by whole-number counts of its values."""
    counts = np.zeros(n1 * n2 + 1, dtype=object)
    counts[0] = 1
    small, large = sorted((n1, n2))
    for k in range(1, small + 1):  # times (1 - q ** (large + k)) / (1 - q ** k)
        up = large + k
        if up <= n1 * n2:
            counts[up:] = counts[up:] - counts[:-up]
        for first in range(min(k, len(counts))):
            counts[first::k] = np.add.accumulate(counts[first::k])
    return int(sum(counts[: math.floor(u) + 1])) / math.comb(n1 + n2, n1) if u >= 0 else 0.0


@F.pandas_udf(DoubleType())
def p_welch(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) else t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def p_upper(z: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else normal_tail(v) for v in z], dtype="float64")


@F.pandas_udf(DoubleType())
def p_ks(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact up to ``EXACT_KS`` values in the larger sample."""
    exact = lambda x, a, b: kolmogorov_exact(x, int(a), int(b)) if max(a, b) <= EXACT_KS else kolmogorov_tail(x, a, b)
    return pd.Series([None if pd.isna(v[0]) else exact(*v) for v in zip(d, n1, n2, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def p_u(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    """Exact probability of a U of at most ``u``; null where the normal approximation is to be used."""
    fits = lambda a, b, t: t == 0 and min(a, b) <= EXACT_U and a * b <= EXACT_U_RANGE
    return pd.Series([u_at_most(x, int(a), int(b)) if fits(a, b, t) else None for x, a, b, t in zip(u, n1, n2, ties, strict=True)], dtype="float64")
