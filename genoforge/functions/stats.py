"""Test statistics as columns where arithmetic is enough, and as Arrow functions where it isn't."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_2x2(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Pearson's statistic of a 2 x 2 table; 0 where the product of the margins is 0."""
    margins = (a + b).cast("double") * (c + d) * (a + c) * (b + d)
    return F.when(margins <= 1e-10, 0.0).otherwise((a + b + c + d) * F.pow(a.cast("double") * d - b.cast("double") * c, 2) / margins)


def chi2_table(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """chi2_2x2 of arrays."""
    a, b, c, d = (np.asarray(x, float) for x in (a, b, c, d))
    margins = (a + b) * (c + d) * (a + c) * (b + d)
    some = margins > 1e-10
    return np.where(some, (a + b + c + d) * (a * d - b * c) ** 2 / np.where(some, margins, 1.0), 0.0)


def odds_ratio(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Odds ratio; if any cell is 0, with 0.5 more in every cell."""
    more = F.when((a == 0) | (b == 0) | (c == 0) | (d == 0), 0.5).otherwise(0.0)
    return (a + more) * (d + more) / ((b + more) * (c + more))


def log_factorials(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])


@F.pandas_udf(DoubleType())
def fisher_2x2(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided exact p: all tables with the margins that are no likelier than the one seen."""
    cells = np.stack([a, b, c, d], 1).astype(np.int64) if len(a) else np.zeros((0, 4), np.int64)
    lf = log_factorials(int(cells.sum(1).max()) if len(cells) else 0)
    out, seen = [], {}
    for key in map(tuple, cells.tolist()):
        if key not in seen:
            w, x, y, z = key
            n, row, col = w + x + y + z, w + x, w + y
            k = np.arange(max(0, row + col - n), min(row, col) + 1)
            p = np.exp(lf[row] + lf[n - row] + lf[col] + lf[n - col] - lf[n] - lf[k] - lf[row - k] - lf[col - k] - lf[n - row - col + k])
            seen[key] = min(1.0, float(p[p <= p[w - k[0]] * (1 + 1e-7)].sum()))
        out.append(seen[key])
    return pd.Series(out, dtype=float)


def hwe_p(het: int, hom1: int, hom2: int) -> float:
    """Exact Hardy-Weinberg p: all heterozygote counts no likelier than the one seen; 1 without genotypes."""
    n, rare = het + hom1 + hom2, 2 * min(hom1, hom2) + het
    if n == 0:
        return 1.0
    h = np.arange(rare % 2, rare + 1, 2)
    lf = log_factorials(2 * n)
    a, b = (rare - h) // 2, n - h - (rare - h) // 2
    p = np.exp(h * math.log(2) + lf[n] - lf[h] - lf[a] - lf[b] + lf[rare] + lf[2 * n - rare] - lf[2 * n])
    return min(1.0, float(p[p <= p[(het - rare % 2) // 2] * (1 + 1e-7)].sum()))


@F.pandas_udf(DoubleType())
def hwe_exact(het: pd.Series, hom1: pd.Series, hom2: pd.Series) -> pd.Series:
    seen: dict[tuple, float] = {}
    keys = list(zip(het.astype(int), hom1.astype(int), hom2.astype(int)))
    return pd.Series([seen[k] if k in seen else seen.setdefault(k, hwe_p(*k)) for k in keys], dtype=float)


def chi2_tail(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution, from the incomplete gamma function's series or continued fraction."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    start = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-14:
            k += 1
            term *= x / k
            total += term
        return 1 - total * start
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return start * h


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else chi2_tail(float(v), int(k)) for v, k in zip(x, df)], dtype=float)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal statistic."""
    return pd.Series([None if pd.isna(v) else 2 * normal_tail(abs(float(v))) for v in z], dtype=float)
