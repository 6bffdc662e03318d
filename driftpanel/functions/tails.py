"""Tail probabilities of t, F and the studentized range, for small aggregated tables.

Arrow-batched functions over numpy; they run on a handful of summary rows, never on data rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float, y: float) -> float:
    """Continued fraction of the incomplete beta function, two steps in one (modified Lentz).

    ``y`` is ``1 - x``. With it no difference of nearly equal numbers is formed when ``a`` is huge.
    """
    tiny = 1e-300

    def odd(m: int) -> float:
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    def one_plus_odd(m: int) -> float:
        if x <= y:
            return 1.0 + odd(m)
        rest = a * (2 * m + 1 - b) + m * (3 * m + 2 - b) + (a + m) * (a + b + m) * y
        return rest / ((a + 2 * m) * (a + 2 * m + 1))

    out = one_plus_odd(0) or tiny
    c, d = out, 0.0
    for m in range(1, 5000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        above, level = -odd(m - 1) * even, even + one_plus_odd(m)
        d = 1.0 / (level + above * d or tiny)
        c = level + above / c or tiny
        out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return 1.0 / out


def _log_beta(a: float, b: float) -> float:
    """Logarithm of the beta function; by Stirling's series where one argument is large."""
    a, b = max(a, b), min(a, b)
    if a < 20.0:
        return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)

    def rest(z: float) -> float:
        q = 1.0 / (z * z)
        return (1 / 12 - q * (1 / 360 - q * (1 / 1260 - q * (1 / 1680 - q / 1188)))) / z

    rise = (a - 0.5) * math.log1p(b / a) + b * math.log(a + b) - b + rest(a + b) - rest(a)
    return math.lgamma(b) - rise


def beta_inc(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularized incomplete beta function; ``y`` is ``1 - x`` where the caller knows it better."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    log_x = math.log(x) if x < y else math.log1p(-y)
    log_y = math.log(y) if y <= x else math.log1p(-x)
    front = math.exp(a * log_x + b * log_y - _log_beta(a, b))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x, y) / a
    return 1.0 - front * _beta_fraction(b, a, y, x) / b


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return beta_inc(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if f <= 0:
        return 1.0
    total = df2 + df1 * f
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / total, df1 * f / total)


def _bisect(tail, target: float) -> float:
    """Point where a decreasing tail reaches ``target``."""
    low, high = 0.0, 1.0
    while tail(high) > target:
        low, high = high, high * 2.0
    while high - low > 1e-13 * high:
        middle = (low + high) / 2.0
        if middle in (low, high):
            break
        if tail(middle) > target:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


@lru_cache
def t_quantile(confidence: float, df: float) -> float:
    """Half width, in standard errors, of a two-sided t interval."""
    return _bisect(lambda v: t_tail(v, df), 1.0 - confidence)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(128)
_normal_cdf = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2.0)), otypes=[float])


def _spread_nodes(low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    half = (high - low) / 2.0
    return low + half * (_NODES + 1.0), half * _WEIGHTS


def _range_cdf(w: np.ndarray, k: int) -> np.ndarray:
    """P(range of k standard normals <= w)."""
    z, weight = _spread_nodes(-8.5, 8.5)
    density = np.exp(-z * z / 2.0) / math.sqrt(2.0 * math.pi)
    upper = _normal_cdf(z)
    gap = np.clip(upper[None, :] - _normal_cdf(z[None, :] - w[:, None]), 0.0, 1.0)
    return np.clip(k * (weight * density * gap ** (k - 1)).sum(axis=1), 0.0, 1.0)


def tukey_tail(q: float, k: int, df: float) -> float:
    """P(studentized range of k means > q)."""
    if q <= 0:
        return 1.0
    spread = 9.0 / math.sqrt(2.0 * df)
    off, weight = _spread_nodes(max(1e-8 - 1.0, -spread), spread)
    # Density of the scale 1 + off but for a constant, without large terms that cancel.
    log_s = np.log1p(off)
    mass = weight * np.exp(df * (log_s - off - off * off / 2.0) - log_s)
    inside = (mass * _range_cdf(q * (1.0 + off), k)).sum() / mass.sum()
    return float(np.clip(1.0 - inside, 0.0, 1.0))


@lru_cache
def tukey_quantile(confidence: float, k: int, df: float) -> float:
    return _bisect(lambda v: tukey_tail(v, k, df), 1.0 - confidence)


def _rowwise(fn, *columns: pd.Series) -> pd.Series:
    """Apply to rows where every argument is present."""
    table = pd.concat(columns, axis=1)
    ok = table.notna().all(axis=1)
    out = pd.Series(np.nan, index=table.index)
    out[ok] = [fn(*row) for row in table[ok].itertuples(index=False, name=None)]
    return out.astype(object).where(ok, None).astype("Float64")


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_tail, t, df)


@F.pandas_udf(DoubleType())
def t_half_width(confidence: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(t_quantile, confidence, df)


@F.pandas_udf(DoubleType())
def f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return _rowwise(f_tail, f, df1, df2)


@F.pandas_udf(DoubleType())
def tukey_upper(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(lambda a, b, c: tukey_tail(a, int(b), c), q, k, df)


@F.pandas_udf(DoubleType())
def tukey_half_width(confidence: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    return _rowwise(lambda a, b, c: tukey_quantile(a, int(b), c), confidence, k, df)
