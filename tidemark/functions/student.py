"""Student t tail and quantile, as Arrow functions over small result tables.

The tail is half the regularised incomplete beta at v / (v + t^2), evaluated
directly so that it keeps its digits far below 1e-16.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_each_log_gamma = np.vectorize(math.lgamma, otypes=[float])


def _log_gamma(x):
    """Degrees are few, so most arguments recur."""
    some, place = np.unique(x, return_inverse=True)
    return _each_log_gamma(some)[place.ravel()].reshape(np.shape(x)) if some.size else np.zeros(np.shape(x))


def _fraction(a, b, x, most: int = 300):
    """Continued fraction of the incomplete beta, by backward evaluation.

    The terms that matter grow with the root of the larger parameter.
    """
    value = np.zeros_like(x)
    terms = min(most, 40 + int(8 * math.sqrt(max(np.max(a, initial=0), np.max(b, initial=0)))))
    for m in range(terms, 0, -1):
        half = m // 2
        if m % 2:
            step = -(a + half) * (a + b + half) * x / ((a + m - 1) * (a + m))
        else:
            step = half * (b - half) * x / ((a + m - 1) * (a + m))
        value = step / (1.0 + value)
    return 1.0 / (1.0 + value)


def incomplete_beta(a, b, x):
    """Regularised incomplete beta, elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore"):
        front = (
            _log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(y) + q * np.log1p(-y)
        )
    part = np.exp(front) / p * _fraction(p, q, y)
    return np.where(flip, 1.0 - part, part)


def tail(t, degrees):
    """P(T > t) for t >= 0."""
    t, v = np.asarray(t, dtype=float), np.asarray(degrees, dtype=float)
    return 0.5 * incomplete_beta(v / 2, 0.5, v / (v + t * t))


def quantile(p, degrees):
    """The t with P(T <= t) = p for p >= 0.5, by bisection."""
    p, v = np.broadcast_arrays(np.asarray(p, float), np.asarray(degrees, float))
    # Rows that ask the same are answered once.
    asked, place = np.unique(np.stack([p.ravel(), v.ravel()]), axis=1, return_inverse=True)
    return _bisected(*asked)[place.ravel()].reshape(p.shape)


def _bisected(p, v):
    found, at = np.zeros(len(p)), np.arange(len(p))
    low, high = np.zeros(len(p)), np.full(len(p), 1e9)
    for _ in range(120):
        middle = (low + high) / 2
        above = tail(middle, v) > 1 - p
        low, high = np.where(above, middle, low), np.where(above, high, middle)
        # Halving is over where no number lies between the ends.
        found[at] = (low + high) / 2
        going = (found[at] > low) & (found[at] < high)
        at, p, v, low, high = (x[going] for x in (at, p, v, low, high))
        if not len(at):
            break
    return found


def _where_defined(function, first: pd.Series, degrees: pd.Series) -> pd.Series:
    fine = first.notna() & (degrees > 0)
    result = pd.Series(np.nan, index=first.index)
    if fine.any():
        result[fine] = function(first[fine].to_numpy(), degrees[fine].to_numpy())
    return result.astype(object).where(fine, None)


@pandas_udf(DoubleType())
def t_tail(t: pd.Series, degrees: pd.Series) -> pd.Series:
    return _where_defined(tail, t, degrees)


@pandas_udf(DoubleType())
def t_quantile(p: pd.Series, degrees: pd.Series) -> pd.Series:
    return _where_defined(quantile, p, degrees)
