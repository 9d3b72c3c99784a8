"""Sampling of one parameter at a time from histograms of counts: the table is reduced by Spark, the density is cheap."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stirling import log_stirling_of


def histogram(table: DataFrame, *columns: str) -> np.ndarray:
    """Distinct values of whole columns with their number of rows; as many rows as there are distinct counts."""
    rows = table.groupBy(*columns).agg(F.count("*").cast("long").alias("_m")).toArrow()
    return np.array([rows[c].to_numpy() for c in (*columns, "_m")], dtype=float).T.reshape(-1, len(columns) + 1)


def g_sum(hist: np.ndarray, a: float) -> float:
    """sum of m * (lgamma(n + a) - lgamma(a)) over (n, m)."""
    return sum(m * (math.lgamma(n + a) - math.lgamma(a)) for n, m in hist)


def slice_sample(density: Callable[[float], float], x: float, low: float, high: float, rng: np.random.Generator, steps: int = 3) -> float:
    """A draw from a log density on (low, high) after some slice steps from x, on the log scale."""
    lo, hi = math.log(low), math.log(high)
    f = lambda t: density(math.exp(t)) + t
    t = min(max(math.log(x), lo), hi)
    for _ in range(steps):
        level = f(t) - rng.exponential()
        left = max(lo, t - rng.random())
        right = min(hi, left + 1.0)
        while left > lo and f(left) > level:
            left = max(lo, left - 1.0)
        while right < hi and f(right) > level:
            right = min(hi, right + 1.0)
        for _ in range(50):
            new = rng.uniform(left, right)
            if f(new) > level:
                t = new
                break
            left, right = (new, right) if new < t else (left, new)
    return math.exp(t)


def log_gamma_prior(x: float, shape: float = 1.1, scale: float = 1.0) -> float:
    return (shape - 1) * math.log(x) - x / scale


def dirichlet_weight(cells: np.ndarray, totals: np.ndarray, size: int) -> Callable[[float], float]:
    """The log density of an even weight, of cell counts and group totals."""
    return lambda w: g_sum(cells, w) - g_sum(totals, w * size) + log_gamma_prior(w)


def concentration(totals: np.ndarray, tables: np.ndarray, a: float) -> Callable[[float], float]:
    """The log density of b, of histograms of group totals and of tables by group."""

    def f(b: float) -> float:
        up = sum(m * t * math.log(b) for t, m in tables) if a == 0 else g_sum(tables, b / a)
        return up - g_sum(totals, b) + log_gamma_prior(b, 1.1, 100.0)

    return f


def discount(cells: np.ndarray, tables: np.ndarray, b: float, log_stirling: Callable[[int, int, float], float]) -> Callable[[float], float]:
    """The log density of a, of histograms of (n, t) and of tables by group."""

    def f(a: float) -> float:
        seats = sum(m * log_stirling(int(n), int(t), a) for n, t, m in cells)
        return seats + sum(m * t * math.log(a) for t, m in tables) + g_sum(tables, b / a)

    return f


def rising(hist: np.ndarray, b: float, a: float) -> float:
    """sum of m * ln(b (b + a) ... (b + (t - 1) a)) over (t, m)."""
    if a == 0:
        return sum(m * t * math.log(b) for t, m in hist)
    return sum(m * t * math.log(a) for t, m in hist) + g_sum(hist, b / a)


def seated_discount(cells: np.ndarray, tables: np.ndarray, b: float) -> Callable[[float], float]:
    """The log density of a, of the joint histogram of customers and tables (n, t, m) and that of tables by group."""
    return lambda a: float((cells[:, 2] * log_stirling_of(cells[:, 0], cells[:, 1], a)).sum()) + rising(tables, b, a)


def root_concentration(root: np.ndarray, kind: str, a0: float, size: int) -> Callable[[float], float]:
    """The log density of b0, of a histogram of the tables of each dish: Dirichlet with even weights (hdp), or sticks (hpdd)."""
    used, total = root[:, 1].sum(), float((root[:, 0] * root[:, 1]).sum())

    def f(b0: float) -> float:
        up = g_sum(root, b0 / size) if kind == "hdp" else rising(np.array([(used, 1.0)]), b0, a0)
        return up - g_sum(np.array([(total, 1.0)]), b0) + log_gamma_prior(b0, 1.1, 100.0)

    return f


def root_discount(root: np.ndarray, b0: float) -> Callable[[float], float]:
    """The log density of a0 of a root of sticks."""
    used = np.array([(root[:, 1].sum(), 1.0)])
    return lambda a0: rising(used, b0, a0) + g_sum(np.column_stack([root[:, 0] - 1, root[:, 1]]), 1 - a0)
