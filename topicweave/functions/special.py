"""Column functions of the models: log rising factorials, entropies, priors, and Stirling numbers for kernels."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Terms of a rising factorial that are summed one by one; Stirling's series has the others to about 1e-16.
TERMS = 64


def log_rising(n: Column, a: Column | float) -> Column:
    """lgamma(n + a) - lgamma(a) for whole n >= 0: the sum of ln(a + k) for k < n, whose time does not grow with n."""
    a = a if isinstance(a, Column) else F.lit(float(a))
    steps = F.when(n > 0, F.sequence(F.lit(0), F.least(n, F.lit(TERMS)).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0.0), lambda s, k: s + F.log(a + k)) + F.when(n > TERMS, stirling_series(a + n) - stirling_series(a + TERMS)).otherwise(0.0)


def stirling_series(x: Column) -> Column:
    """lgamma(x) for large x, less a constant."""
    return (x - 0.5) * F.log(x) - x + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)


def log_rising_histogram(table: DataFrame, n: str, a: float) -> DataFrame:
    """One row, v: the sum of log_rising over ``n``. Equal counts are computed once, so long counts cost once each."""
    each = table.groupBy(F.col(n).alias("_n")).agg(F.count("*").alias("_m"))
    return each.agg(F.coalesce(F.sum(F.col("_m") * log_rising(F.col("_n"), a)), F.lit(0.0)).alias("v"))


def log_sum_exp(x: Column, largest: Column) -> Column:
    """For an aggregation with the group's largest value at hand."""
    return largest + F.log(F.sum(F.exp(x - largest)))


def gamma_prior(x: Column | float, shape: float = 1.1, scale: float = 1.0) -> Column:
    """Log density of a gamma prior without its constant."""
    x = x if isinstance(x, Column) else F.lit(float(x))
    return (shape - 1) * F.log(x) - x / scale


@lru_cache(maxsize=64)
def log_stirling(size: int, discount: float) -> np.ndarray:
    """ln S(n, t) for n, t <= size: S(n + 1, t) = S(n, t - 1) + (n - discount * t) S(n, t)."""
    out = np.full((size + 1, size + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, size + 1)
    for n in range(size):
        grow = n - discount * t
        with np.errstate(divide="ignore"):
            stay = np.where((grow > 0) & (t <= n), np.log(np.maximum(grow, 1e-300)), -np.inf) + out[n, 1:]
        out[n + 1, 1:] = np.logaddexp(out[n, :-1], stay)
    return out


def stirling_ratios(size: int, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """U(n, t) = S(n + 1, t) / S(n, t) and V(n, t) = S(n, t) / S(n, t - 1)."""
    s = log_stirling(size + 1, discount)
    with np.errstate(invalid="ignore", over="ignore"):
        u = np.exp(s[1 : size + 2, : size + 1] - s[: size + 1, : size + 1])
        v = np.exp(s[: size + 1, 1 : size + 2] - s[: size + 1, : size + 1])
    return np.nan_to_num(u, posinf=0.0), np.nan_to_num(np.concatenate([np.zeros((size + 1, 1)), v[:, :-1]], axis=1), posinf=0.0)


def beta_draw(rng: np.random.Generator, a: float, b: float, tries: int = 50) -> float:
    """A beta draw strictly inside (0, 1), drawn again on underflow."""
    for _ in range(tries):
        x = rng.beta(a, b)
        if 0 < x < 1:
            return float(x)
    return a / (a + b)
