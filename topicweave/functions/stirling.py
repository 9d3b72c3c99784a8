"""Generalised Stirling numbers of a discount a, S(n + 1, t) = S(n, t - 1) + (n - a t) S(n, t), by ratios of neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np

#: Customers up to which every row of ratios is kept, and the step from one kept row to the next beyond; customers beyond which ratios are taken as they are there.
ALL_ROWS, STEP, LIMIT = 256, 1.03, 200_000
#: Pairs whose weights a worker keeps.
KNOWN = 200_000


def ratio_rows(a: float, tables: int) -> Iterator[np.ndarray]:
    """For n = 1, 2, ... V(n, t) = S(n, t) / S(n, t - 1), t = 0 .. tables; 0 where t > n, and infinite at t = 1 as S(n, 0) is 0.

    With V at hand no number of the size of S is needed:
    V(n + 1, t) = (1 + (n - a t) V(n, t)) / (1 / V(n, t - 1) + n - a (t - 1)).
    """
    t = np.arange(tables + 1)
    v = np.zeros(tables + 1)
    v[1:2] = np.inf
    n = 1
    while True:
        yield v
        new = np.zeros(tables + 1)
        new[1:2] = np.inf
        last = min(n + 1, tables)
        if last >= 2:
            with np.errstate(divide="ignore"):
                below = np.where(v[1:last] > 0, 1.0 / v[1:last], np.inf) + n - a * t[1:last]
            new[2 : last + 1] = (1.0 + (n - a * t[2 : last + 1]) * v[2 : last + 1]) / below
        v, n = new, n + 1


class Ratios:
    """V(n, t) for n up to ``customers`` and t up to ``tables``; between kept rows by the logarithm of n."""

    def __init__(self, a: float, customers: int, tables: int, all_rows: int = ALL_ROWS):
        self.a, self.tables = a, tables
        customers = min(max(customers, 2), LIMIT)
        kept, rows, due = [], [], 1.0
        for n, v in enumerate(ratio_rows(a, tables + 1), 1):
            if n >= due or n == customers:
                kept.append(n)
                rows.append(v)
                due = n + 1 if n < all_rows else n * STEP
            if n == customers:
                break
        self.kept = np.array(kept, dtype=float)
        self.rows = np.stack(rows)
        self.known: dict[tuple[int, int], tuple[float, float]] = {}

    def of(self, n: np.ndarray, t: np.ndarray) -> np.ndarray:
        """V(n, t), 1 <= t <= tables + 1, for n >= 1."""
        n = np.minimum(n, self.kept[-1])
        hi = np.searchsorted(self.kept, n)
        lo = np.maximum(hi - (self.kept[hi] > n), 0)
        high = self.rows[hi, t]
        if (lo == hi).all():
            return high
        with np.errstate(invalid="ignore"):
            part = np.where(lo == hi, 0.0, np.log(n / self.kept[lo]) / np.log(np.where(lo == hi, np.e, self.kept[hi] / self.kept[lo])))
            low = self.rows[lo, t]
            return np.where(lo == hi, high, low + part * (high - low))

    def seats(self, n: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """S(n + 1, t + 1) / S(n, t) and S(n + 1, t) / S(n, t): one more customer at a new table or at an old one. n = t = 0 opens with 1; no table beyond ``tables`` is opened."""
        some = n > 0
        m, s = np.where(some, n, 1), np.where(some, t, 1)
        opens = 1.0 + np.maximum(m - self.a * (s + 1), 0.0) * self.of(m, np.minimum(s + 1, self.tables + 1))
        here = self.of(m, np.minimum(s, self.tables + 1))
        with np.errstate(divide="ignore"):
            stays = m - self.a * s + np.where(np.isfinite(here) & (here > 0), 1.0 / here, 0.0)
        return np.where(some & (t >= self.tables), 0.0, np.where(some, opens, 1.0)), np.where(some, stays, 0.0)


    def seat(self, n: int, t: int) -> tuple[float, float]:
        """``seats`` for one pair, times (t + 1) / (n + 1) and (n - t + 1) / (n + 1); pairs nearby are kept with it."""
        found = self.known.get((n, t))
        if found is None:
            if len(self.known) > KNOWN:
                self.known.clear()
            m = np.arange(max(n - 8, t), n + 9) if t else np.array([n])
            opens, stays = self.seats(m, np.full(len(m), t))
            self.known.update(zip(((x, t) for x in m.tolist()), zip((opens * (t + 1) / (m + 1)).tolist(), (stays * (m - t + 1) / (m + 1)).tolist(), strict=True), strict=True))
            found = self.known[n, t]
        return found


@lru_cache(maxsize=8)
def ratios(a: float, customers: int, tables: int) -> Ratios:
    return Ratios(a, customers, tables)


def grown(a: float, customers: int, tables: int) -> Ratios:
    """A table that holds at least so much, and is made again only when twice as much is asked for."""
    return ratios(a, 1 << max(int(customers).bit_length(), 4), 1 << max(int(tables).bit_length(), 4))


def log_stirling_of(n: np.ndarray, t: np.ndarray, a: float) -> np.ndarray:
    """ln S(n, t) for pairs 1 <= t <= n: ln S(n, 1) and the logarithms of the ratios above it.

    One pass up to the largest n serves all pairs; beyond LIMIT the ratios are
    those at LIMIT, to which they converge.
    """
    n, t = np.asarray(n, np.int64), np.asarray(t, np.int64)
    out = np.array([lgamma(x - a) - lgamma(1 - a) for x in n.tolist()])
    if not len(n) or int(t.max()) < 2:
        return out
    at = np.minimum(n, LIMIT)
    wanted = set(at.tolist())
    last = int(at.max())
    for k, v in enumerate(ratio_rows(a, int(t.max())), 1):
        if k in wanted:
            with np.errstate(divide="ignore"):
                run = np.concatenate([[0.0, 0.0], np.cumsum(np.log(v[2:]))])
            rows = at == k
            out[rows] += run[t[rows]]
        if k == last:
            return out
    return out
