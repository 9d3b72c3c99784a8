"""Sets of hashed word shingles of whole texts, and their signatures, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Words of a shingle.
WORDS = 5
BATCH_BYTES = 1_000_000

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
_PLACE = _random.integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)
_SHORT = _random.integers(0, 1 << 64, WORDS, dtype=np.uint64)
_BASE = int(_random.integers(0, 1 << 62)) * 2 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """A hash for each lower-cased (A-Z) word, the bounds of each text (len + 1), and the bytes with the first and last place of each word."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]  # of bytes: A-Z alone
    joined = b" ".join([*raw, b""])
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    words = mixed((total[last] - total[first]) * down[first] if len(first) else np.zeros(0, np.uint64))
    return words, np.concatenate([[0], np.searchsorted(first, ends)]).astype(np.int64), joined, first, last


def shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, sorted within a text, and the bounds of each text (len + 1)."""
    words, bounds, *_ = word_hashes(texts)
    n = max(0, len(words) - WORDS + 1)
    windows = np.zeros(n, np.uint64)
    for k in range(WORDS):
        windows += words[k : k + n] * _PLACE[k]
    windows = mixed(windows)
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            sets.append(np.unique(windows[a : b - WORDS + 1]))
        elif b > a:
            sets.append(mixed((words[a:b] * _PLACE[: b - a]).sum(keepdims=True) + _SHORT[b - a]))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of a bounded size together, but for a text that is longer by itself."""
    k = 0
    while k < len(sizes):
        n, size = k, 0
        while n < len(sizes) and (n == k or size + sizes[n] <= BATCH_BYTES):
            size += sizes[n]
            n += 1
        yield k, n
        k = n


def slices(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Parts of a frame by ``cuts`` of its texts."""
    for a, b in cuts(part["text"].str.len().to_numpy()):
        yield part.iloc[a:b]


def per_text(function: np.ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """``function`` over the values of each text; ``empty`` for a text without any."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    some = bounds[1:] > bounds[:-1]
    if some.any():
        out[some] = function.reduceat(values, bounds[:-1][some])
    return out


def set_digests(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """16 bytes for each set, whatever its order."""
    two = [per_text(np.add, mixed(values ^ np.uint64(c)), bounds, 0) for c in (0x243F6A8885A308D3, 0x13198A2E03707344)]
    return [x.tobytes() for x in np.stack(two, axis=1)]


def minima(values: np.ndarray, bounds: np.ndarray, count: int, seed: int = 5) -> np.ndarray:
    """``count`` 32-bit min-hashes for each set."""
    random = np.random.default_rng(seed)
    out = np.empty((len(bounds) - 1, count), np.uint32)
    for k in range(count):
        a, b = random.integers(0, 1 << 64, 2, dtype=np.uint64)
        out[:, k] = per_text(np.minimum, ((values * (a | np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32), bounds, 0xFFFFFFFF)
    return out
