"""Hashes of all windows of a text at once, and winnowing, in numpy on 64-bit integers."""

from __future__ import annotations

import numpy as np

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
SECOND = 0xD6E8FEB86659FD93
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOW, HIGH = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFF00000000)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spreads 64-bit values over all bits (one to one for each salt)."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[65:91] += 32
LOWERED = BYTES[LETTERS]
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def powers(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.multiply.accumulate(grown)
    return _powers[base][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers of the base: one more than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=out[1:])
    return out


def windows(values: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash for every window of ``size`` values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = sums(values)
    return mixed((s[size:] - s[:n]) * powers(INVERSE, n), salt)


def spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, salt: int = 0) -> np.ndarray:
    """A hash for each span [start, stop) of values; its length is part of it."""
    s = sums(values)
    return mixed((s[stops] - s[starts]) * powers(INVERSE, len(values) + 1)[starts] + (stops - starts).astype(np.uint64) * np.uint64(SECOND), salt)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words between ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACES[data]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)


def word_hashes(data: np.ndarray, lowered: bool = False) -> np.ndarray:
    starts, stops = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    return spans((LOWERED if lowered else BYTES)[data], starts, stops)


def smallest(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every window of consecutive hashes the position of its smallest (leftmost on ties): ascending."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low = (hashes & HIGH) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size < window:
        step = min(size, window - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    return (low & LOW).astype(np.int64)


def once(ascending: np.ndarray) -> np.ndarray:
    return ascending[np.concatenate([[True], ascending[1:] != ascending[:-1]])] if len(ascending) else ascending
