"""Hashes of many spans of one buffer at once, by prefix sums of a polynomial modulo 2**64."""

from __future__ import annotations

import numpy as np

#: Length of the buffers that the kept table of powers serves; longer ones get a table for the occasion.
KEPT = 1 << 21
_BASE = 0xD6E8FEB86659FD93
_table: list[np.ndarray] = []


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, "u8")
    p[0] = 1
    return np.multiply.accumulate(p)


def spans(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values[start + i] * base**(KEPT + i) over each span: the same for equal spans wherever they stand, in any buffer."""
    if not _table:
        _table.append(_powers(_BASE, KEPT + 1))
    n = len(values)
    up = _table[0] if n <= KEPT else _powers(_BASE, n + 1)
    total = np.zeros(n + 1, "u8")
    np.cumsum(values * up[:n], out=total[1:])
    if n <= KEPT:
        return (total[end] - total[start]) * up[KEPT - start]
    scale = np.uint64(pow(_BASE, KEPT, 1 << 64))
    return (total[end] - total[start]) * _powers(pow(_BASE, -1, 1 << 64), n + 1)[start] * scale


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
