"""Vectorised hashes of all k-byte strings of a buffer, and sliding minima and maxima."""

from __future__ import annotations

import numpy as np

_TABLE = np.random.default_rng(20240229).integers(1, 2 ** 63, 257, dtype=np.uint64)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                               0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_S = np.uint64(32)


def levels(codes: np.ndarray, up_to: int) -> dict[int, np.ndarray]:
    """{n: hashes of all n-code strings} for n = 1, 2, 4 ... ``up_to``; codes are 0..256 (256: outside a text)."""
    h = _TABLE[codes]
    out, n, i = {1: h}, 1, 0
    while n < up_to:
        h = h[:-n] * _ODD[i] + h[n:]
        h ^= h >> _S
        n, i = 2 * n, i + 1
        out[n] = h
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h * _ODD[1]
    h ^= h >> np.uint64(29)
    h *= _ODD[2]
    h ^= h >> _S
    return h


def combined(*parts: np.ndarray) -> np.ndarray:
    """Order-dependent mix of equally long hash arrays."""
    out = mixed(parts[0])
    for p in parts[1:]:
        out = mixed(out * _ODD[3] + p)
    return out


def sliding(a: np.ndarray, width: int, op) -> np.ndarray:
    """op (np.minimum or np.maximum) over each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        a, n = op(a[:-n], a[n:]), 2 * n
    return op(a[:n - width], a[width - n:]) if n < width else a
