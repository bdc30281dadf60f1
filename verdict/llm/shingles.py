"""Distinct word shingles of whole texts as 64-bit hashes, many texts at a time.

Words are runs of other characters than the six white ones, A-Z lower-cased (both are byte
operations on UTF-8). A word's hash is a difference of prefix sums of a random polynomial
(mod 2**64), so a buffer of texts is hashed in a few array passes; a shingle mixes the hashes
of its words in order.
"""

from __future__ import annotations

import re

import numpy as np

from .rolling import _ODD, _TABLE, mixed

SIZE = 5
SEGMENT = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACE_RE = re.compile(rb"[\x09-\x0D\x20]")
_P = 0xD1342543DE82EF95


_MADE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _P and of its inverse; the last table made is kept."""
    if not any(k >= n for k in _MADE):
        _MADE.clear()
        x = [np.full(n, p, np.uint64) for p in (_P, pow(_P, -1, 1 << 64))]
        for p in x:
            p[0] = 1
        _MADE[n] = tuple(np.cumprod(p, dtype=np.uint64) for p in x)
    return next(iter(_MADE.values()))


def _hashes(low: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the words of a buffer."""
    code = np.frombuffer(low, np.uint8)
    inner = ~_SPACE[code]
    step = np.diff(np.concatenate([[0], inner.view(np.int8), [0]]))
    start, end = np.nonzero(step == 1)[0], np.nonzero(step == -1)[0]
    up, down = _powers(1 << max(16, len(code)).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[code] * up[:len(code)], dtype=np.uint64)])
    return start, mixed((sums[end] - sums[start]) * down[start])


def word_hashes(low: bytes) -> np.ndarray:
    """Hashes of the words of one text of any length, segment by segment."""
    out, at = [], 0
    while at < len(low):
        end = min(len(low), at + SEGMENT)
        if end < len(low):
            m = _SPACE_RE.search(low, end)
            end = m.start() if m else len(low)
        out.append(_hashes(low[at:end])[1])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _chunks(texts: list[bytes]):
    """(first row, word hashes, row of each word) for runs of texts of about SEGMENT bytes."""
    first, part, size = 0, [], 0
    for i, t in enumerate(texts):
        if len(t) >= SEGMENT:
            if part:
                yield _several(first, part)
            w = word_hashes(t.lower())
            yield w, np.full(len(w), i)
            first, part, size = i + 1, [], 0
            continue
        part.append(t)
        size += len(t)
        if size >= SEGMENT:
            yield _several(first, part)
            first, part, size = i + 1, [], 0
    if part:
        yield _several(first, part)


def _several(first: int, part: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    start, h = _hashes(b"\n".join(part).lower())
    ends = np.cumsum([len(t) + 1 for t in part])
    return h, first + np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list[bytes], size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, sorted by row and hash. Fewer words: all of them as one."""
    rows, hashes = [], []
    for words, row in _chunks(texts):
        if not len(words):
            continue
        n_words = np.bincount(row - row[0])[row - row[0]]
        if len(words) >= size:
            ok = np.nonzero(row[size - 1:] == row[:len(row) - size + 1])[0]
            h = words[ok]
            for k in range(1, size):
                h = mixed(h * _ODD[4] + words[ok + k])
            r = row[ok]
        else:
            h, r = words[:0], row[:0]
        short = n_words < size
        if short.any():
            begins = np.nonzero(short & np.concatenate([[True], row[1:] != row[:-1]]))[0]
            x = words[begins]
            for k in range(1, size - 1):
                more = n_words[begins] > k
                at = np.minimum(begins + k, len(words) - 1)
                x = np.where(more, mixed(x * _ODD[4] + words[at]), x)
            h, r = np.concatenate([h, mixed(x * _ODD[5] + n_words[begins].astype(np.uint64))]), np.concatenate([r, row[begins]])
        order = np.lexsort([h, r])
        h, r = h[order], r[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
        rows.append(r[new])
        hashes.append(h[new])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(rows), np.concatenate(hashes)
