"""Vectorised hashes of byte spans, words and shingles.

A prefix sum of c[i] * R**-i modulo 2**64 gives the polynomial hash of any span
of a buffer in constant time; a finaliser then mixes its bits.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_tables = {"pow": np.ones(1, U64), "inv": np.ones(1, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["pow"]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for name, base in (("pow", _R), ("inv", _RINV)):
            t = np.full(size, U64(base))
            t[0] = 1
            _tables[name] = np.multiply.accumulate(t)
    return _tables["pow"], _tables["inv"]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on an array of uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(codes: np.ndarray) -> np.ndarray:
    """Prefix sums for ``spans``; codes: bytes or code points."""
    out = np.zeros(len(codes) + 1, U64)
    np.cumsum((codes.astype(U64) + U64(1)) * _powers(len(codes) + 1)[1][: len(codes)], out=out[1:])
    return out


def spans(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each span [start, end), which depends on its content and length only."""
    powers = _powers(len(pre))[0]
    return mix((pre[end] - pre[start]) * powers[start] + (end - start).astype(U64))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text: runs without ASCII white space, A-Z lower-cased."""
    if not text:
        return np.zeros(0, U64)
    codes = _LOWER[np.frombuffer(text, np.uint8)]
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = ~_SPACE[codes]
    edge = np.diff(inside)
    return spans(prefix(codes), np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles; of a shorter text, the whole sequence as one."""
    words = word_hashes(text)
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    h = np.full(n, U64(size))
    for j in range(size):
        h = mix(h * U64(_R) + words[j : j + n])
    return np.unique(h)
