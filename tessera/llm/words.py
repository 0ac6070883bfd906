"""Words and rolling hashes of word sequences, for Arrow batch functions."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
CACHE_WORDS = 250_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_CACHE = _Hashes()
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def split(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than blank, tab, line feed, vertical tab, form feed and carriage return, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash for each word."""
    if len(_CACHE) > CACHE_WORDS:
        _CACHE.clear()
    return np.fromiter(map(_CACHE.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of ``k`` consecutive hashes."""
    n = len(h)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    if len(_POWERS[0]) < n + 1:
        size = max(n + 1, 1 << 15)
        for at, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[at] = np.multiply.accumulate(p)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * _POWERS[0][:n], out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * _POWERS[1][: n - k + 1])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done, m = 1, x
    while done < width:
        step = min(done, width - done)
        m = np.minimum(m[:-step], m[step:])
        done += step
    return m
