"""Words, shingles and signatures of whole texts, in NumPy over Arrow's string buffers.

Words are runs of bytes that are not 0x20 or 0x09 to 0x0D, with A-Z in lower case. Hashes have 64 bits.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, firsts): each word's hash and first byte, and where each text's words begin among them (len + 1).

    The buffer is taken in pieces of about PIECE bytes that end at the end of a word, so the arrays
    beside it stay small for a text of any length.
    """
    hashes, starts = [], []
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    low, total = 0, len(data)
    while low < total:
        high = min(low + PIECE, total)
        while high < total and not (_SPACE[data[high]] or first[high]):
            step = min(high + 4096, total)
            stops = np.flatnonzero(_SPACE[data[high:step]] | first[high:step])
            high = high + int(stops[0]) if len(stops) else step
        b = data[low:high]
        solid = ~_SPACE[b]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | first[low + 1 : high]
        at = np.flatnonzero(begin)
        if len(at):
            inside = np.flatnonzero(solid)
            of = np.cumsum(begin)[inside] - 1
            place = inside - at[of]
            powers = np.cumprod(np.full(int(place.max()) + 1, _BASE))
            summed = np.add.reduceat(_FOLD[b[inside]] * powers[place], np.flatnonzero(begin[inside]))
            hashes.append(mix(summed))
            starts.append(at + low)
        low = high
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return h, s, np.searchsorted(s, offsets)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of one text's runs of k words; a text with fewer words is one shingle, one without words has none."""
    n = len(h)
    if not n:
        return h
    width = min(n, k)
    out = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        out = mix(out * _BASE + h[i : n - width + 1 + i])
    return np.unique(out)


def coefficients(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _BASE + np.uint64(seed)).astype(np.uint32)
    return r[:count] | np.uint32(1), r[count:]


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function a x + b mod 2**32 over the set; not defined for an empty set."""
    x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for low in range(0, len(x), 2048):
        best = np.minimum(best, (a[:, None] * x[None, low : low + 2048] + b[:, None]).min(1))
    return best
