"""Sets of hashed word shingles in numpy."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose result bits all depend on all of the input's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, in order."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    solid = ~_BLANK[data]
    starts = np.flatnonzero(solid & ~np.append(False, solid[:-1]))
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.flatnonzero(solid)
    first = np.append(True, np.diff(at) > 1)
    heads = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(place.max()), _STEP)))
        return mix64(np.add.reduceat(_BYTE[data[at]] * powers[place], heads))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; of the whole if there are fewer."""
    words = word_hashes(text)
    if not len(words):
        return words
    width_here = min(width, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(words) - width_here + 1, np.uint64(width_here))
        for k in range(width_here):
            total = mix64(total * _STEP + words[k:len(words) - width_here + 1 + k])
    return np.unique(total)


def common(one: np.ndarray, other: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(one) > len(other):
        one, other = other, one
    at = np.searchsorted(other, one)
    return int((other[np.minimum(at, len(other) - 1)] == one).sum()) if len(other) else 0
