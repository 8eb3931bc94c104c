"""Words and shingles of texts as 64-bit numbers, by numpy over UTF-8 bytes.

A word's number is a polynomial over a random table of its bytes, so that two words
share one with a chance of about 2^-60; a shingle's number mixes those of its words.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS = np.ones(1 << 16, np.uint64)
with np.errstate(over="ignore"):
    _POWERS[1:] = np.multiply.accumulate(np.full((1 << 16) - 1, _MULT, np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_MIXED = mix64(_TABLE)


def folded(data: bytes) -> np.ndarray:
    """The bytes with A-Z lower-cased."""
    return _FOLD[np.frombuffer(data, np.uint8)]


def word_numbers(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, starts) of the words in bytes already folded."""
    word = ~_SPACE[b]
    if not word.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = np.flatnonzero(word)
    starts = np.flatnonzero(first)
    heads = np.flatnonzero(first[at])
    place = at - np.repeat(starts, np.diff(heads, append=len(at)))
    if place.max() < len(_POWERS):
        power = _POWERS[place]
    else:  # words of over 65,536 bytes
        power = _POWERS[place & 0xFFFF] * mix64((place >> 16).astype(np.uint64) + np.uint64(1))
    terms = _MIXED[b[at]] * power
    return mix64(np.add.reduceat(terms, heads)), starts


def shingles(numbers: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct numbers of the runs of `size` words; all words as one run if there are fewer."""
    n = len(numbers)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(size, n)
    total = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        total += numbers[i : n - size + 1 + i] * _STEP[i]
    return np.unique(mix64(total))
