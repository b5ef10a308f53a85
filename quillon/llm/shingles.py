"""Word shingles of whole texts as sorted sets of 64-bit hashes, by array arithmetic.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D`` after A-Z became a-z.
A word's hash is a difference of prefix sums of a polynomial over a random byte
table, so no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np

_random = np.random.default_rng(20240607)
BYTE = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
#: Odd, so it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PLACE = _random.integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WIDTH = 5

#: A worker keeps so many powers; those for a longer text are made for it alone.
KEPT_POWERS = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:  # doubling: the next stretch is the first one times base**done
            have[done : 2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        if size <= KEPT_POWERS:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: bytes) -> np.ndarray:
    """One hash a word of the (already lower-cased) text."""
    if not raw:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(raw, np.uint8)
    space = SPACE[codes]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(BYTE[codes] * powers(BASE, len(codes))[: len(codes)], out=total[1:])
    return mix((total[end] - total[begin]) * powers(BASE_INVERSE, len(codes))[begin] + (end - begin).astype(np.uint64))


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes; a text of fewer words is one shingle; none without a word."""
    if not text:
        return np.empty(0, np.int64)
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    n = len(words)
    if n == 0:
        return np.empty(0, np.int64)
    take = min(width, n)
    total = np.full(n - take + 1, take, np.uint64)
    for i in range(take):
        total += words[i : n - take + 1 + i] * PLACE[i]
    return np.unique(mix(total).view(np.int64))


def signature(hashes: np.ndarray) -> int:
    """One number for a set, the same in any order."""
    if len(hashes) == 0:
        return 0
    h = hashes.view(np.uint64)
    total = mix(h).sum(keepdims=True, dtype=np.uint64)
    mixed = np.bitwise_xor.reduce(h, keepdims=True) * np.uint64(BASE)
    return int(mix(total ^ (mixed + np.uint64(len(h)))).view(np.int64)[0])
