"""Words and word shingles of whole texts as 64-bit hashes, in array operations over a batch.

A word is a maximal run of bytes other than space and \\x09-\\x0D; A-Z are lower-cased.  A word's hash is
a polynomial of random 64-bit values of its bytes, read off prefix sums, then scrambled; a shingle's hash
combines the hashes of five words in a row.  A text of fewer words has one shingle, its whole sequence.
"""

from __future__ import annotations

import numpy as np

from inkwell.llm.common import mix64

WIDTH = 5
_rng = np.random.default_rng(20240607)
#: What each byte counts as: lower-cased, white space as a space.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[9:14] = 32
_VALUE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 61, 1 << 62)) * 2 + 1
_PLACE = _rng.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse modulo 2**64, n of each at least."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        _powers = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of the texts, and for each text the index of its first word (n + 1)."""
    n = len(raw)
    folded = FOLD[raw]
    ink = np.zeros(n + 1, bool)
    ink[:-1] = folded != 32
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | first))
    ends = np.flatnonzero(before & (~ink | first))
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[folded] * up[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def shingles(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; empty without words."""
    _, _, hashes, first = words(raw, offsets)
    per_text = np.diff(first)
    stop = np.repeat(first[1:], per_text)
    at = np.arange(len(hashes))
    total = np.zeros(len(hashes), np.uint64)
    for k in range(WIDTH):
        inside = at + k < stop
        total[inside] += hashes[at[inside] + k] * _PLACE[k]
    whole = (at + WIDTH <= stop) | ((at == np.repeat(first[:-1], per_text)) & (stop - at < WIDTH))
    kept = np.concatenate([[0], np.cumsum(whole)])
    total = mix64(total)[whole]
    return [np.unique(total[a:b]) for a, b in zip(kept[first[:-1]], kept[first[1:]])]
