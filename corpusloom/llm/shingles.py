"""Word shingles of whole texts as 64-bit hashes, and MinHash signatures, computed for batches of texts.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z.  Their hashes come from one running polynomial over the bytes of
the batch, so no Python loop touches a word.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, where each text's words begin, with the end at last)."""
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = np.frombuffer(b" ".join([b"", *data, b""]), np.uint8)
    space = _SPACE[joined]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _power_tables(len(joined) + 1)
    run = np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)], dtype=np.uint64)
    words = mix((run[ends - 1] - run[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))
    edges = np.cumsum([1, *(len(d) + 1 for d in data)])
    return words, np.searchsorted(starts, edges)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``k`` words, sorted; with fewer words, its whole sequence as one; without words, none."""
    words, begin = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k):
        rolled = mix(rolled + words[j : n - k + 1 + j] + np.uint64(j + 1)) if n >= k else rolled
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        if b - a >= k:
            got = np.sort(rolled[a : b - k + 1])
            out.append(got[np.concatenate([[True], got[1:] != got[:-1]])])
        elif b > a:
            h = np.full(1, 0xC0FFEE + b - a, np.uint64)
            for j in range(a, b):
                h = mix(h + words[j : j + 1])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class MinHash:
    """Signatures of ``size`` 32-bit minima."""

    def __init__(self, size: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.salts = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        self.factors = rng.integers(0, 1 << 63, size, dtype=np.uint64) | np.uint64(1)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row a set; all sets must have members."""
        if not sets:
            return np.zeros((0, len(self.salts)), np.uint32)
        joined = np.concatenate(sets)
        at = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((len(sets), len(self.salts)), np.uint32)
        for i, (salt, factor) in enumerate(zip(self.salts, self.factors)):
            out[:, i] = np.minimum.reduceat(((joined ^ salt) * factor) >> np.uint64(32), at)
        return out


def jaccard_at_least(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """Whether den * |a & b| >= num * |a | b| for two sorted sets; False if either is empty."""
    if not len(a) or not len(b) or den * min(len(a), len(b)) < num * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)
