"""Hashes of words and of word windows over whole blocks of texts.

Each word is hashed by itself with xxh3, so no pair of words is made to collide by its letters.
Windows of words are polynomials over the words' hashes, taken from prefix sums.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

_STEP = 0xD1342543DE82EF95  # odd, so that it has an inverse modulo 2**64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _Powers:
    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_of_words = _Powers(_STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words [^\\x20\\x09-\\x0D]+ of the texts, one after another; where each text's words begin (one more at the end)."""
    split = [t.split() for t in texts]  # of bytes: at exactly these six
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, split), np.int64, len(split)), out=bounds[1:])
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, int(bounds[-1])), bounds


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words; as many as fit."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = _of_words.get(len(words) + 1)
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * down[: len(words) - n + 1] + np.uint64(n))


def sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each n neighbours x[i : i + n]."""
    have, step = x, 1
    while 2 * step <= n:
        have, step = best(have[:-step], have[step:]), 2 * step
    return have if step == n else best(have[: len(x) - n + 1], have[n - step :][: len(x) - n + 1])
