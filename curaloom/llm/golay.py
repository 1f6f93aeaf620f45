"""The binary Golay code (23, 12, 7) as a fuzzy hash.

The code is perfect: each 23-bit word lies within three bits of exactly one of
its 4096 codewords.  For words x and y that differ in one bit at most, the
codeword nearest to one of them is among ``near(other)``, which holds the
nearest codeword and, for words three bits away from it, the five codewords at
distance four: if x lies within two bits of codeword c, then y lies within three
and c is nearest to both.  If x is three bits from c and y four, then the
codeword nearest to y is at distance three from y, so at distance four from x.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each word on division by the generator: 11 bits."""
    rest = np.array(words, dtype=np.int64)
    for bit in range(22, 10, -1):
        rest ^= ((rest >> bit) & 1) * (GENERATOR << (bit - 11))
    return rest


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error pattern of weight three or less, and the five of weight four (0 if there are none)."""
    nearest, five = np.zeros(2048, dtype=np.int64), np.zeros((2048, 5), dtype=np.int64)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], dtype=np.int64)
        of = syndrome(patterns)
        if weight < 4:
            nearest[of] = patterns
            continue
        order = np.argsort(of, kind="stable")
        five[of[order].reshape(-1, 5)[:, 0]] = patterns[order].reshape(-1, 5)
    return nearest, five


def nearest_index(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the codeword nearest to each 23-bit word."""
    return (np.asarray(words, dtype=np.int64) ^ tables()[0][syndrome(words)]) >> 11


def further_indices(words: np.ndarray) -> np.ndarray:
    """Indices of the five codewords at distance four, or -1 where the nearest is closer than three bits."""
    words = np.asarray(words, dtype=np.int64)
    five = tables()[1][syndrome(words)]
    return np.where(five != 0, (words[:, None] ^ five) >> 11, -1)
