"""Words of whole texts as arrays of 64-bit hashes, for operators that look at runs of words."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

_LOWER_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)


def alphanumeric_words(text: bytes) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and all characters beyond ASCII."""
    return text.translate(_LOWER_WORDS).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads them."""
    x = (x ^ (x >> _MIX[2])) * _MIX[0]
    return (x ^ (x >> _MIX[2])) * _MIX[1]


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash for each row of equally long arrays; order matters."""
    out = mixed(parts[0])
    for p in parts[1:]:
        out = mixed(out + p)
    return out


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words."""
    m = len(words) - n + 1
    return chained([words[i : i + m] for i in range(n)]) if m > 0 else np.zeros(0, np.uint64)
