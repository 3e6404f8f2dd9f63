"""Words and word windows of whole texts, as 64-bit hashes in numpy arrays.

Words are maximal runs of characters other than space and the control characters 9 to 13, which is what
``bytes.split()`` takes for white space in UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
_STEP = 0x9E3779B97F4A7C15


def words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text in UTF-8; lower: A-Z become a-z, nothing else changes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """For each run of n hashes one hash of the sequence; none if there are fewer."""
    count = len(h) - n + 1
    if count <= 0:
        return h[:0]
    out = np.zeros(count, np.uint64)
    for j in range(n):
        out = out * np.uint64(_STEP) + mixed(h[j : j + count] + np.uint64(j + 1))
    return mixed(out)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word shingles after lower-casing A-Z; with fewer words the one whole sequence; none without words."""
    w = words(text, lower=True)
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed=len(w))], np.uint64)
    return np.unique(windows(hashes(w), n))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
