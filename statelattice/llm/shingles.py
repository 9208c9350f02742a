"""Word shingles of whole texts as 63-bit hash sets."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of a text's `width`-word shingles, below 2**63.

    Words are runs of bytes other than ASCII white space, after lower-casing A-Z. A text with fewer
    words than `width` has one shingle, its whole word sequence; one without words has none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    used = min(width, len(words))
    out = np.full(len(words) - used + 1, used, np.uint64)
    for i in range(used):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(words) - used + 1 + i])
    return np.unique(out >> np.uint64(1))
