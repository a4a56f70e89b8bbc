"""Hashed word shingles of whole texts, by array arithmetic inside a task."""

from __future__ import annotations

import numpy as np

from logvane.llm.common import mix, prefix_hash, span_hash

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
NOTHING = np.zeros(0, np.uint64)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of UTF-8 bytes, in order."""
    signs = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(signs) + 2, np.int8)
    inside[1:-1] = ~_SPACE[signs]
    edges = np.diff(inside)
    starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return span_hash(prefix_hash(signs), starts, stops) if len(starts) else NOTHING


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``size``-word shingles, A-Z lower-cased.

    A text of fewer words is one shingle; without words the set is empty.
    """
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return NOTHING
    width = min(size, len(words))
    rolled = np.full(len(words) - width + 1, np.uint64(width))
    for k in range(width):
        rolled = rolled * _STEP + words[k : len(words) - width + 1 + k]
    return np.unique(mix(rolled))
