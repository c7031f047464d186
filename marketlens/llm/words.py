"""Words and word shingles of whole texts, as 64-bit hashes in numpy.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D`` after A-Z is lower-cased;
``bytes.lower`` and ``bytes.split`` do exactly that on UTF-8.
"""

from __future__ import annotations

import numpy as np
import xxhash

from marketlens.llm.common import entering

SHINGLE = 5
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE_WORDS = 200_000


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHash(dict):
    """64-bit hash of a word, remembered; cleared by ``trim`` once it grows large."""

    def __init__(self):
        super().__init__()
        entering("words")

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > _CACHE_WORDS:
            self.clear()

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), dtype=np.uint64, count=len(ws))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_set(hashes: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(n, k)
    s = np.full(n - k + 1, k, dtype=np.uint64)
    for i in range(k):
        s = _mixed(s * _MIX + hashes[i:n - k + 1 + i])
    return np.unique(s)
