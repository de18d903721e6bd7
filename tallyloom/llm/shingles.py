"""Word-shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_FIN = _U(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand and emptied when it grows past a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, k: int, known: WordHashes) -> np.ndarray:
    """Distinct k-word shingles of the text with A-Z lower-cased; a shorter text is one shingle; no words, none.

    ``bytes.lower`` and ``bytes.split`` touch ASCII only, which is exactly the word rule. Word
    order inside a shingle counts. Two different shingles share a 64-bit hash with a chance of
    2**-64, which is neglected.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(known.__getitem__, words), _U, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.full(n, _U(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ h[i : i + n]) * _MUL
            out ^= out >> _U(29)
        out = (out ^ (out >> _U(32))) * _FIN
        out ^= out >> _U(31)
    return np.unique(out)
