"""Sets of 5-word shingles as 64-bit hashes, a batch of documents at a time."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Words whose hashes are kept at a time.
_CACHE = 250_000
_rng = np.random.default_rng(20240607)
_PLACE = _rng.integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FEWER = _rng.integers(1, 2**63, WORDS + 1, dtype=np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE:
            self.clear()
        h = xxhash.xxh64_intdigest(word)
        if len(word) <= 40:
            self[word] = h
        return h


_words = _Words()
_hash = _words.__getitem__


def forget() -> None:
    """Frees the words kept so far, at the end of a task."""
    _words.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space with A-Z in lower case; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence as one if it has fewer words; empty without words."""
    words = words_of(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hash, words), np.uint64, n)
    k = min(n, WORDS)
    x = h[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        x = x + h[j : n - k + 1 + j] * _PLACE[j]
    if n < WORDS:
        x = x + _FEWER[n]
    return np.unique(mixed(x))
