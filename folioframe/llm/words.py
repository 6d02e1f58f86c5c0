"""Words, 64-bit hashes and shingle sets of whole texts (numpy, no Spark)."""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
GOLD = _U(0x9E3779B97F4A7C15)
#: Words whose hashes a task remembers before it starts over; bounds its memory.
MEMO_WORDS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants): every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """word bytes -> place of its 64-bit hash in ``table``, remembered for the words of a task."""

    def __init__(self) -> None:
        super().__init__()
        self.table = np.empty(1 << 16, _U)

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        if n == len(self.table):
            self.table = np.concatenate((self.table, np.empty_like(self.table)))
        self.table[n] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        """The hashes of a text's words."""
        if len(self) >= MEMO_WORDS:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))  # first, as it may replace the table
        return self.table[at]


def lower_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

    ``bytes.split`` and ``bytes.lower`` know exactly these six separators and 26 letters.
    """
    return text.encode().lower().split() if text else []


def shingle_hashes(words: list[bytes], k: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; a shorter text is one shingle, an empty one none."""
    n = len(words)
    if not n:
        return np.empty(0, _U)
    ids = memo.of(words)
    width = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - width + 1, _U(width))
        for i in range(width):
            h = mix((h ^ ids[i : n - width + 1 + i]) + GOLD)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]
