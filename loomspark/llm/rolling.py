"""Hashes of runs of words, as whole arrays."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np


class WordCodes(dict):
    """A code of 32 bits for each word, the same in every process; the store only saves repeated work."""

    def __init__(self, most: int = 1_000_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        code = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return code

    def __call__(self, words: Sequence[str]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of 64 bits for every run of q codes."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, q, np.uint64)
    for k in range(q):
        h = (h ^ codes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Places of hashes in a map of 2**bits."""
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def is_set(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places of a packed bitmap are set."""
    return (bitmap[places >> 3] >> (7 - (places & 7)).astype(np.uint8) & 1).astype(bool)


def coded_texts(texts: list[str], coded: WordCodes) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all words of all texts, words of each text); words are parted by single spaces."""
    return coded(" ".join(texts).split(" ")), np.array([t.count(" ") + 1 for t in texts], np.int64)


def rolling_of(codes: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place) of every run of q words inside the wanted texts, of which `codes` and `sizes` tell all words."""
    texts = np.flatnonzero(wanted)
    own, n = codes[np.repeat(wanted, sizes)], sizes[texts]
    h = rolling(own, q)
    owner = np.repeat(np.arange(len(texts)), n)[: len(h)]
    at = np.arange(len(h)) - (np.cumsum(n) - n)[owner]
    inside = at + q <= n[owner]
    return h[inside], texts[owner[inside]], at[inside]
