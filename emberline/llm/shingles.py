"""Word shingles of whole texts as sorted 64-bit sets, and circulant MinHash signatures of such sets."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL2 = np.uint64(0xC2B2AE3D27D4EB4F)
_S29, _S32 = np.uint64(29), np.uint64(32)


class WordHashes(dict):
    """Memo of word hashes; emptied when full, which changes no value."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, width: int, memo: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text, A-Z lower-cased.

    Fewer words than ``width``: the whole sequence is one shingle; no word: the empty set.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    span = min(width, n)
    acc = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        acc = (acc ^ (acc >> _S29)) * _MUL + h[i : n - span + 1 + i]
    acc ^= acc >> _S32
    acc *= _MUL2
    acc ^= acc >> _S29
    return np.unique(acc)


def set_digest(members: np.ndarray) -> str:
    return hashlib.blake2b(members.tobytes(), digest_size=16).hexdigest()


def _permute(x: np.ndarray, c1: int, c2: int) -> np.ndarray:
    """A bijection of the 32-bit ring, in place: odd multipliers and xor-shifts."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(c1)
    x ^= x >> np.uint32(13)
    x *= np.uint32(c2)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` minima per non-empty set.

    Two permutations of the 32-bit ring serve all coordinates: the first scatters the members, the second is
    read at a circular shift of k positions for coordinate k (C-MinHash), instead of one permutation each.
    """
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    base = _permute((np.concatenate(sets) & np.uint64(0xFFFFFFFF)).astype(np.uint32), 0x85EBCA6B, 0xC2B2AE35)
    out = np.empty((len(sets), coordinates), np.uint32)
    for k in range(coordinates):
        out[:, k] = np.minimum.reduceat(_permute(base + np.uint32(k + 1), 0x7FEB352D, 0x846CA68B), starts)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """64-bit key of each band of ``rows`` coordinates; the band's number is part of the key."""
    n, k = signatures.shape
    parts = signatures.reshape(n, k // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, k // rows + 1, dtype=np.uint64) * _MUL2, (n, k // rows)).copy()
    for j in range(rows):
        key = (key ^ (key >> _S29)) * _MUL + parts[:, :, j]
    key ^= key >> _S32
    return (key * _MUL2).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test 100 * |A and B| >= percent * |A or B| on full sorted sets."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)
