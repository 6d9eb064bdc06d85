"""Vectorised text features for Arrow batches: code points, hashed character n-grams, hashed words."""

from __future__ import annotations

from functools import cache

import numpy as np

SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], dtype=np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@cache
def letter_table() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: whether it is a letter, and its lower case where that is one character."""
    alpha = np.zeros(0x110000, dtype=bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            alpha[i] = True
            if len(x := c.lower()) == 1:
                lower[i] = ord(x)
    return alpha, lower


def letters_only(text: str) -> np.ndarray:
    """Lower-case letters, with one space for each run of anything else and at both ends; empty if no letter."""
    alpha, lower = letter_table()
    codes = code_points(text)
    is_letter = alpha[codes]
    if not is_letter.any():
        return np.zeros(0, dtype=np.uint32)
    codes = np.where(is_letter, lower[codes], 32).astype(np.uint32)
    codes = np.concatenate(([32], codes, [32])).astype(np.uint32)
    keep = np.ones(len(codes), dtype=bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    return codes[keep]


def gram_buckets(codes: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """Hash buckets, of 2**bits, of all n-grams of the given sizes."""
    found = []
    for n in sizes:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        found.append(h >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


def mix64(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(n, dtype=np.uint64), np.ones(n, dtype=np.uint64)
    up[1:], down[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, words being runs of anything but ASCII white space."""
    raw = np.frombuffer((text.lower() if lower else text).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, dtype=np.uint64)
    solid = np.concatenate(([False], (raw != 32) & ((raw < 9) | (raw > 13)), [False]))
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(1 << max(10, int(len(raw)).bit_length()))
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)))
    h = (sums[end] - sums[start]) * down[start]
    return mix64(h + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash of each run of `size` words; of all words, if there are fewer; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n]) * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(32))
    return mix64(h)
