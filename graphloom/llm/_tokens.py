"""Vectorised 64-bit hashing of words, shingles and substrings of whole texts."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)
#: Bytes hashed at once; holds the temporary arrays to some megabytes.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: equal inputs only have equal outputs."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Symbols are spread before they enter the polynomial.
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)


class Rolling:
    """Prefix sums from which the hash of any substring is read in constant time."""

    def __init__(self, symbols: np.ndarray):
        """symbols: uint64, one for each position."""
        n = len(symbols)
        _grow(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * _powers[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Equal substrings have equal hashes, wherever they stand."""
        return mix((self.sums[end] - self.sums[start]) * _inverses[start] + (end - start).astype(np.uint64))


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of ``texts`` and the offsets of each text's words.

    Words are maximal runs of bytes other than the six ASCII white-space characters.
    """
    joined = b" ".join(texts)
    raw = np.frombuffer(joined, dtype=np.uint8)
    space = np.ones(len(raw) + 2, dtype=bool)
    space[1:-1] = _SPACE[raw]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    hashes = Rolling(_SYMBOL[_LOWER[raw] if lower else raw]).of(starts, ends)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(starts, at)


def chunks(texts: list[bytes], limit: int = CHUNK):
    """Index ranges of ``texts`` of about ``limit`` bytes each; a longer text stands alone."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


_MULTIPLIERS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes], k: int = 5):
    """For each text, its sorted distinct k-word shingle hashes.

    With fewer than k words the whole sequence is the one shingle; without words the set
    is empty.
    """
    for lo, hi in chunks(texts):
        words, at = word_hashes(texts[lo:hi])
        n = len(words)
        if n >= k:
            rolled = words[: n - k + 1] * _MULTIPLIERS[0]
            for j in range(1, k):
                rolled = rolled + words[j : n - k + 1 + j] * _MULTIPLIERS[j]
            rolled = mix(rolled)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                short = (words[a:b] * _MULTIPLIERS[: b - a]).sum(dtype=np.uint64)
                yield mix(np.array([short + np.uint64(b - a)], dtype=np.uint64))
            else:
                yield np.empty(0, dtype=np.uint64)


def set_id(items: np.ndarray) -> int:
    """A non-negative 63-bit identity of a set of hashes."""
    total = mix(items).sum(dtype=np.uint64) + np.uint64(len(items))
    return int(mix(np.array([total], dtype=np.uint64))[0] >> np.uint64(1))


def give_back() -> None:
    """Hand freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library frees by itself
        pass


def tidy(run: Callable) -> Callable:
    """``run``, a map over record batches, after which its worker hands freed memory back: workers live on between tasks."""

    @functools.wraps(run)
    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
