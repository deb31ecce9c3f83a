"""Hashed words and word shingles with NumPy, for use inside tasks. Words are lower-cased in A-Z only and parted by \\x20 and \\x09-\\x0D."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PIECE = 1 << 18  # bytes of text hashed at once


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@cache
def _byte_values(lower: bool) -> np.ndarray:
    """A random number for each byte, upper case as lower case unless told otherwise; 0 for what parts words."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
    if lower:
        values[65:91] = values[97:123]
    values[[32, *range(9, 14)]] = 0
    return values


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


@cache
def _piece_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(GOLDEN)
    return _powers(base, n), _powers(pow(base, -1, 1 << 64), n)


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has. The hash of a word is a polynomial in its bytes,
    modulo 2 ** 64, so differences of running sums give all words at once."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    size = PIECE * -(-len(data) // PIECE)
    up, down = _piece_powers(size) if size <= 4 * PIECE else (_powers(int(GOLDEN), size), _powers(pow(int(GOLDEN), -1, 1 << 64), size))
    value = _byte_values(lower)[data]
    space = value == 0
    begin = np.flatnonzero(space[:-1] & ~space[1:])  # the place before a word
    end = np.flatnonzero(~space[:-1] & space[1:])
    value *= up[: len(value)]
    running = np.cumsum(value, dtype=np.uint64)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.searchsorted(begin, np.cumsum(length + 1)) - np.searchsorted(begin, np.cumsum(length + 1) - length - 1)
    return mix64((running[end] - running[begin]) * down[begin]), words


def pieces(texts) -> Iterator[list[bytes]]:
    """The texts in UTF-8, about PIECE bytes at a time; a null is an empty text."""
    held, out = 0, []
    for t in texts:
        out.append(t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"")
        held += len(out[-1])
        if held >= PIECE:
            yield out
            held, out = 0, []
    if out:
        yield out


def hash_texts(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and how many words each text has."""
    parts = [word_hashes(piece) for piece in pieces(texts)]
    return np.concatenate([np.empty(0, np.uint64), *[h for h, _ in parts]]), np.concatenate([np.empty(0, np.int64), *[n for _, n in parts]])


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    out = np.full(max(0, len(h) - width + 1), width, np.uint64)
    for j in range(width):
        out *= np.uint64(0x100000001B3)
        out = mix64(out + h[j : len(h) - width + 1 + j])
    return out


def shingle_sets(texts, k: int = 5) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its k-word shingles; of the whole sequence when it is shorter; empty without words."""
    sets = []
    for piece in pieces(texts):
        h, size = word_hashes(piece)
        rolled = _rolled(h, k)
        for start, n in zip((np.cumsum(size) - size).tolist(), size.tolist(), strict=True):
            sets.append(np.unique(rolled[start : start + n - k + 1] if n >= k else _rolled(h[start : start + n], n)) if n else rolled[:0])
    return sets
