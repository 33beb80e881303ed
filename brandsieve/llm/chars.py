"""Texts as arrays of code points: letters, hashed subwords and hashed words, in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Code points handled at a time; longer texts go through in pieces.
PIECE = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text."""
    return np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def spread(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Hashes mixed down to ``bits`` bits."""
    hashes ^= hashes >> np.uint64(29)
    return ((hashes * GOLDEN) >> np.uint64(64 - bits)).astype(np.int64)


def subwords(text: str, bits: int, sizes: tuple[int, ...] = (1, 2, 3)) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams of all words; n-grams of two and more may hold a word border.

    Comes in pieces; n-grams across the seam of two pieces are counted once.
    """
    points = codes(text)
    points = np.where(letters()[points], points, 0)
    longest = max(sizes)
    points = np.concatenate(([0], points, [0])).astype(np.uint64)
    for at in range(0, len(points), PIECE):
        part = points[at : at + PIECE + longest - 1]
        for n in sizes:
            count = min(PIECE, len(part) - n + 1)
            if count <= 0:
                continue
            inner = [part[i : i + count] != 0 for i in range(n)]
            if n == 1:
                good = inner[0]
            elif n == 2:
                good = inner[0] | inner[1]
            else:
                good = np.logical_and.reduce(inner[1:-1])
            hashes = np.full(count, n, np.uint64)
            for i in range(n):
                hashes = hashes * np.uint64(1_000_003) + part[i : i + count]
            yield spread(hashes[good], bits)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of word hashes modulo 2^64, and of its inverse."""
    base = 0x5851F42D4C957F2D
    inverse = pow(base, -1, 1 << 64)
    out = []
    for factor in (base, inverse):
        powers = np.full(PIECE + 1, factor, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return out[0], out[1]


def words(text: str, bits: int) -> Iterator[np.ndarray]:
    """Hashes below 2^bits of all words (runs of letters), in order, with repeats.

    A word's hash is a polynomial in its letters, taken from running sums, so it doesn't matter where
    the word stands. Comes in pieces that end between words; only a word longer than a piece is cut.
    """
    points = codes(text)
    letter = letters()[points]
    up, down = _powers()
    at = 0
    while at < len(points):
        end = min(len(points), at + PIECE)
        if end < len(points) and letter[end - 1] and letter[end]:
            gaps = np.nonzero(~letter[at:end])[0]
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        part = points[at:end]
        edge = np.diff(np.concatenate(([0], letter[at:end].astype(np.int8), [0])))
        starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part.astype(np.uint64) * up[: len(part)], dtype=np.uint64)))
        yield spread((sums[ends] - sums[starts]) * down[starts], bits)
        at = end
