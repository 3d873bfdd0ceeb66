"""Hashed words and shingle sets of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * _ODD)
_powers = np.cumprod(np.full(256, 0xD1342543DE82EF95, U))


def _powers_to(n: int) -> np.ndarray:
    global _powers
    if n > len(_powers):
        _powers = np.cumprod(np.full(max(n, 2 * len(_powers)), 0xD1342543DE82EF95, U))
    return _powers


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a text and the places at which they start."""
    b = np.frombuffer(text, np.uint8)
    solid = np.flatnonzero(~_SPACE[b])
    if not len(solid):
        return np.empty(0, U), np.empty(0, np.int64)
    first = np.flatnonzero(np.diff(solid, prepend=-2) != 1)
    lengths = np.diff(first, append=len(solid))
    place = np.arange(len(solid)) - np.repeat(first, lengths)
    h = np.add.reduceat(_BYTES[b[solid]] * _powers_to(int(lengths.max()))[place], first)
    return mix(h + lengths.astype(U) * _ODD), solid[first]


def shingle_sets(texts: list, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingles of `size` words, A-Z lower-cased; a shorter text is one shingle, one without words none."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    h, at = word_hashes(b"\n".join(raw))
    cuts = np.concatenate([[0], np.searchsorted(at, ends)])
    grams = h[: max(len(h) - size + 1, 0)].copy()
    for k in range(1, size):
        grams = mix(grams * _ODD + h[k : k + len(grams)])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            g = h[a : a + 1].copy()
            for k in range(a + 1, b):
                g = mix(g * _ODD + h[k : k + 1])
            out.append(mix(g + U(b - a)))
        else:
            out.append(np.empty(0, U))
    return out
