"""Word shingles as 64-bit hashes, many texts at a time.

A word is a maximal run of Unicode word characters of the lower-cased text. The
shingles of a text are its runs of ``width`` words; a text with fewer words, but
any, has one shingle of them all; a text without words has none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WIDTH = 5
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MUL_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _word_chars() -> np.ndarray:
    import re

    out = np.zeros(0x110000, bool)
    for first in range(0, 0x110000, 4096):  # a piece at a time, to stay small
        for m in re.finditer(r"\w+", "".join(map(chr, range(first, first + 4096)))):
            out[first + m.start() : first + m.end()] = True
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate((one, np.full(n, m, np.uint64)))) for m in (_MUL, _MUL_INVERSE))


class Spelled:
    """The words of many texts, with a hash of any prefix of any of them."""

    def __init__(self, texts: list[str]) -> None:
        lowered = [t.lower() for t in texts]
        points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
        inside = np.concatenate(([False], _word_chars()[points]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])  # a break after each text: begin, end, begin, end ...
        self.begin, self.stop = edges[::2], edges[1::2]
        power, self._inverse = _powers(max(1 << 18, 1 << int(len(points)).bit_length()))
        self._sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64) + _MUL) * power[: len(points)], out=self._sums[1:])
        #: Where each text's words begin, and one more.
        self.at = np.concatenate(([0], np.searchsorted(self.begin, ends)))

    def name(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hashes of ``length`` characters from ``begin`` on."""
        return mix((self._sums[begin + length] - self._sums[begin]) * self._inverse[begin] + length.astype(np.uint64))


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each text's words (one more than texts)."""
    spelled = Spelled(texts)
    return spelled.name(spelled.begin, spelled.stop - spelled.begin), spelled.at


def shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, repeats too, and the offsets of each text's."""
    hashed, at = words(texts)
    n_words = np.diff(at)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    offsets = np.concatenate(([0], np.cumsum(n)))
    first = np.arange(offsets[-1]) + np.repeat(at[:-1] - offsets[:-1], n)
    out = np.zeros(len(first), np.uint64)
    limit = np.repeat(at[1:], n)
    for j in range(width):
        place = first + j
        there = place < limit
        out = (out + np.where(there, hashed[np.minimum(place, max(len(hashed) - 1, 0))] if len(hashed) else 0, np.uint64(j))) * _MUL
    return mix(out), offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes sorted and without repeats, and their offsets."""
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.concatenate(([0], np.cumsum(np.bincount(text[new], minlength=len(offsets) - 1))))
