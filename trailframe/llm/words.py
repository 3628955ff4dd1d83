"""Hashes of the words of many texts at once, in numpy.

A word's hash is a sum over its bytes of a number for the byte times a number
for its place, modulo 2^64, and then mixed; two words are taken for one with a
chance of about 2^-64.  No word is looked up or kept, so memory goes with the
slice of texts and not with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of texts that are hashed together.
SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of mixed."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


class Hasher:
    """Hashes of words: `gaps` are the bytes between words; A-Z count as a-z."""

    def __init__(self, gaps: bytes) -> None:
        code = np.arange(256, dtype=np.uint64)
        code[65:91] += np.uint64(32)
        self.value = mixed(code * FACTOR + np.uint64(1))
        self.inside = np.ones(256, bool)
        self.inside[list(gaps)] = False
        self.place = np.zeros(0, np.uint64)

    def places(self, n: int) -> np.ndarray:
        if n > len(self.place):
            self.place = mixed(np.arange(1, max(n, 64) + 1, dtype=np.uint64) * FACTOR) | np.uint64(1)
        return self.place

    def __call__(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words of texts that lie one behind the other, and where each text's words begin (one more at the end).

        data: bytes; begin: where each text begins, and the end.
        """
        inside = self.inside[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = begin[:-1][begin[:-1] < len(data)]
        first[edges] |= inside[edges]
        starts = np.flatnonzero(first)
        at = np.flatnonzero(inside)
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(len(begin), np.int64)
        lead = np.flatnonzero(first[at])
        lengths = np.diff(np.r_[lead, len(at)])
        place = np.arange(len(at)) - np.repeat(lead, lengths)
        h = np.add.reduceat(self.value[data[at]] * self.places(int(lengths.max()))[place], lead)
        return mixed(h), np.searchsorted(starts, begin)


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges (i, j) of a batch's binary texts with about `most` bytes together, their bytes, and where each text begins (null: empty)."""
    if texts.null_count:
        texts = texts.fill_null(b"")
    if pa.types.is_large_binary(texts.type) or pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, ends, held = texts.buffers()
    if not len(texts):
        return
    offset = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offset, offset[i] + most, "right")) - 1)
        yield i, j, data[offset[i] : offset[j]], offset[i : j + 1] - offset[i]
        i = j
