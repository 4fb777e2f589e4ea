"""Hashes of stretches of UTF-8 columns, in numpy: not linear in the bytes, so no pattern of text makes them meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; what a block needs is a small multiple of it.
BLOCK_BYTES = 1 << 18
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Longer stretches are hashed one by one.
LONGEST = 256
ODD, ODD2 = np.uint64(0xD1342543DE82EF95), np.uint64(0x9E3779B97F4A7C15)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Stretches:
    """Hashes of stretches of data. Level k has, for each place, the hash of the 8 << k bytes from there on, made of
    two of the level below; a stretch is hashed from the level of its length, at its start and up to its end."""

    def __init__(self, data: np.ndarray):
        n, padded = len(data), np.concatenate([data, np.zeros(16, np.uint8)])
        self.data, self.raw = data, np.empty(n + 1, np.uint64)
        for phase in range(min(8, n + 1)):
            own = self.raw[phase::8]
            own[:] = np.frombuffer(padded.data, "<u8", len(own), phase)
        self.levels: list[np.ndarray] = []

    def level(self, k: int) -> np.ndarray:
        if not self.levels:
            self.levels.append(mix(self.raw))
        while len(self.levels) <= k:
            last, step = self.levels[-1], 8 << len(self.levels) - 1
            self.levels.append(mix(last[:-step] + ODD * last[step:]) if len(last) > step else last[:0])
        return self.levels[k]

    def halves(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = end - start
        a, b = np.empty(len(size), np.uint64), np.empty(len(size), np.uint64)
        short = size < 8
        a[short] = b[short] = self.raw[start[short]] & MASKS[size[short]]
        k, most = 0, size.max(initial=0)
        while 8 << k <= min(most, LONGEST - 1):
            own = (size >= 8 << k) & (size < 16 << k)
            if own.any():
                level = self.level(k)
                a[own], b[own] = level[start[own]], level[end[own] - (8 << k)]
            k += 1
        for i in np.flatnonzero(size >= LONGEST).tolist() if most >= LONGEST else ():
            a[i], b[i] = np.frombuffer(hashlib.blake2b(self.data[start[i] : end[i]], digest_size=16).digest(), "<u8")
        return a, b, size.astype(np.uint64)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64 bits for each stretch."""
        a, b, size = self.halves(start, end)
        return mix(a + ODD * b + ODD2 * size)

    def pairs(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Twice 64 bits for each stretch; up to 16 bytes no two stretches have the same."""
        a, b, size = self.halves(start, end)
        return mix(a + ODD * b + ODD2 * size), mix(b + size)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and where each row begins and the last one ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The rows of a string column in blocks of about BLOCK_BYTES, longer texts alone: first row, bytes, offsets."""
    data, offsets = utf8(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1)
        yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and ends; no word crosses a row's end."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:-1]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
