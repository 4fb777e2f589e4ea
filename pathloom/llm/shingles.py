"""Word shingles of raw UTF-8 columns, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pathloom.llm.hashing import LOWER, Stretches, mix, text_blocks, word_bounds

SIZE = 5
PLACES = mix(np.arange(101, 101 + SIZE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles; of fewer words than a shingle has, of all its words."""
    for _, data, offsets in text_blocks(column):
        yield from block_sets(LOWER[data], offsets)


def block_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    starts, ends = word_bounds(data, offsets)
    words = Stretches(data).hashes(starts, ends)
    first = np.searchsorted(starts, offsets)
    full = np.zeros(max(0, len(words) - SIZE + 1), np.uint64)
    for k in range(SIZE):
        full += words[k : k + len(full)] * PLACES[k]
    full = mix(full)
    for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if j - i >= SIZE:
            s = np.sort(full[i : j - SIZE + 1])
            yield s[np.r_[True, s[1:] != s[:-1]]]
        elif j > i:
            yield mix((words[i:j] * PLACES[: j - i]).sum(dtype=np.uint64, keepdims=True) + np.uint64(j - i))
        else:
            yield np.zeros(0, np.uint64)
