"""Length-prefixed lists in binary columns, walked for a whole batch at once.

All rows of a batch advance together: in each step every row that still has bytes reads one item's header, so a batch
takes as many steps as its longest list has items, each over flat arrays, and time is linear in the bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa


@dataclass(frozen=True)
class Layout:
    """Where an item's code and length are, before its value."""

    code_at: int | None
    code_bytes: int
    size_at: int
    size_bytes: int
    head: int
    #: Bytes of the value, of the number that stands for its size.
    scale: Callable[[np.ndarray], np.ndarray] = lambda n: n
    #: Items may have a path id of four bytes before them.
    paths: bool = False
    #: Flags at the start, of which one makes the length two bytes.
    wide_flag: int = 0


#: RFC 4271: prefixes with their length in bits; path attributes; segments of two- and of four-byte ASes (code and count).
PREFIXES = Layout(None, 0, 0, 1, 1, lambda n: (n + 7) // 8, paths=True)
ATTRIBUTES = Layout(1, 1, 2, 1, 3, wide_flag=0x10)
SEGMENTS = Layout(0, 1, 1, 1, 2, lambda n: 2 * n)
WIDE_SEGMENTS = Layout(0, 1, 1, 1, 2, lambda n: 4 * n)
#: RFC 7432 routes, RFC 5492 parameters and capabilities, and lists of code and length of two bytes each.
ROUTES = Layout(0, 1, 1, 1, 2, paths=True)
SHORT = Layout(0, 1, 1, 1, 2)
TLVS = Layout(0, 2, 2, 2, 4)


class Items(NamedTuple):
    """Items of all rows, by row: `size` is the number that stands there, `start` and `length` are the value's bytes."""

    data: np.ndarray
    row: np.ndarray
    code: np.ndarray
    flags: np.ndarray
    size: np.ndarray
    path_id: np.ndarray
    start: np.ndarray
    length: np.ndarray

    def number(self, at: int | np.ndarray, size: int) -> np.ndarray:
        """The number of so many bytes at a place of each value; anything beyond the value's end."""
        return number_at(self.data, np.minimum(self.start + at, len(self.data) - size), size)

    def values(self) -> list[bytes]:
        whole = self.data.tobytes()
        return [whole[a : a + n] for a, n in zip(self.start.tolist(), self.length.tolist(), strict=True)]

    def where(self, own: np.ndarray) -> Items:
        return Items(self.data, *(x[own] for x in self[1:]))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column (null: none), with some zeros after them, and where rows begin and the last one ends."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.concatenate([data[offsets[0] : offsets[-1]], np.zeros(16, np.uint8)]), offsets - offsets[0]


def number_at(data: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for k in range(size):
        out = out << 8 | data[at + k]
    return out


def walk(column: pa.Array, layout: Layout, path: np.ndarray | None = None) -> tuple[Items, np.ndarray]:
    """The items, and which rows' items don't end where their bytes do (those have none). Null rows are empty."""
    data, offsets = column_bytes(column)
    at, end, rows = offsets[:-1].copy(), offsets[1:], np.arange(len(column))
    path = np.zeros(len(column), bool) if path is None or not layout.paths else path
    bad, found = np.zeros(len(column), bool), []
    rows = rows[at < end]
    while len(rows):
        here, stop, skip = at[rows], end[rows], 4 * path[rows].astype(np.int64)
        flags = data[here].astype(np.int64) if layout.wide_flag else np.zeros(len(rows), np.int64)
        wide = (flags & layout.wide_flag) != 0
        head = layout.head + wide
        start = here + skip
        fits = start + head <= stop
        start = np.minimum(start, len(data) - 8)
        size = np.where(wide, number_at(data, start + layout.size_at, 2), number_at(data, start + layout.size_at, layout.size_bytes))
        code = size if layout.code_at is None else number_at(data, start + layout.code_at, layout.code_bytes)
        length = layout.scale(size)
        after = start + head + length
        whole = fits & (after <= stop)
        bad[rows[~whole]] = True
        number = np.where(skip > 0, number_at(data, np.minimum(here, len(data) - 4), 4), 0)
        found.append(tuple(x[whole] for x in (rows, code, flags, size, number, start + head, length)))
        at[rows[whole]] = after[whole]
        rows = rows[whole & (after < stop)]
    parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 7
    own = np.flatnonzero(~bad[parts[0]])
    by = own[np.argsort(parts[0][own], kind="stable")]
    return Items(data, *(x[by] for x in parts)), bad


def listed(rows: int, row: np.ndarray, bad: np.ndarray, values: pa.Array) -> pa.Array:
    """Values of items as a list per row, null for bad rows. Values of bad rows must not be there."""
    offsets = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=rows))].astype(np.int32))
    return pa.ListArray.from_arrays(offsets, values, mask=pa.array(bad)) if bad.any() else pa.ListArray.from_arrays(offsets, values)


def bytes_of(items: Items, at: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """A row of `width` bytes for each item: `size` of them from a place of its value on, then zeros."""
    place = (items.start + at)[:, None] + np.arange(width)
    return np.where(np.arange(width) < size[:, None], items.data[np.minimum(place, len(items.data) - 1)], 0).astype(np.uint8)
