"""Whether strings are within so many edits, by furthest reaching diagonals, for many pairs at once in numpy.

With e edits a diagonal's furthest place is a step from those with e - 1 on it and beside it, and then as far as the
strings agree. Only diagonals count from which the edits left lead to the last one, so k edits cost k * k / 2 stretches at
most, whatever the length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

MOST = 31
#: Pairs times diagonals that are worked on at once.
CELLS = 1 << 15
NOWHERE = -(1 << 30)


def points(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 texts, and where each begins and the last one ends. Bytes that aren't UTF-8 count alone."""
    decoded = [t.decode("utf-8", "surrogateescape") for t in texts]
    flat = np.frombuffer("".join(decoded).encode("utf-32-le", "surrogatepass"), np.int32)
    return flat, np.r_[0, np.cumsum([len(t) for t in decoded])].astype(np.int64)


def bigrams_allow(flat: np.ndarray, offsets: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the pairs' counts of two characters after each other, in 256 classes, let them be within so many edits: an
    edit takes two of them away and adds two at most."""
    n = len(offsets) - 1
    pair = (flat[:-1].astype(np.uint32) * np.uint32(0x9E3779B1) + flat[1:].astype(np.uint32) * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    counts = np.zeros((n, 256), np.int16)
    for a in range(0, n, 2048):
        b = min(n, a + 2048)
        size = np.maximum(np.diff(offsets[a : b + 1]) - 1, 0)
        at = np.arange(size.sum()) + np.repeat(offsets[a:b] - np.cumsum(size) + size, size)
        counts[a:b] = np.minimum(np.bincount(np.repeat(np.arange(b - a), size) * 256 + pair[at], minlength=(b - a) * 256), 30_000).reshape(-1, 256)
    good = np.zeros(len(x), bool)
    for a in range(0, len(x), 4096):
        own = slice(a, a + 4096)
        good[own] = np.abs(counts[x[own]] - counts[y[own]]).sum(axis=1, dtype=np.int64) <= 4 * most[own]
    return good


class Words:
    """Eight bytes of characters from each place on: characters are numbered in one, two or four bytes each."""

    def __init__(self, flat: np.ndarray):
        there = np.zeros(int(flat.max(initial=0)) + 1, bool)
        there[flat] = True
        kinds = int(there.sum())
        self.bytes = 1 if kinds <= 1 << 8 else 2 if kinds <= 1 << 16 else 4
        number = (np.cumsum(there) - 1).astype(f"<u{self.bytes}")[flat]
        padded, self.chars = np.concatenate([number, np.zeros(16, number.dtype)]), 8 // self.bytes
        self.at = np.empty(len(flat) + 1, np.uint64)
        for phase in range(min(self.chars, len(self.at))):
            own = self.at[phase :: self.chars]
            own[:] = np.frombuffer(padded.data, "<u8", len(own), phase * self.bytes)

    def agree(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many characters agree from these places on, `chars` at most."""
        differ = self.at[x] ^ self.at[y]
        lowest = (differ & (~differ + np.uint64(1))).astype(np.float64).view(np.int64) >> 52  # 1023 + the lowest bit
        return np.where(differ == 0, self.chars, (lowest - 1023) // (8 * self.bytes))

    def extend(self, x: np.ndarray, y: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many characters agree from these places on, `left` at most."""
        out = np.minimum(self.agree(x, y), left)
        open_, done, last = np.flatnonzero((out == self.chars) & (left > self.chars)), self.chars, len(self.at) - 1
        ahead = np.arange(8) * self.chars  # eight words at a time
        while len(open_):
            i, j = x[open_] + done, y[open_] + done
            same = self.at[np.minimum(i[:, None] + ahead, last)] == self.at[np.minimum(j[:, None] + ahead, last)]
            whole = np.where(same.all(axis=1), 7, same.argmin(axis=1)) * self.chars
            n = np.minimum(whole + self.agree(np.minimum(i + whole, last), np.minimum(j + whole, last)), left[open_] - done)
            out[open_] += n
            done += 8 * self.chars
            open_ = open_[(n == 8 * self.chars) & (left[open_] > done)]
        return out


def within(texts: list[bytes], x: np.ndarray, y: np.ndarray, most_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each pair of texts whether its edit distance in code points is at most what most_of (MOST at most) says of
    the length of the shorter one."""
    flat, offsets = points(texts)
    size = np.diff(offsets)
    x, y = np.where(size[x] <= size[y], x, y), np.where(size[x] <= size[y], y, x)
    most, longer = most_of(size[x]), size[y] - size[x]
    out, words = np.zeros(len(x), bool), Words(flat)
    order = np.flatnonzero(longer <= most)
    order = order[bigrams_allow(flat, offsets, x[order], y[order], most[order])]
    order = order[np.lexsort((longer[order], most[order]))]
    step = max(1, CELLS // (int(most[order].max(initial=0)) + 1))
    for a in range(0, len(order), step):
        own = order[a : a + step]
        out[own] = _diagonals(words, offsets[x[own]], size[x[own]], offsets[y[own]], size[y[own]], most[own])
    return out


def _diagonals(words: Words, start_a: np.ndarray, n: np.ndarray, start_b: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """n <= m. Column low + d of `far` is how far (in a) the diagonal of the places i, i + d is known to be reached."""
    longer = m - n
    low, high = int(((most - longer) // 2).max()), int(((most + longer) // 2).max())
    far = np.full((len(n), low + high + 3), NOWHERE, np.int64)  # a column more on either side
    low += 1
    far[:, low] = words.extend(start_a, start_b, n)
    out, live = far[np.arange(len(n)), low + longer] >= n, np.arange(len(n))
    for e in range(1, int(most.max()) + 1):
        stay = ~out[live] & (most[live] >= e)
        if 4 * stay.sum() < 3 * len(live) or not stay.any():
            live, far, start_a, n, start_b, m, longer = live[stay], far[stay], start_a[stay], n[stay], start_b[stay], m[stay], longer[stay]
            if not len(live):
                break
        left = int(most[live].max()) - e  # edits that may follow
        a = max(1, low - e, low + int(longer.min()) - left)
        b = min(far.shape[1] - 2, low + e, low + int(longer.max()) + left) + 1
        d = np.arange(a, b) - low
        i = np.maximum(np.maximum(far[:, a:b], far[:, a + 1 : b + 1]) + 1, far[:, a - 1 : b - 1])
        i = np.minimum(np.minimum(i, n[:, None]), m[:, None] - d)
        there = (i >= 0) & (i + d >= 0)
        i[~there] = NOWHERE
        row, column = np.nonzero(there)
        at = i[row, column]
        far[:, a:b] = i
        d = d[column]
        far[row, column + a] = at + words.extend(start_a[row] + at, start_b[row] + at + d, np.minimum(n[row] - at, m[row] - at - d))
        out[live] |= (far[np.arange(len(live)), low + longer] >= n) & (most[live] >= e)
    return out
