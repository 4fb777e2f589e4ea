"""Line dedup by a segment-partition edit join.

Lines that are equal, or of LEAST_NEAR characters at least and within most_edits of the shorter one (in code points),
transitively, are one class; of each class only the first line stays, by doc_id, then the table's order, then place.
Blank lines (only spaces, tabs and the like) always stay.

Lines under LONG characters: each is cut into TAU + 1 even segments, so at most TAU edits leave one segment untouched.
Every line is indexed under its length and each segment, by a hash; and it probes the indexes of its own and up to TAU
smaller lengths with its substrings at the places to which edits within the other segments can have moved that one.

From LONG characters on, the segments are STRETCH bytes at least, a sixth to a third of the line, and found by content:
of every stretch the gram of least hash is an anchor, so equal stretches have equal anchors, wherever edits have moved
them. Lines that share an anchor, at places that their edits allow, are candidates. So all lines within the edits that
an equal stretch survives are found: 2 to 5 edits wherever they are, and any number allowed that leave one stretch alone,
as a replaced word does. (Lines within the edits that share an anchor, but no whole stretch, may be found too.)

Entries go to their partition as packed runs of numbers. Where lines share a key, the least of them is compared to the
others; links give components. After that only keys that more than one component shares matter: their pairs across
components are compared, in blocks of BLOCK lines, each under one key, and what a task links it compares no more. Segments that over
CAP lines of many components share are cut finer (LEVELS), of which all but TAU must match. Candidates are verified by
their furthest reaching diagonals. Lines are named by 128 bits for equality and by 64 of them for edits.

Defined results: null and empty texts have one empty line, which stays; of repeated rows all but the first lose all
lines that aren't blank (a row's own repeated lines go too); rows of one doc_id, or without one (they come first), are
told apart; lines of any length are compared whole; an empty table gives none; extra columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from itertools import combinations, compress, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import KEY, bounded_batches, join_counted, keyed, release, settle, slots, tidied, whole_text
from pathloom.llm.edit_distance import MOST, within
from pathloom.llm.graph import components
from pathloom.llm.hashing import ODD, ODD2, SPACE, Stretches, among, mix, text_blocks

TAU, LEAST_NEAR = 2, 16
#: Characters of the shortest long line, bytes of its segments (doubled with the length), characters for each edit.
LONG, STRETCH, SHARE = 120, 40, 20
#: The place of an anchor that a line has more than once, or far from its start.
ANYWHERE = 0xFFFF
LEVELS = (TAU + 1, 8, 16)
CAP, BLOCK, NEAR, FEW_LINES = 2048, 1024, 2_000_000, 16
FEW_ROWS, FEW_PLACES = 300_000, 2_000_000
PAIRS, VERIFIED = 1 << 20, 1 << 14
#: Entries that a task gathers before it deals them: a run for each part is small else.
HELD = 1 << 19
#: Sixteen classes of characters by their first byte, counted modulo 16 in four bits each; a seventeenth isn't counted.
CLASS = ((np.arange(256) * 0x9E37 >> 7) & 15).astype(np.uint8)
CLASS[[10, *range(0x80, 0xC0)]] = 16
BAG_PLACES = np.arange(0, 64, 4, dtype=np.uint64)
#: For each byte a one in the byte of its class: of the first eight classes, of the others.
ONES = [np.where(CLASS // 8 == k, np.uint64(1) << (8 * (CLASS % 8)).astype(np.uint64), np.uint64(0)) for k in (0, 1)]


def most_edits(chars: np.ndarray) -> np.ndarray:
    """Edits (code points) allowed to a line of so many characters, the shorter of two."""
    return np.where(chars < LONG, TAU, np.minimum(chars // SHARE - 1, MOST))


def class_of(chars: np.ndarray) -> np.ndarray:
    """0 from LONG characters on, and one more for each doubling."""
    return np.floor(np.log2(np.maximum(chars, LONG) / LONG) + 1e-12).astype(np.int64)


@functools.cache
def layouts(segments: int) -> list[tuple[tuple[int, ...], list[tuple[int, tuple[int, ...]]]]]:
    """For each choice of dirty segments the moves (length difference, shift of each segment; clean ones only count)
    that at most TAU edits in them can make."""
    out = []
    for dirty in combinations(range(segments), TAU):
        moves = {}
        for steps in product(range(-TAU, TAU + 1), repeat=TAU):
            if sum(map(abs, steps)) <= TAU and 0 <= sum(steps):
                shift, at = [], 0
                for k in range(segments):
                    if k in dirty:
                        at += steps[dirty.index(k)]
                        shift.append(0)
                    else:
                        shift.append(at)
                moves[sum(steps), tuple(shift)] = None
        out.append((dirty, list(moves)))
    return out


def sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """The least or greatest of each run of `width` values."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = of(x[: len(x) - step], x[step:]), done + step
    return x


class Lines:
    """The lines of some whole texts: row, place, start and size in bytes, chars."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        joints = np.flatnonzero(data == 10)
        before = np.searchsorted(joints, offsets)  # joints before each row
        n = np.diff(before) + 1
        first = np.cumsum(n) - n
        self.row = np.repeat(np.arange(len(n)), n)
        self.place = np.arange(len(self.row)) - first[self.row]
        starts, ends = np.empty(len(self.row), np.int64), np.empty(len(self.row), np.int64)
        starts[first], ends[first + n - 1] = offsets[:-1], offsets[1:]
        inner = np.flatnonzero(self.place > 0)
        starts[inner], ends[inner - 1] = joints + 1, joints
        self.start, self.end, self.size, self.data = starts, ends, ends - starts, data
        self.counts = self.size > 0
        there = np.flatnonzero(self.counts)
        there = there[SPACE[data[starts[there]]]]  # of the others the first character tells
        if len(there):
            indented, at = self.alone(there)
            self.counts[there] = np.logical_or.reduceat(~SPACE[indented], at[:-1])

    def names(self, lines: np.ndarray) -> np.ndarray:
        """128 bits for each line, in two columns."""
        raw, name = self.data.tobytes(), hashlib.blake2b
        return np.frombuffer(b"".join([name(raw[i:j], digest_size=16).digest() for i, j in zip(self.start[lines].tolist(), self.end[lines].tolist(), strict=True)]), "<i8").reshape(-1, 2)

    def count_chars(self) -> None:
        self.before = np.concatenate([np.zeros(1, np.int32), np.cumsum((self.data & 0xC0) != 0x80, dtype=np.int32)])
        self.head = self.before[self.start].astype(np.int64)
        self.chars = self.before[self.end] - self.head
        self.near = self.counts & (self.chars >= LEAST_NEAR)

    def alone(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of these lines one after another, and where each begins and the last one ends."""
        size = self.size[lines]
        offsets = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=offsets[1:])
        return self.data[np.arange(offsets[-1]) + np.repeat(self.start[lines] - offsets[:-1], size)], offsets

    def bags(self) -> np.ndarray:
        """Each line's characters by class: an edit moves two counts at most."""
        size = np.diff(np.r_[self.start, len(self.data)])
        filled, out = np.flatnonzero(size > 0), np.zeros(len(size), np.uint64)
        if not len(filled):
            return out
        start = self.start[filled]
        cuts = np.unique(np.r_[start, np.arange(0, len(self.data), 255)])  # a byte holds the count of a piece
        first = np.searchsorted(cuts, start)
        for k, ones in enumerate(ONES):
            pieces = np.add.reduceat(ones[self.data], cuts).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(pieces, first, dtype=np.uint8) & 15  # modulo 256, so modulo 16
            out[filled] |= (counts.astype(np.uint64) << BAG_PLACES[8 * k : 8 * k + 8]).sum(axis=1, dtype=np.uint64)
        return out

    def entries(self, lines: np.ndarray, segments: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(key, line, 0 for an index entry or 1) for the layouts of so many segments."""
        data, offsets = self.alone(lines)
        begins = (data & 0xC0) != 0x80
        points, head = np.append(np.flatnonzero(begins), len(data)), np.append(0, np.cumsum(begins))[offsets[:-1]]
        text, chars = Stretches(data), self.chars[lines]
        for number, (dirty, moves) in enumerate(layouts(segments)):
            # all moves at once, the index entries first
            n, of, delta = len(lines), np.tile(np.arange(len(lines)), len(moves) + 1), np.array([0, *(d for d, _ in moves)])
            base = (chars - delta[:, None]).ravel()  # the length of the indexed line
            size, start = chars[of], head[of]
            key = base.astype(np.uint64) * np.uint64(1024) + np.uint64(number)
            good = base >= LEAST_NEAR
            for k in range(segments):
                if k not in dirty:
                    move = np.repeat([0, *(shift[k] for _, shift in moves)], n)
                    a, b = base * k // segments + move, base * (k + 1) // segments + move
                    good &= (a >= 0) & (b <= size)
                    a, b = np.clip(a, 0, size), np.clip(b, 0, size)
                    key = mix(key) + text.hashes(points[start + a], points[start + np.maximum(a, b)])
            yield mix(key)[good], lines[of[good]], (np.arange(len(of)) >= n)[good].astype(np.int64)

    def anchors(self, lines: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(key, line, place in the line in characters) of the anchors of long lines, each key once a line. A line that
        the edits can shorten into the class below has that class's anchors too."""
        raw, chars = Stretches(self.data).raw, self.chars[lines]
        sums = [raw[:-8] * ODD + raw[8:] * ODD2] if len(raw) > 24 else [raw[:0]]
        sums.append(sums[0][:-8] + raw[16:] * np.uint64(0xA0761D6478BD642F) if len(raw) > 24 else raw[:0])
        own, least = class_of(chars), LONG << class_of(chars)
        below = (own > 0) & (chars - most_edits(least - 1) < least)
        for k in np.unique(own).tolist():
            yield from self.anchors_of(sums[min(k, 1)], lines[own == k], k)
            yield from self.anchors_of(sums[min(k - 1, 1)], lines[below & (own == k)], k - 1)

    def anchors_of(self, sums: np.ndarray, lines: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not len(lines):
            return
        stretch, gram = STRETCH << k, 24 if k else 16
        size = self.size[lines]
        at = np.arange(size.sum(), dtype=np.int32)  # a text has less than 2 GB
        at += np.repeat((self.start[lines] - np.cumsum(size) + size).astype(np.int32), size)
        high = sums.view(np.uint32)[1::2]  # little-endian, as all numbers here
        value = np.maximum(high[np.minimum(at, np.int32(len(sums) - 1))], np.uint32(1))
        width = stretch - gram + 1
        first = sliding(value, width, np.minimum)
        last = np.repeat(self.end[lines].astype(np.int32), size)[: len(first)]
        first = np.where(at[: len(first)] + stretch <= last, first, 0)  # no stretch crosses a line's end
        padded = np.zeros(len(first) + 2 * width - 2, np.uint32)
        padded[width - 1 : width - 1 + len(first)] = first
        chosen = np.flatnonzero(value == sliding(padded, width, np.maximum))
        at = at[chosen]
        line, key = lines[np.searchsorted(np.cumsum(size), chosen, "right")], mix(sums[np.minimum(at, np.int32(len(sums) - 1))] + np.uint64(k))
        order = np.lexsort((key, line))
        at, line, key = at[order], line[order], key[order]
        new = np.flatnonzero(np.append(True, (line[1:] != line[:-1]) | (key[1:] != key[:-1]))) if len(at) else np.zeros(0, np.int64)
        once = np.diff(new, append=len(at)) == 1
        at, line, key = at[new], line[new], key[new]
        yield key, line, np.where(once, np.minimum(self.before[at] - self.head[line], ANYWHERE), ANYWHERE)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, Lines]]:
    for a, data, offsets in text_blocks(column):
        yield a, len(offsets) - 1, Lines(data, offsets)


def occurrences(docs: DataFrame) -> DataFrame:
    """Of every row its key, a number that follows the table's order, and h1, h2, place of its lines that aren't blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, lines in blocks(batch.column(4)):
                keep = np.flatnonzero(lines.counts)
                names, counts = lines.names(keep), np.bincount(lines.row[keep], minlength=n)
                to = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                lists = [pa.ListArray.from_arrays(to, pa.array(x)) for x in (names[:, 0], names[:, 1], lines.place[keep])]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, n) for i in range(4)), *lists], names=["id", "digest", "copy", "row", "h1", "h2", "place"])

    numbered = docs.select("id", "digest", "copy", F.monotonically_increasing_id().alias("row"), "text")
    return numbered.mapInArrow(tidied(run), "id long, digest binary, copy long, row long, h1 array<long>, h2 array<long>, place array<long>")


def entry_runs(docs: DataFrame, segments: int, only: np.ndarray | None, long: bool) -> DataFrame:
    """part, kind (1: segments, 2: anchors), n, m, run: keys (the half that part does not hold), lines and places of n
    entries, then names, lengths and bags of their m lines. only: no others than these lines."""
    parts = 2 * slots(docs.sparkSession)
    shared = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def packed(kind: int, key: np.ndarray, line: np.ndarray, place: np.ndarray, name: np.ndarray, chars: np.ndarray, bag: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
        part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)  # short ones sort faster
        order = np.argsort(part, kind="stable")
        cut = np.append(0, np.cumsum(np.bincount(part, minlength=parts)))
        key, line, place, chars = key.astype(np.uint32)[order], line[order], place.astype(np.uint16)[order], chars.astype(np.uint32)
        number = np.zeros(len(name), np.uint32)
        for p in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            own = slice(cut[p], cut[p + 1])
            of = np.sort(line[own])
            of = of[np.append(True, of[1:] != of[:-1])]
            number[of] = np.arange(len(of))
            yield p, kind, len(line[own]), len(of), b"".join([key[own].tobytes(), number[line[own]].tobytes(), place[own].tobytes(), name[of].tobytes(), chars[of].tobytes(), bag[of].tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {1: [], 2: []}
        facts: list[tuple] = []
        seen = held = 0

        def give() -> Iterator[pa.RecordBatch]:
            joined = [np.concatenate(x) for x in zip(*facts, strict=True)]
            rows = [r for kind, x in found.items() if x for r in packed(kind, *(np.concatenate(v) for v in zip(*x, strict=True)), *joined)]
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "kind", "n", "m", "run"])

        for batch in batches:
            for _, _, lines in blocks(batch.column(0)):
                lines.count_chars()
                near = np.flatnonzero(lines.near)
                name = lines.names(near)[:, 0]
                take = np.unique(name, return_index=True)[1]
                if shared is not None:
                    take = take[among(name[take], shared.value)]
                near, name = near[take], name[take]
                to = np.zeros(len(lines.start), np.int64)
                to[near] = np.arange(len(near)) + seen
                chars = lines.chars[near]
                each = [(1, x) for x in lines.entries(near[chars < LONG + TAU], segments)] if len(near) else []
                if long and len(near):
                    each += [(2, x) for x in lines.anchors(near[chars >= LONG])]
                for kind, (key, line, place) in each:
                    found[kind].append((key, to[line], place))
                    held += len(key)
                facts.append((name, chars, lines.bags()[near]))
                seen += len(near)
            if held >= HELD:
                yield from give()
                found, facts, seen, held = {1: [], 2: []}, [], 0, 0
        if seen:
            yield from give()

    return docs.select("text").mapInArrow(tidied(run), "part int, kind int, n int, m int, run binary")


def alike(a: np.ndarray, b: np.ndarray, most: int | np.ndarray = TAU) -> np.ndarray:
    """Whether the bags of two lines let them be within so many edits, each of which moves at most two counts by one."""
    a, b = np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8), np.ascontiguousarray(b).view(np.uint8).reshape(-1, 8)
    total = np.zeros(len(a), np.int64)
    for x, y in ((a & 15, b & 15), (a >> 4, b >> 4)):
        d = (x - y) & 15
        total += np.minimum(d, 16 - d).sum(axis=1, dtype=np.int64)
    return total <= 2 * most


def fits(short: bool | np.ndarray, place_a: np.ndarray, place_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, bag_a: np.ndarray, bag_b: np.ndarray) -> np.ndarray:
    """Whether two lines with an equal key can be near: one has it in the index, one probes; or an anchor's places,
    lengths and characters allow the edits."""
    longer, moved, most = size_b - size_a, place_b - place_a, most_edits(np.minimum(size_a, size_b))
    good = np.where(short, place_a != place_b, ((place_a == ANYWHERE) | (place_b == ANYWHERE) | (np.abs(moved) + np.abs(longer - moved) <= most)))
    good &= np.abs(longer) <= most
    at = np.flatnonzero(good)
    good[at] = alike(bag_a[at], bag_b[at], most[at])
    return good


def stars(runs: DataFrame) -> DataFrame:
    """kind 0: pairs a < b of the least line of each key and the others that fit it. kinds 1 and 2: the members (a) of
    keys of three lines and more."""
    names = ["kind", "a", "b", "key", "bag", "place", "size"]

    def frame(**given: np.ndarray) -> pd.DataFrame:
        n = len(next(iter(given.values())))
        return pd.DataFrame({c: given.get(c, np.zeros(n, np.int64)) for c in names})

    def give(part: int, kind: int, held: list) -> Iterator[pd.DataFrame]:
        arrays, seen = [], 0
        for n, m, b in held:
            line, place = np.frombuffer(b, np.uint32, n, 4 * n), np.frombuffer(b, np.uint16, n, 8 * n)
            at = 10 * n
            arrays.append((np.frombuffer(b, np.uint32, n), line.astype(np.int64) + seen, place, np.frombuffer(b, np.int64, m, at), np.frombuffer(b, np.uint32, m, at + 8 * m), np.frombuffer(b, np.uint64, m, at + 12 * m)))
            seen += m
        key, line, place, name, size, bag = (np.concatenate(x) for x in zip(*arrays, strict=True))
        name, first, to = np.unique(name, return_index=True, return_inverse=True)
        line, size, bag = to[line], size[first].astype(np.int64), bag[first]
        whole = key.astype(np.uint64) << np.uint64(32) | line.astype(np.uint64)
        order = np.lexsort((place, whole))
        whole, place = whole[order], place[order].astype(np.int64)
        new = np.r_[True, (whole[1:] != whole[:-1]) | (place[1:] != place[:-1])] if len(whole) else np.zeros(0, bool)
        whole, place = whole[new], place[new]
        key, line = (whole >> np.uint64(32)).astype(np.int64), (whole & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        counts = np.diff(np.r_[starts, len(key)])
        different = np.add.reduceat(np.r_[0, (key[1:] == key[:-1]) & (line[1:] != line[:-1])].astype(np.int64), starts) + 1 if len(key) else counts
        head = np.repeat(starts, counts)  # the least line of the key; it may be there twice, in the index and probing
        some = np.flatnonzero(np.repeat(different > 1, counts))
        pairs = []
        for a in range(0, len(some), PAIRS):
            x = some[a : a + PAIRS]
            for other in (0, 1):
                h = head[x] + other
                good = (line[np.minimum(h, len(line) - 1)] == line[head[x]]) & (key[np.minimum(h, len(key) - 1)] == key[x]) & (line[x] != line[head[x]])
                y, h = x[good], h[good]
                good = fits(kind == 1, place[h], place[y], size[line[h]], size[line[y]], bag[line[h]], bag[line[y]])
                pairs.append(np.stack([line[h[good]], line[y[good]]]))
        if pairs:
            p = np.unique(np.concatenate(pairs, axis=1), axis=1)
            if p.shape[1]:
                yield frame(a=name[p[0]], b=name[p[1]])
        own = np.flatnonzero(np.repeat(different > 2, counts))
        for a in range(0, len(own), 1 << 16):
            x = own[a : a + (1 << 16)]
            yield frame(kind=np.full(len(x), kind), a=name[line[x]], key=key[x] | part << 32, bag=bag[line[x]].view(np.int64), place=place[x], size=size[line[x]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = (0, 0), []
        for batch in batches:
            for part, kind, n, m, blob in zip(batch["part"], batch["kind"], batch["n"], batch["m"], batch["run"], strict=True):
                if (part, kind) != now and held:
                    yield from give(*now, held)
                    held = []
                now = (int(part), int(kind))
                held.append((n, m, blob))
        if held:
            yield from give(*now, held)

    return runs.repartition(slots(runs.sparkSession), "part").sortWithinPartitions("part", "kind").mapInPandas(tidied(run), "kind int, a long, b long, key long, bag long, place int, size int")


FACTS = ["a", "comp", "bag", "place", "size"]


class Classes:
    """Components that links have made in this task."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = x = self.parent.get(up, up)
        return x

    def of(self, comp: np.ndarray) -> np.ndarray:
        names, to = np.unique(comp, return_inverse=True)
        return np.array([self.find(x) for x in names.tolist()], np.int64)[to]

    def link(self, now: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """now, what of() gave, after its places x and y are linked."""
        gone = set()
        for i, j in zip(now[x].tolist(), now[y].tolist(), strict=True):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.parent[max(i, j)] = min(i, j)
                gone.add(max(i, j))
        if gone:
            moved = np.flatnonzero(among(now, np.sort(np.array(list(gone), np.int64))))
            now[moved] = self.of(now[moved])
        return now


def cross_links(texts: DataFrame, members: DataFrame) -> DataFrame:
    """a, b: links between lines of unlike components that share a key, enough of them for the classes. Keys of over
    BLOCK lines are dealt in blocks of them, each two blocks to a task. A pair is compared under its least key alone."""
    lines = texts.withColumnsRenamed({"h1": "a", "line": "text"})
    homes = members.groupBy("a").agg(F.collect_set(F.xxhash64("kind", "key")).alias("homes"))
    sizes = members.groupBy("kind", "key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    own = members.join(sizes, ["kind", "key"]).join(lines.join(homes, "a"), "a").withColumns({"region": F.xxhash64("kind", "key"), "part": F.pmod(F.xxhash64("a"), "parts").cast("int")})
    own = own.withColumn("homes", F.filter("homes", lambda h: h < F.col("region")))  # a pair with one of them in common is compared there
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})

    def small_pairs(g: pd.DataFrame, v: dict[str, np.ndarray], starts: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of groups of up to FEW_LINES lines."""
        keep = np.flatnonzero(np.repeat(counts <= FEW_LINES, counts))
        left = (np.repeat(starts + counts, counts) - np.arange(counts.sum()) - 1)[keep]
        x = np.repeat(keep, left)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(left) - left, left)
        good = open_pairs(v, x, y)
        sets: dict[int, set[int]] = {}
        homes = g["homes"].to_numpy()
        pairs = []
        for i, j in zip(x[good].tolist(), y[good].tolist(), strict=True):
            for k in (i, j):
                if k not in sets:
                    sets[k] = set(homes[k].tolist())
            if sets[i].isdisjoint(sets[j]):
                pairs.append((i, j))
        if pairs:
            yield tuple(np.array(pairs).T)

    def open_pairs(v: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = most_edits(np.minimum(v["size"][x], v["size"][y]))
        good = (v["now"][x] != v["now"][y]) & (np.abs(v["size"][x] - v["size"][y]) <= most) & ((v["lo"][x] == v["hi"][x]) | (v["part"][x] != v["part"][y]))
        at = np.flatnonzero(good)
        return at[alike(v["bag"][x[at]], v["bag"][y[at]], most[at])]

    def large_pairs(g: pd.DataFrame, v: dict[str, np.ndarray], a: int, b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs of a group in rows a to b."""
        homes = list(g["homes"].to_numpy()[a:b])
        names, to = np.unique(np.concatenate(homes), return_inverse=True)
        line = np.repeat(np.arange(b - a), [len(h) for h in homes])
        bits = np.zeros((b - a, len(names) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (line, to // 64), np.uint64(1) << (to % 64).astype(np.uint64))
        step = max(1, (1 << 13) // (b - a))
        for i in range(a, b, step):
            own = np.arange(i, min(i + step, b))
            x, y = np.repeat(own, b - a), np.tile(np.arange(a, b), len(own))
            x, y = x[x < y], y[x < y]
            good = open_pairs(v, x, y)
            x, y = x[good], y[good]
            new = ~(bits[x - a] & bits[y - a]).any(axis=1)
            yield x[new], y[new]

    def give(g: pd.DataFrame, classes: Classes) -> Iterator[pd.DataFrame]:
        v = {c: g[c].to_numpy(np.int64) for c in ("region", "lo", "hi", "part", "a", "comp", "bag", "size")}
        starts = np.flatnonzero(np.r_[True, np.logical_or.reduce([v[c][1:] != v[c][:-1] for c in ("region", "lo", "hi")])])
        counts, texts = np.diff(np.r_[starts, len(g)]), g["text"].tolist()
        v["now"] = classes.of(v["comp"])
        groups = [small_pairs(g, v, starts, counts), *(large_pairs(g, v, i, i + n) for i, n in zip(starts.tolist(), counts.tolist(), strict=True) if n > FEW_LINES)]
        waiting = []

        def verify() -> pd.DataFrame:
            x, y = (np.concatenate(z) for z in zip(*waiting, strict=True))
            waiting.clear()
            still = v["now"][x] != v["now"][y]
            x, y = x[still], y[still]
            used, to = np.unique(np.r_[x, y], return_inverse=True)
            near = within([texts[i] for i in used.tolist()], to[: len(x)], to[len(x) :], most_edits)
            x, y = x[near], y[near]
            v["now"] = classes.link(v["now"], x, y)
            return pd.DataFrame({"a": v["a"][x], "b": v["a"][y]})

        for group in groups:
            for pairs in group:
                waiting.append(pairs)
                if sum(len(x) for x, _ in waiting) >= VERIFIED:
                    yield verify()
        if waiting:
            yield verify()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, classes = [], Classes()
        for batch in batches:
            same = np.logical_and.reduce([batch[c] == batch[c].iat[-1] for c in ("region", "lo", "hi")]) if len(batch) else np.zeros(0, bool)
            cut = len(batch) - int(same.sum())
            held.append(batch.iloc[:cut])
            if cut:
                yield from give(pd.concat(held, ignore_index=True), classes)
                held = []
            held.append(batch.iloc[cut:])
        if sum(map(len, held)):
            yield from give(pd.concat(held, ignore_index=True), classes)

    rows = dealt.repartition(slots(members.sparkSession), "region", "lo", "hi").sortWithinPartitions("region", "lo", "hi")
    return settle(rows.select("region", "lo", "hi", "part", "a", "comp", "bag", "size", "homes", "text").mapInPandas(tidied(run), "a long, b long"))


def texts_of(docs: DataFrame, names: DataFrame) -> DataFrame:
    """h1 and bytes of these lines (names: h1, distinct). A line may be there more than once."""
    few = names.count() <= NEAR
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in names.toLocalIterator()], np.int64)) if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, lines in blocks(batch.column(0)):
                take = np.flatnonzero(lines.counts & (lines.size >= LEAST_NEAR))
                h1, raw = lines.names(take)[:, 0], lines.data.tobytes()
                if few:
                    own = among(h1, shared.value)
                    take, h1 = take[own], h1[own]
                first = np.unique(h1, return_index=True)[1]
                take, h1 = take[first], h1[first]
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array([raw[i:j] for i, j in zip(lines.start[take].tolist(), lines.end[take].tolist(), strict=True)], pa.binary())], names=["h1", "line"])

    found = docs.select("text").mapInArrow(tidied(run), "h1 long, line binary")
    return found if few else found.join(names, "h1", "left_semi")


def verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of lines that are within the edits allowed, settled."""
    both = pairs.join(texts.withColumnsRenamed({"h1": "a", "line": "x"}), "a").join(texts.withColumnsRenamed({"h1": "b", "line": "y"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, to = np.unique(np.array(batch.column(2).to_pylist() + batch.column(3).to_pylist(), object), return_inverse=True)
            near = within(texts.tolist(), to[: len(batch)], to[len(batch) :], most_edits)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    return settle(both.select("a", "b", "x", "y").mapInArrow(tidied(run), "a long, b long"))


def labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members of keys that more than one component is in, with comp and the key's number of lines, lines."""
    labels = components(links).withColumnRenamed("node", "a")
    rows = members.join(labels, "a", "left").withColumn("comp", F.coalesce("comp", "a"))
    ends = rows.groupBy("kind", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("lines")).where("lo <> hi")
    return rows.join(ends.select("kind", "key", "lines"), ["kind", "key"])


def near_links(docs: DataFrame) -> DataFrame:
    """a, b (names) of distinct lines within the edits allowed, enough of them for the classes."""
    every, only = docs.sparkSession.createDataFrame([], "a long, b long"), None
    for level, segments in enumerate(LEVELS):
        found = settle(stars(entry_runs(docs, segments, only, long=level == 0)))
        pairs = settle(found.where("kind = 0").select("a", "b").distinct())
        ends = pairs.select(F.explode(F.array("a", "b")).alias("h1"))
        names = settle(ends.unionByName(found.where("kind > 0").select(F.col("a").alias("h1"))).distinct())
        texts = settle(texts_of(docs, names))  # of what is compared here and below, by one scan
        each = texts.dropDuplicates(["h1"])
        every = every.unionByName(verified(each, pairs))
        mixed = settle(labelled(found.where("kind > 0").drop("b"), every))
        release(found, pairs, names)
        dense = settle(mixed.where(f"kind = 1 and lines > {CAP}").select("a").distinct()) if level < len(LEVELS) - 1 else None
        rest = mixed if dense is None else mixed.where(f"kind = 2 or lines <= {CAP}")
        if not rest.isEmpty():
            every = every.unionByName(cross_links(each, rest))
        release(mixed, texts)
        if dense is None or dense.isEmpty():
            break
        only = np.sort(np.array([r[0] for r in dense.toLocalIterator()], np.int64)) if dense.count() <= NEAR else None
    return every


def removals(docs: DataFrame) -> DataFrame:
    """id, digest, copy of rows and the places of the lines that go."""
    every = settle(occurrences(docs))
    labels = components(near_links(docs))
    labels = F.broadcast(labels) if labels.count() <= FEW_ROWS else labels
    lines = every.select("id", "row", F.explode(F.arrays_zip("h1", "h2", "place")).alias("x")).select("id", "row", "x.*")
    equal = lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "row", "place")).alias("first"), F.count(F.lit(1)).alias("n"))
    some = equal.join(labels.withColumnRenamed("node", "h1"), "h1", "left").where("n > 1 or comp is not null")  # the others stay
    classed = settle(some.select("h1", "h2", "first", "n", F.when(F.col("comp").isNull(), F.struct("h1", "h2")).otherwise(F.struct(F.col("comp").alias("h1"), F.lit(None).cast("long").alias("h2"))).alias("class")))
    stays = classed.groupBy("class").agg(F.min("first").alias("stays"), F.sum("n").alias("all")).where("all > 1")
    repeated = settle(classed.join(stays, "class").select("h1", "h2", "n", F.col("stays.row").alias("kept_row"), F.col("stays.place").alias("kept_place")))
    gone = join_counted(lines, repeated, ["h1", "h2"]).where("row <> kept_row or place <> kept_place")
    per_row = gone.groupBy("row").agg(F.collect_list("place").alias("gone"))
    return every.select("row", "id", "digest", "copy").join(per_row, "row").drop("row")


def dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """docs with the repeated lines cut from text (no text unless with_text), n_lines, n_removed and kept_sha256 (names
    that docs has are left out). Texts without repeated lines stay byte for byte."""
    bounded_batches(docs.sparkSession)
    rows = keyed(docs)
    gone = settle(removals(rows.select(F.col("__id").alias("id"), F.col("__digest").alias("digest"), F.col("__copy").alias("copy"), whole_text().alias("text"))))
    size = gone.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("gone")).alias("m")).first()
    ours = gone.select(*(F.col(c.removeprefix("__")).alias(c) for c in KEY), F.col("gone").alias("__gone"))
    few = size["n"] <= FEW_ROWS and (size["m"] or 0) <= FEW_PLACES
    joined = rows.join(F.broadcast(ours) if few else ours, KEY, "left").select(*docs.columns, "__gone")
    columns = [c for c in docs.columns if with_text or c != "text"]
    extra = [c for c in ("n_lines", "n_removed", "kept_sha256") if c not in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, sums = [], [], []
            for text, cut in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("__gone").to_pylist(), strict=True):
                n, gone = (text or b"").count(b"\n") + 1, set(cut or ())
                if gone:
                    stays = bytearray(b"\1") * n
                    for i in gone:
                        stays[i] = 0
                    text = b"\n".join(compress(text.split(b"\n"), stays))
                texts.append(text)
                counts.append((n, len(gone)))
                sums.append(hashlib.sha256(text or b"").hexdigest())
            made = {"n_lines": pa.array([n for n, _ in counts], pa.int64()), "n_removed": pa.array([n for _, n in counts], pa.int64()), "kept_sha256": pa.array(sums, pa.string())}
            if with_text:
                made["text"] = pa.array(texts, pa.binary()).cast(batch.schema.field("text").type)
            out = [made["text"] if c == "text" else batch.column(c) for c in columns] + [made[c] for c in extra]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, *extra])

    types = dict(docs.dtypes) | {"text": "string"}
    schema = ", ".join([f"`{c}` {types[c]}" for c in columns] + [f"{c} {'string' if c == 'kept_sha256' else 'long'}" for c in extra])
    return joined.mapInArrow(tidied(run), schema)
