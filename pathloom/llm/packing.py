"""Packing of token sequences by minimum bin slack.

Documents become ids of a public tokenizer plus an end id. Whole windows of long documents fill sequences alone; what
remains of each document is an item. A window takes the longest remaining item and the multiset of remaining lengths
that comes closest to the capacity: a subset-sum dynamic program over a bitset, whose counts are found by tracing the
bitsets back. Where the best multiset leaves slack, the next item is cut to fill it, and at the very end of a
partition the rest is cut into sequences whose lengths are powers of two, so nothing is padded.

Each partition packs its own documents in blocks of bounded size, in one pass without a shuffle; sequence ids hold the
partition number, so they are unique and the same when a task runs again.

Defined results: a null or empty text is the end id alone; repeated rows are packed each on their own; a document of
any length is kept whole, cut into pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import FORGET, bounded_batches, tidied, whole_text
from pathloom.llm.hashing import Stretches, text_blocks, word_bounds

#: Stands between chunks that are encoded together; its one token comes from no other text.
MARK = "\x01"
TAILS = ".,;:!?*#$%&|"
TABLE_BITS, MOST_WORDS = 20, 600_000
BLOCK_TOKENS = 1 << 19


class WordTable:
    """Ids by two 64-bit hashes of a word's bytes (which are the word itself up to 16 bytes): open addressing in numpy
    arrays, looked up and filled many at a time."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.keys, self.checks, self.at, self.n = (np.zeros(1 << TABLE_BITS, t) for t in (np.uint64, np.uint64, np.int64, np.int32))
        self.ids, self.end, self.held = np.zeros(1 << 20, np.uint32), 0, 0

    def has(self, i: np.ndarray, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        return (self.keys[i] == h) & (self.checks[i] == check)

    def slots(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Where each word is, or the free slot where its search ends."""
        mask = np.uint64((1 << TABLE_BITS) - 1)
        i = (h & mask).astype(np.int64)
        open_ = np.flatnonzero(~self.has(i, h, check) & (self.keys[i] != 0))
        while len(open_):
            i[open_] = (i[open_] + 1) & int(mask)
            own = i[open_]
            open_ = open_[~self.has(own, h[open_], check[open_]) & (self.keys[own] != 0)]
        return i

    def add(self, h: np.ndarray, check: np.ndarray, ids: list[bytes]) -> None:
        """New, distinct words."""
        size = np.array([len(x) // 4 for x in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4")
        while self.end + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.end : self.end + len(flat)] = flat
        at = self.end + np.cumsum(size) - size
        self.end, self.held = self.end + len(flat), self.held + len(h)
        left = np.arange(len(h))
        while len(left):  # of those that end at one free slot the first takes it
            slot = self.slots(h[left], check[left])
            _, first = np.unique(slot, return_index=True)
            own, to = left[first], slot[first]
            self.keys[to], self.checks[to], self.at[to], self.n[to] = h[own], check[own], at[own], size[own]
            left = np.delete(left, first)


class ChunkTokenizer:
    """Ids of whole texts by a tokenizer whose tokens never cross white space; each distinct chunk is encoded once."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        (self.mark,) = self.of.encode(MARK, add_special_tokens=False).ids
        self.table = WordTable()
        self.words: dict[str, bytes] = {}
        self.ends = np.array([(self.of.id_to_token(i) or "").endswith("</w>") for i in range(self.of.get_vocab_size())])

    def texts(self, column: pa.Array, end_id: int) -> Iterator[np.ndarray]:
        """The ids of each row, an end id after them."""
        for _, data, offsets in text_blocks(column):
            yield from self.block(data, offsets, end_id)

    def block(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> Iterator[np.ndarray]:
        starts, ends = word_bounds(data, offsets)
        h, check = Stretches(data).pairs(starts, ends)
        h = np.maximum(h, np.uint64(1))
        if self.table.held > MOST_WORDS:
            self.table.clear()
        slot = self.table.slots(h, check)
        missing = np.flatnonzero(~self.table.has(slot, h, check))
        if len(missing):
            own = missing[np.lexsort((check[missing], h[missing]))]
            raw, at = data.tobytes(), own[np.r_[True, (h[own[1:]] != h[own[:-1]]) | (check[own[1:]] != check[own[:-1]])]]
            self.table.add(h[at], check[at], self.learn([raw[i:j].decode("utf-8", "replace") for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]))
            slot = self.table.slots(h, check)
        size = self.table.n[slot].astype(np.int64)
        before = np.r_[0, np.cumsum(size)]
        flat = self.table.ids[np.repeat(self.table.at[slot] - before[:-1], size) + np.arange(before[-1])]
        bounds = before[np.searchsorted(starts, offsets)]
        flat = np.insert(flat, bounds[1:], np.uint32(end_id))
        bounds += np.arange(len(bounds))
        for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield flat[i:j]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks. Letters and a tail of marks are two pre-tokens: words are encoded once for all their tails
        and, in ASCII, cases, many in one text; their last token tells where each ends. Others go through MARK."""
        if len(self.words) > MOST_WORDS // 4:
            self.words.clear()
        words, found, others = self.words, [b""] * len(chunks), []
        plain = []
        for k, c in enumerate(chunks):
            word = c.rstrip(TAILS)
            if word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha()):
                plain.append((k, word.lower() if word.isascii() else word, c[len(word) :]))
            else:
                others.append(k)
        unknown = list({w for _, w, _ in plain if w not in words})
        for a in range(0, len(unknown), 512):
            part = unknown[a : a + 512]
            ids = self.encode(" ".join(part))
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokenizer has no single last token of a word")
            raw = ids.tobytes()
            for w, i, j in zip(part, [0, *cuts], cuts, strict=False):
                words[w] = raw[4 * i : 4 * j]
        for tail in {t for _, _, t in plain} - words.keys():
            words[tail] = self.encode(tail).tobytes()
        for k, word, tail in plain:
            found[k] = words[word] + words[tail]
        joined = [k for k in others if MARK not in chunks[k]]
        for a in range(0, len(joined), 256):
            part = joined[a : a + 256]
            ids = self.encode(f" {MARK} ".join([chunks[k] for k in part]))
            raw, cuts = ids.tobytes(), np.flatnonzero(ids == self.mark).tolist()
            for k, i, j in zip(part, [-1, *cuts], [*cuts, len(ids)], strict=True):
                found[k] = raw[4 * i + 4 : 4 * j]
        for k in others:
            if MARK in chunks[k]:
                found[k] = self.encode(chunks[k]).tobytes()
        return found

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.of.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")


@functools.cache
def tokenizer(path: str) -> ChunkTokenizer:
    return ChunkTokenizer(path)


FORGET[__name__] = tokenizer.cache_clear


def fill(counts: dict[int, int], lengths: list[int], capacity: int) -> tuple[int, dict[int, int]]:
    """The reachable sum closest to capacity and how many of each length make it. lengths: descending."""
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    for length in lengths:
        if length > capacity:
            continue
        left, k = min(counts[length], capacity // length), 1
        while left > 0 and not reach >> capacity & 1:  # counts by binary splitting
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (k * length) & mask
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    best = rest = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, k, before in reversed(steps):
        if not before >> rest & 1:
            rest -= k * length
            used[length] = used.get(length, 0) + k
    return best, used


class Packer:
    """Items of one partition: (document, start, length). Emits sequences as lists of items."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: dict[int, list[tuple[int, int]]] = {}

    def add(self, doc: int, start: int, length: int) -> None:
        self.items.setdefault(length, []).append((doc, start))

    def take(self, length: int) -> tuple[int, int, int]:
        held = self.items[length]
        doc, start = held.pop()
        if not held:
            del self.items[length]
        return doc, start, length

    def sequences(self, reserve: int) -> Iterator[list[tuple[int, int, int]]]:
        """Full windows, until fewer than `reserve` items are left or they can't fill a window."""
        left = sum(map(len, self.items.values()))
        total = sum(n * len(x) for n, x in self.items.items())
        while left > reserve and total >= self.capacity:
            order = sorted(self.items, reverse=True)
            counts = {n: len(self.items[n]) for n in order}
            counts[order[0]] -= 1
            best, used = fill(counts, order, self.capacity - order[0])
            used[order[0]] = used.get(order[0], 0) + 1
            slack = self.capacity - order[0] - best
            for _ in range(1 if slack else min(len(self.items[n]) // k for n, k in used.items())):
                window = [self.take(n) for n, k in used.items() for _ in range(k)]
                left -= len(window)
                if slack:
                    doc, start, length = self.take(max(self.items))
                    window.append((doc, start, slack))
                    self.add(doc, start + slack, length - slack)
                total -= self.capacity
                yield window

    def rest(self) -> Iterator[list[tuple[int, int, int]]]:
        """Everything left, in sequences whose lengths are powers of two."""
        queue = [self.take(n) for n in sorted(self.items, reverse=True) for _ in range(len(self.items[n]))]
        total = sum(n for _, _, n in queue)
        while total:
            size = min(self.capacity, 1 << total.bit_length() - 1)
            total, window = total - size, []
            while size:
                doc, start, length = queue.pop()
                take = min(size, length)
                window.append((doc, start, take))
                size -= take
                if take < length:
                    queue.append((doc, start + take, length - take))
            yield window


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, with_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if with_ids, its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, packer = tokenizer(tokenizer_path), Packer(capacity)
        names: dict[int, tuple[object, np.ndarray]] = {}
        sequence, doc, tokens = TaskContext.get().partitionId() << 36, 0, 0

        def out(windows: Iterator[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for window in windows:
                offset = 0
                for d, start, length in window:
                    name, ids = names[d]
                    piece = ids[start : start + length]
                    rows.append((name, start, length, zlib.crc32(piece.tobytes()), len(ids), sequence, offset, *([piece.astype("i4")] if with_ids else ())))
                    offset += length
                sequence += 1
            columns = list(zip(*rows, strict=True)) or [()] * (7 + with_ids)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 7 else pa.list_(pa.int32())) for k, c in enumerate(columns)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + with_ids])

        def whole(d: int, n: int) -> Iterator[list[tuple[int, int, int]]]:
            for start in range(0, n - n % capacity, capacity):
                yield [(d, start, capacity)]

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), tok.texts(batch.column(1), end_id), strict=True):
                names[doc] = name, ids
                if len(ids) >= capacity:
                    yield out(whole(doc, len(ids)))
                if len(ids) % capacity:
                    packer.add(doc, len(ids) - len(ids) % capacity, len(ids) % capacity)
                tokens += len(ids)
                doc += 1
                if tokens >= BLOCK_TOKENS:
                    yield out(packer.sequences(reserve=64))
                    names = {d: (names[d][0], names[d][1].copy()) for held in packer.items.values() for d, _ in held}
                    tokens = 0
        yield out(packer.sequences(reserve=0))
        yield out(packer.rest())

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(tidied(run), schema)
