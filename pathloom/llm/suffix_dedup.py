"""Removal of repeated byte strings by a distributed merge sort of suffixes that knows common prefixes.

A byte goes if a string of LENGTH bytes that covers it starts anywhere else too. Sorting every suffix isn't needed:
each window of LENGTH bytes has an anchor, the leftmost least k-mer hash among its first SPAN starts, and equal windows
have their anchors at equal places. So only suffixes at anchors are sorted, about one in SPAN / 2 bytes.

1. Equal texts are one text, named by its digest: copies of LENGTH bytes or more go whole, and one stands for all.
2. An anchor matters if the SURE bytes from it on occur at another anchor too (a count by hash).
3. For these, each batch of documents sorts its suffixes, front-codes them (bytes shared with the suffix before are
   not sent again, nor those the contexts before the anchors share) and sends one sorted run to each partition, by a
   hash of the SURE bytes: only suffixes that share them need to meet. A partition merges its runs with a loser tree
   that compares two suffixes only from the prefix they are known to share with the last one given out.
4. Suffixes with SURE bytes in common are neighbours. The prefix lengths known from the merge, and those that the
   sorted contexts before the anchors share, say which windows are equal, for each offset from the anchor; repeated
   ones give an interval for each anchor. Anchors with over HOT members count windows by 128-bit hashes in Spark.
5. Intervals are merged by text and cut out of it.

Defined results: null and empty texts have no bytes; texts shorter than LENGTH stay as they are; matches never cross
documents; copies and repeated rows go whole; texts of any length are read whole; extra columns are ignored; what goes
depends on the texts alone, so rows without a doc_id, or with one and the same, are told apart; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import bounded_batches, digest_of, join_counted, release, settle, slots, tidied, whole_text
from pathloom.llm.hashing import MASKS, ODD, ODD2, Stretches, mix, text_blocks

LENGTH, SPAN, KMER = 200, 100, 16
SURE = LENGTH - SPAN + 1
HOT, BATCH, RUN = 20_000, 8_000, 40_000
NEAR_IDS, NEAR_COPIES, NEAR_ROWS, NEAR_SPANS = 1_000_000, 500_000, 200_000, 1_000_000


class Block:
    """Anchors of some whole documents: row, at, and the first and last window start that has it (places in data)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, n = data, offsets, len(data)
        self.raw = raw = Stretches(data).raw
        starts, ends = offsets[:-1], offsets[1:] - LENGTH
        whole = ends >= starts
        self.row = self.at = self.first = self.last = np.zeros(0, np.int64)
        if not whole.any():
            return
        bits = np.uint64(max(n, 1).bit_length())
        key = mix(raw[: n - KMER + 1] * ODD + raw[KMER - 8 : n - 7] * ODD2) >> bits << bits | np.arange(n - KMER + 1, dtype=np.uint64)
        padded = np.full(-(-len(key) // SPAN) * SPAN + SPAN, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        rows = padded.reshape(-1, SPAN)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        window = np.concatenate([np.arange(a, b + 1) for a, b in zip(starts[whole].tolist(), ends[whole].tolist(), strict=True)])
        row = np.repeat(np.flatnonzero(whole), (ends - starts + 1)[whole])
        at = (np.minimum(behind[window], ahead[window + SPAN - 1]) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
        self.row, self.at, self.first, self.last = row[new], at[new], window[new], window[np.r_[new[1:] - 1, len(at) - 1]]

    def hashes(self, at: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
        """Hashes of the stretches of this length, eight bytes after eight."""
        h = np.full(len(at), seed, np.uint64)
        for k in range(0, length, 8):
            lane = self.raw[at + k]
            h = mix(h * ODD + (lane if k + 8 <= length else lane & MASKS[length - k]) + ODD2)
        return h


def blocks(column: pa.Array) -> Iterator[tuple[int, Block]]:
    """Runs of rows as blocks, with the number of the first row."""
    for a, data, offsets in text_blocks(column):
        yield a, Block(data, offsets)


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


def scan(docs: DataFrame) -> DataFrame:
    """row, n_bytes, digest of the text, and its anchors: hash of the SURE bytes from each on, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, block in blocks(batch.column(1)):
                n = len(block.offsets) - 1
                digest = [hashlib.md5(block.data[i:j].tobytes()).digest() for i, j in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
                counts = np.bincount(block.row, minlength=n)
                place = (block.at - block.offsets[block.row]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), pa.array(np.diff(block.offsets)), pa.array(digest, pa.binary()), ragged(block.hashes(block.at, SURE).view(np.int64), counts), ragged(place, counts)], names=["row", "n_bytes", "digest", "hashes", "places"])

    return docs.mapInArrow(tidied(run), "row long, n_bytes long, digest binary, hashes array<long>, places array<long>")


def front_coded(contexts: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """A sorted run: (suffix from the anchor, bytes before it reversed, row, place of the anchor), most shared first."""
    contexts.sort()
    before, back, parts, numbers = b"", b"", [], []
    for suffix, left, name, at in contexts:
        p, q = shared(before, suffix, 0), shared(back, left, 0)
        parts += [suffix[p:], left[q:]]
        numbers += [p, len(suffix) - p, q, len(left) - q, name, at]
        before, back = suffix, left
    return np.array(numbers, np.int64).astype("<i8").tobytes() + b"".join(parts)


def shared(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which so much is known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, step = known, 16
    while a[lo : lo + step] == b[lo : lo + step]:
        lo += step
    while a[lo] == b[lo]:
        lo += 1
    return lo


def decoded(blob: bytes, count: int) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """The contexts of a run, each with the length of the prefix its suffix shares with the one before."""
    numbers = np.frombuffer(blob, "<i8", 6 * count).reshape(-1, 6).tolist()
    at, suffix, left = 48 * count, b"", b""
    for p, n, q, m, name, place in numbers:
        suffix, left = suffix[:p] + blob[at : at + n], left[:q] + blob[at + n : at + n + m]
        at += n + m
        yield p, suffix, left, name, place


def merged(runs: list[Iterator[tuple[int, bytes, bytes, int, int]]]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """All contexts by suffix, each with the prefix length shared with the one given out before it. A loser tree: an
    entry's known length is what it shares with the last winner of its match; more shared means smaller."""
    k = 1 << max(0, (len(runs) - 1).bit_length())
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (k - len(runs))
    known = [0] * k

    def beats(i: int, j: int) -> bool:
        """Whether run i's head goes before run j's; the loser learns what it shares with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if known[i] != known[j]:
            return known[i] > known[j]
        p = shared(a[1], b[1], known[i])
        first = a[1][p : p + 1] <= b[1][p : p + 1]
        known[j if first else i] = p
        return first

    losers, winners = [0] * (2 * k), [*[0] * k, *range(k)]
    for node in range(k - 1, 0, -1):
        i, j = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (i, j) if beats(i, j) else (j, i)
    top = winners[1] if k > 1 else 0
    while heads[top] is not None:
        yield (known[top], *heads[top][1:])
        heads[top] = next(runs[top], None) if top < len(runs) else None
        if heads[top] is not None:
            known[top] = heads[top][0]
        node = (top + k) // 2
        while node:
            if beats(losers[node], top):
                losers[node], top = top, losers[node]
            node //= 2


def repeated(groups: list[list[tuple[int, bytes, bytes, int, int]]]) -> list[tuple[int, int, int]]:
    """(row, start, end) of the stretch of each context's windows that another context of its group has too. A context
    comes with the prefix its suffix shares with the one before it, in the order of suffixes."""
    every = [g for group in groups if len(group) > 1 for g in group]
    if not every:
        return []
    n = len(every)
    first = np.cumsum([0] + [len(g) for g in groups if len(g) > 1])[:-1]
    known = np.array([g[0] for g in every])
    known[first] = 0
    lefts, rights = np.array([len(g[2]) for g in every]), np.array([len(g[1]) for g in every])
    order = sorted(range(n), key=lambda i: every[i][2])
    before = np.array([0, *(shared(every[i][2], every[j][2], 0) for i, j in zip(order, order[1:], strict=False))])
    order = np.array(order)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    for offset in range(min(SPAN, int(lefts.max()) + 1)):
        has = np.flatnonzero((lefts >= offset) & (rights >= LENGTH - offset))
        if len(has) < 2:
            continue
        left = np.empty(n, np.int64)
        left[order] = np.cumsum(before < offset)  # equal where the bytes before the anchors are
        window = np.cumsum(known < LENGTH - offset) * (n + 1) + left
        by = np.argsort(window[has])
        same = window[has][by][1:] == window[has][by][:-1]
        twice = has[by[np.r_[same, False] | np.r_[False, same]]]
        low[twice] = np.minimum(low[twice], offset)
        high[twice] = offset
    return [(g[3], g[4] - b, g[4] - a + LENGTH) for g, a, b in zip(every, low.tolist(), high.tolist(), strict=True) if b >= 0]


def contexts(docs: DataFrame, hot: bool) -> DataFrame:
    """docs: row, text, places of the anchors that matter. Sorted runs (part, n, run), or for hot anchors a row for each
    window (h1, h2: its hash twice; row, start)."""
    parts = 2 * slots(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def runs(bags: dict[int, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(bags), pa.int32()), pa.array([len(v) for v in bags.values()], pa.int32()), pa.array([front_coded(v) for v in bags.values()], pa.binary())], names=["part", "n", "run"])

        bags: dict[int, list] = {}
        for batch in batches:
            for a, block in blocks(batch.column(1)):
                n = len(block.offsets) - 1
                names = batch.column(0).slice(a, n).to_numpy(zero_copy_only=False)
                wanted = batch.column(2).slice(a, n)
                counts = wanted.value_lengths().to_numpy(zero_copy_only=False)
                absolute = wanted.flatten().to_numpy(zero_copy_only=False) + np.repeat(block.offsets[:-1], counts)
                take = np.flatnonzero(np.isin(block.at, absolute))
                where = block.hashes(block.at[take], SURE) % np.uint64(parts)
                raw = block.data.tobytes()
                if hot:
                    lengths = (block.last - block.first + 1)[take]
                    start = np.repeat(block.first[take] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
                    row = np.repeat(block.row[take], lengths)
                    h1, h2 = block.hashes(start, LENGTH), block.hashes(start, LENGTH, seed=1)
                    yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(names[row]), pa.array(start - block.offsets[row])], names=["h1", "h2", "row", "start"])
                    continue
                for part, r, at, first, last in zip(where.tolist(), block.row[take].tolist(), block.at[take].tolist(), block.first[take].tolist(), block.last[take].tolist(), strict=True):
                    bags.setdefault(part, []).append((raw[at : last + LENGTH], raw[first:at][::-1], int(names[r]), at - int(block.offsets[r])))
                if sum(map(len, bags.values())) > RUN:
                    yield runs(bags)
                    bags = {}
        if bags:
            yield runs(bags)

    return docs.mapInArrow(tidied(run), "h1 long, h2 long, row long, start long" if hot else "part int, n int, run binary")


def merge_runs(runs: DataFrame) -> DataFrame:
    """row, start, end from the sorted runs of each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def give(part: list) -> Iterator[pd.DataFrame]:
            groups, held = [[]], 0
            for context in merged([decoded(blob, n) for n, blob in part]):
                if context[0] < SURE and groups[-1]:
                    if held >= BATCH:
                        yield pd.DataFrame(repeated(groups), columns=["row", "start", "end"])
                        groups, held = [], 0
                    groups.append([])
                groups[-1].append(context)
                held += 1
            yield pd.DataFrame(repeated(groups), columns=["row", "start", "end"])

        now, held = None, []
        for batch in batches:
            for part, n, blob in zip(batch["part"], batch["n"], batch["run"], strict=True):
                if part != now and held:
                    yield from give(held)
                    held = []
                now = part
                held.append((n, blob))
        if held:
            yield from give(held)

    return runs.repartition(slots(runs.sparkSession), "part").sortWithinPartitions("part").mapInPandas(tidied(run), "row long, start long, end long")


def united(spans: DataFrame) -> DataFrame:
    """digest and its spans (array of start, end) as maximal runs: start, end, start, end, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for spans in batch["spans"]:
                flat: list[int] = []
                for start, end in sorted((s["start"], s["end"]) for s in spans):
                    if flat and start <= flat[-1]:
                        flat[-1] = max(flat[-1], end)
                    else:
                        flat += [start, end]
                out.append(flat)
            yield pd.DataFrame({"digest": batch["digest"], "spans": out})

    return spans.mapInPandas(tidied(run), "digest binary, spans array<long>")


def cut(docs: DataFrame, with_text: bool) -> DataFrame:
    """docs: doc_id, text, spans. What stays of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch["text"], batch["spans"], strict=True):
                raw, kept, at, n = text.encode("utf-8", "surrogatepass"), [], 0, 0
                for start, end in np.reshape(spans if spans is not None else [], (-1, 2)).astype(int).tolist():
                    kept.append(raw[at:start])
                    n, at = n + 1, end
                left = b"".join(kept) + raw[at:]
                row = (len(raw), len(raw) - len(left), n, hashlib.sha256(left).hexdigest())
                rows.append((*row, left.decode("utf-8", "replace")) if with_text else row)
            out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: 4 + with_text])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return docs.mapInPandas(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text)


def distinct_texts(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """text and digest, once each. copies: the digests that several rows have; a few of them are told to all tasks, so
    that texts that occur once need no aggregation."""
    one = F.first("text").alias("text")
    if copies.count() > NEAR_COPIES:
        return docs.groupBy("digest").agg(one).select("text", "digest")
    few = F.broadcast(copies.select("digest"))
    again = docs.join(few, "digest", "left_semi").groupBy("digest").agg(one).select("text", "digest")
    return docs.join(few, "digest", "left_anti").select("text", "digest").unionByName(again)


def sized(spans: DataFrame, what: str) -> DataFrame:
    """Broadcast if rows and array elements are few enough."""
    size = spans.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(what)).alias("m")).first()
    return F.broadcast(spans) if size["n"] <= NEAR_ROWS and (size["m"] or 0) <= NEAR_SPANS else spans


def remove(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if with_text, kept_text of every row."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).withColumn("digest", digest_of(F.col("text")))
    known = settle(scan(docs.select(F.monotonically_increasing_id().alias("row"), "text")))
    copies = settle(known.where(f"n_bytes >= {LENGTH}").groupBy("digest").agg(F.min("row").alias("first"), F.first("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    spare = settle(join_counted(known.select("row", "digest"), copies.select("digest", "first", "n"), ["digest"]).where("row <> first").select("row"))
    few = F.broadcast(spare) if spare.count() <= NEAR_IDS else spare
    anchors = known.join(few, "row", "left_anti").select("row", F.explode(F.arrays_zip("hashes", "places")).alias("x")).select("row", F.col("x.hashes").alias("h"), F.col("x.places").alias("place"))
    twice = settle(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    places = join_counted(anchors, twice, ["h"]).groupBy("row", (F.col("n") > HOT).alias("hot")).agg(F.collect_set("place").alias("places"))
    wanted = settle(places.join(known.select("row", "digest"), "row"))
    texts = distinct_texts(docs, copies)
    found = settle(merge_runs(contexts(texts.join(wanted.where("not hot"), "digest").select("row", "text", "places"), hot=False)))
    busy = wanted.where("hot").drop("hot")
    if not busy.isEmpty():
        windows = settle(contexts(texts.join(sized(busy, "places"), "digest").select("row", "text", "places"), hot=True))
        again = settle(windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        found = found.unionByName(join_counted(windows, again, ["h1", "h2"]).select("row", "start", (F.col("start") + LENGTH).alias("end")))
    by_text = found.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans")).join(known.select("row", "digest"), "row").select("digest", "spans")
    whole = copies.select("digest", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"))
    spans = settle(united(by_text.join(whole, "digest", "left_anti").unionByName(whole)))
    out = docs.join(sized(spans, "spans"), "digest", "left").select("doc_id", "text", "spans")
    release(known, copies, spare, twice, wanted, found)
    return cut(out, with_text)
