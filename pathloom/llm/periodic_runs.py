"""Stretches of words that repeat with a period, found by harmonic grid probing.

For each period p the words at jp and (j+1)p are compared, for all j: n/p tests, so n log n for a text of n words. A
run of at least four periods holds four grid points, hence three equal pairs in a row; what survives is extended to
both sides by comparing chunks of the text with itself p words on. Grid points inside a stretch that is known already
are passed over: of this period, or of a period that divides it, if both points of the pair lie in that run (any run of
p that holds them is then that run, so a run's period is always its smallest).

Defined results: a null or empty text has no words and no runs; rows are worked on one by one, so repeated rows, null
and repeated doc_ids each get their own result; other columns are dropped whatever their names; an empty table gives
none. A text is worked on whole, in memory of a few times its words; pairs are tested a bounded number at a time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import bounded_batches, tidied, whole_text

#: A run has at least so many words, and so many times its period.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Pairs tested at once, words of texts worked on together, first chunk of an extension.
PAIRS, WORDS, CHUNK = 1 << 19, 1 << 16, 64
SPACES = "[\\x20\\x09-\\x0D]+"

Run = tuple[int, int, int]


def equal_ahead(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading elements are equal, in chunks that double."""
    at, chunk, n = 0, CHUNK, min(len(a), len(b))
    while at < n:
        differ = a[at : min(n, at + chunk)] != b[at : min(n, at + chunk)]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, chunk = at + chunk, min(2 * chunk, 1 << 16)
    return n


def probed(words: np.ndarray, base: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and place (in words) of grid points from which three pairs in a row are equal, by text, period and
    place, for texts laid end to end in words."""
    most = np.where(size >= LEAST_WORDS, size // LEAST_TIMES, 0)
    text = np.repeat(np.arange(len(size)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    pairs = (size[text] - 1) // period
    ends = np.cumsum(pairs)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
        n, p, t = pairs[a:b], period[a:b], text[a:b]
        own = np.repeat(np.arange(b - a), n)
        place = (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)) * p[own]
        first = base[t[own]] + place
        same = words[first] == words[first + p[own]]
        three = np.flatnonzero(same[:-2] & same[1:-1] & same[2:] & (own[:-2] == own[2:]))
        for k in range(1, 6):  # a run has all pairs of the two periods from its first grid point on
            if not len(three):
                break
            q = p[own[three]]
            at = first[three] + 2 * q * k // 6
            three = three[words[at] == words[at + q]]
        if len(three):
            yield t[own[three]], p[own[three]], place[three]
        a = b


class Runs:
    """The runs of one text, found period by period."""

    def __init__(self, words: np.ndarray):
        self.words, self.found = words, list[Run]()
        self.starts: dict[int, list[int]] = {}
        self.ends: dict[int, list[int]] = {}
        self.period = self.known = 0
        self.dividing: list[int] = []

    def probe(self, period: int, place: int) -> None:
        """Extend from an equal pair. Periods rise, and places within a period."""
        if period != self.period:
            self.period, self.known = period, 0
            self.dividing = [q for q in self.starts if period % q == 0]
        if place < self.known:
            return
        for q in self.dividing:
            k = bisect_right(self.starts[q], place) - 1
            if k >= 0 and place + period < self.ends[q][k]:
                self.known = self.ends[q][k] - period
                return
        w = self.words
        after = place + equal_ahead(w[place:], w[place + period :])
        before = place - equal_ahead(w[:place][::-1], w[: place + period][::-1][: place])
        self.known = after
        if after + period - before >= max(LEAST_WORDS, LEAST_TIMES * period):
            self.found.append((before, after + period - before, period))
            self.starts.setdefault(period, []).append(before)
            self.ends.setdefault(period, []).append(after + period)


def find_runs(texts: list[np.ndarray]) -> list[list[Run]]:
    """Runs (start, length, period) of each text, by start and period. A text is an array of numbers for words."""
    out: list[list[Run]] = [[] for _ in texts]
    if not texts:
        return out
    size = np.array([len(t) for t in texts])
    words, base = np.concatenate(texts), np.cumsum(size) - size
    open_: dict[int, Runs] = {}
    for text, period, place in probed(words, base, size):
        for t, p, i in zip(text.tolist(), period.tolist(), place.tolist(), strict=True):
            runs = open_.get(t)
            if runs is None:
                runs = open_[t] = Runs(texts[t])
            runs.probe(p, i)
    for t, runs in open_.items():
        out[t] = sorted(runs.found, key=lambda r: (r[0], r[2]))
    return out


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words no run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def detect(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start and period, words counted from 0), collapsed (the
    words that no run holds after its first period, joined by a space) of every row."""

    def work(rows: list[tuple[object, list[bytes]]]) -> pd.DataFrame:
        found = find_runs([numbered(w) for _, w in rows])
        out = []
        for (doc, words), runs in zip(rows, found, strict=True):
            keep = kept_words(len(words), runs).tolist() if runs else None
            left = words if keep is None else [w for w, k in zip(words, keep, strict=True) if k]
            out.append((doc, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], b" ".join(left).decode()))
        return pd.DataFrame(out, columns=["doc_id", "n_words", "runs", "collapsed"]).astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, n = [], 0
            for doc, t in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                rows.append((doc, words := t.encode().split()))
                n += len(words)
                if n >= WORDS:
                    yield work(rows)
                    rows, n = [], 0
            if rows:
                yield work(rows)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (whole_text() if text is None else text).alias("text"))
    return rows.mapInPandas(tidied(run), "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def periodic_text(doc_id: Column, text: Column) -> Column:
    """The text whose tail repeats in a tenth of the documents, as the query asks: with h the CRC-32 of the decimal doc_id,
    h divisible by 10 and g = h div 10, words from a = g mod n on are those a + (i - a) mod p, p = 1 + (n - a) div
    (3 + g mod 8). A null doc_id leaves its text alone."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split(text, SPACES), lambda w: w != "")

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("long")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    tail = F.when(text.rlike("[^\\x20\\x09-\\x0D]"), F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise("")
    return F.when(h % 10 == 0, tail).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """What the query returns of detect's rows: the run of the greatest exact length by period, and digests."""

    def better(best: Column, r: Column) -> Column:
        more = r["length"] * best["period"] - best["length"] * r["period"]
        return F.when(best.isNull() | (more > 0), r).otherwise(best)  # runs come by start and period, so ties keep the first

    kind = "struct<start: bigint, length: bigint, period: bigint>"
    best = F.aggregate("runs", F.lit(None).cast(kind), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = found.withColumn("best", best)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )
