"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A text is cut into units that no merge can cross (pieces hold the word mark only at their start), each distinct
unit is encoded once per worker, and all new units of an Arrow batch are encoded together: their symbols lie in one
flat numpy array; every round takes the minimum pair rank of each unit (a segmented minimum), merges the leftmost
pairs of that rank in all units at once and compacts the array, until no unit has a pair left.

Defined results: null and empty texts give no ids and an empty decoded text; characters outside the vocabulary give
byte pieces; equal rows give equal rows; the whole text is encoded whatever its length; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from pathloom.llm.common import FORGET, bounded_batches, tidied, whole_text

MARK = "▁"
NONE = np.int64(1 << 40)
UNITS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
CACHE_UNITS = 600_000


class PieceModel:
    """Vocabulary, pair table and merge rounds of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {pieces[i]: i for i in plain}
        for c in sorted({c for i in plain for c in pieces[i]} - self.ids.keys()):
            self.ids[c] = size + len(self.ids)  # a character that only longer pieces hold
        self.foreign = 2 * size + len(self.ids)  # any other character: it never merges
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.text = {i: pieces[i] for i in plain}
        self.byte_of = {i: b for b, i in enumerate(self.byte)}
        self.base = np.int64(self.foreign + 1)
        score = {i: sp.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        keys, merged = [], []
        for i in plain:
            p = pieces[i]
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    keys.append(a * int(self.base) + b)
                    merged.append(i)
        by = np.argsort(np.array(keys, np.int64))
        self.keys, self.merged = np.array(keys, np.int64)[by], np.array(merged, np.int64)[by]
        self.ranks = np.array([order[score[i]] for i in self.merged.tolist()], np.int64)
        self.cache: dict[str, tuple[str, str]] = {}

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NONE where the vocabulary has no such piece."""
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], 0)

    def merge(self, units: list[str]) -> list[list[int]]:
        """Final symbols of each unit; characters outside the vocabulary stay as their negative code point."""
        text = "".join(units)
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        known = {c: self.ids.get(c, self.foreign) for c in set(text)}
        points = np.array(sorted(map(ord, known)), np.uint32)
        sym = np.array([known[chr(p)] for p in points], np.int64)[np.searchsorted(points, chars)]
        unit = np.repeat(np.arange(len(units)), [len(u) for u in units])
        raw = np.where(sym >= self.foreign, -1 - chars.astype(np.int64), 0)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, to = self.all_pairs(sym, unit)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            if (least == NONE).any():  # compaction: finished units leave the arrays
                keep = np.repeat(least != NONE, sizes)
                out = ~keep
                done.append((unit[out], np.where(raw[out] < 0, raw[out], sym[out])))
                sym, unit, raw, rank, to = sym[keep], unit[keep], raw[keep], rank[keep], to[keep]
                sizes, least = sizes[least != NONE], least[least != NONE]
                if not len(sym):
                    break
            least = np.repeat(least, sizes)
            at = np.flatnonzero(rank == least)
            # leftmost non-overlapping occurrences: every second one within a run of adjacent occurrences
            index = np.arange(len(at))
            fresh = np.r_[True, (at[1:] != at[:-1] + 1) | (unit[at[1:]] != unit[at[:-1]])]
            at = at[(index - np.maximum.accumulate(np.where(fresh, index, 0))) % 2 == 0]
            m, u, r = to[at], unit[at], rank[at]
            # one merge may create a pair that ranks no worse: then the unit's later merges wait for the next round
            before = np.maximum(at - 1, 0)
            left = sym[before]
            if len(at) > 1:
                touches = np.r_[False, (at[:-1] + 2 == at[1:])]
                left = np.where(touches, np.r_[0, m[:-1]], left)
            has_left = (at > 0) & (unit[before] == u)
            after = np.minimum(at + 2, len(sym) - 1)
            has_right = (at + 2 < len(sym)) & (unit[after] == u)
            new = np.minimum(np.where(has_left, self.pair(left, m)[0], NONE), np.where(has_right, self.pair(m, sym[after])[0], NONE))
            stop = (new <= r).astype(np.int64)
            held = np.cumsum(stop) - stop
            first = np.r_[True, u[1:] != u[:-1]]
            held -= np.maximum.accumulate(np.where(first, held, 0))
            at, m = at[held == 0], m[held == 0]
            sym[at] = m
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, unit, raw, rank, to = sym[keep], unit[keep], raw[keep], rank[keep], to[keep]
            changed = np.r_[moved[at], np.maximum(moved[at] - 1, 0)]
            rank[changed], to[changed] = self.pairs_at(sym, unit, changed)
        result: list[list[int]] = [[] for _ in units]
        for us, ss in done:
            cuts = np.flatnonzero(np.r_[True, us[1:] != us[:-1]]).tolist() + [len(us)]
            ids = ss.tolist()
            for k, a in enumerate(cuts[:-1]):
                result[us[a]] = ids[a : cuts[k + 1]]
        return result

    def pairs_at(self, sym: np.ndarray, unit: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.minimum(at + 1, len(sym) - 1)
        rank, to = self.pair(sym[at], sym[after])
        return np.where((at + 1 < len(sym)) & (unit[after] == unit[at]), rank, NONE), to

    def all_pairs(self, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.pairs_at(sym, unit, np.arange(len(sym)))

    def ids_of(self, symbols: list[int]) -> list[int]:
        if self.text.keys() >= set(symbols):
            return symbols
        out: list[int] = []
        for s in symbols:
            if s in self.text:
                out.append(s)
            else:  # byte fallback
                char = chr(-1 - s) if s < 0 else next(c for c, i in self.ids.items() if i == s)
                out.extend(self.byte[b] for b in char.encode("utf-8", "replace"))
        return out

    def text_of(self, ids: list[int]) -> str:
        """Decoded text of ids, the word mark kept."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.text[i] for i in ids])
        parts, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                parts.append(run.decode("utf-8", "replace"))
                run = bytearray()
            parts.append(self.text[i])
        return "".join(parts) + run.decode("utf-8", "replace")

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the units of these texts that the cache lacks."""
        if len(self.cache) > CACHE_UNITS:
            self.cache.clear()
        new = [u for u in set().union(*texts) if u not in self.cache]
        for u, symbols in zip(new, self.merge(new), strict=True) if new else ():
            ids = self.ids_of(symbols)
            text = self.text_of(ids)
            self.cache[u] = ",".join(map(str, ids)), u if text == u else text


def units_of(text: str) -> list[str]:
    return UNITS.findall(MARK + text.replace(" ", MARK)) if text else []


@functools.cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


FORGET[__name__] = model.cache_clear


def blocks(texts: pd.Series, chars: int = 1 << 22) -> Iterator[list[str]]:
    """The texts in runs of about so many characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t)
        if n >= chars:
            yield run
            run, n = [], 0
    if run:
        yield run


def encode(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, ids (array<int>, if with_ids), decoded (if with_ids), n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model(model_path)
        for batch in batches:
            rows = []
            for texts in blocks(batch["text"]):
                units = [units_of(t) for t in texts]
                m.learn(units)
                for us in units:
                    found = [m.cache[u] for u in us]
                    ids = ",".join([x[0] for x in found])
                    decoded = "".join([x[1] for x in found]).replace(MARK, " ")[1:]
                    row = (ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append(row + (([int(i) for i in ids.split(",") if i], decoded) if with_ids else ()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 5 if with_ids else 3])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")
    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(tidied(run), schema)
