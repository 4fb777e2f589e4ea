"""Document fingerprints by randomised edit embedding.

All texts take the same random walks: at step j a text gives out its current character and goes on to the next one if a
shared random bit for (walk, j, character) says so. A walk starts at each place that the text itself marks (one in SPACING
characters, by a hash of the characters there, which also names the walk), so that texts at a small edit distance fall
into step again at the next mark at the latest, and their outputs, as vectors over (walk, step), differ in few places
(Hamming distance). A fingerprint is a sample of that vector: the BANDS coordinates of least shared priority, each a
band of RUN outputs from that step on. Likeness is the share of equal bands among the least coordinates of both texts,
j, as 2 j / (1 + j): the share of a text that is common. `near_classes` joins on groups of two
bands, verifies by likeness and gives each text its class.

Defined results: null and empty texts have the empty fingerprint (like only to itself: 1.0); equal texts have equal
fingerprints; whole texts are walked whatever their length; rows with one doc_id follow each other by descending text;
null doc_ids come last; in a table of one row the row is its own next document; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import bounded_batches, join_counted, settle, slots, tidied, whole_text
from pathloom.llm.graph import components
from pathloom.llm.hashing import MASKS, mix

BANDS, RUN, PERIOD = 128, 4, 4096
SPACING, FARTHEST, STEPS, NAME = 32, 512, 32, 8
BLOCK_CHARS = 1 << 20
WIDTH = 10  # hex digits of a band: eight of its coordinate's priority, two of its value


@functools.cache
def walk_table() -> np.ndarray:
    """Random bits by walk and step (repeating) and character class; at class 0, past the walk's end, it stays."""
    bits = np.random.default_rng(20240229).integers(0, 2, (PERIOD, 256), dtype=np.uint8)
    bits[:, 0] = 0
    return bits


def classes(points: np.ndarray) -> np.ndarray:
    return ((points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.uint64) % np.uint64(255) + np.uint64(1)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text, in blocks of about BLOCK_CHARS."""
    out: list[str] = []
    a = 0
    while a < len(texts):
        b, n = a, 0
        while b < len(texts) and (b == a or n + len(texts[b]) <= BLOCK_CHARS):
            n += len(texts[b])
            b += 1
        out += walk(texts[a:b])
        a = b
    return out


def walk(texts: list[str]) -> list[str]:
    table = walk_table().ravel()
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    starts = np.r_[0, np.cumsum(lengths + 1)[:-1]]
    flat = classes(points).astype(np.uint8)
    flat[starts + lengths] = 0
    ahead = np.concatenate([flat, np.zeros(NAME, np.uint8)])
    name = np.frombuffer(np.lib.stride_tricks.sliding_window_view(ahead, NAME)[: len(flat)].tobytes(), "<u8").copy()
    for k in range(1, NAME):  # no look beyond a text's end
        name[(starts + lengths - k)[lengths >= k]] &= MASKS[k]
    short = mix(name & np.uint64(0xFFFFFFFF))
    mark = (short % np.uint64(SPACING) == 0) & (flat != 0)
    first = starts[lengths > 0]
    mark[first] = True
    begin = np.flatnonzero(mark)
    if not len(begin):
        return [""] * len(texts)
    owner = np.searchsorted(starts, begin, "right") - 1
    end = np.minimum(np.r_[begin[1:], len(flat)], starts[owner] + lengths[owner])
    more = np.maximum(0, (end - begin - 1) // FARTHEST)  # far from the next mark a walk starts every so many characters
    extra = np.repeat(begin, more) + FARTHEST * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    if len(extra):
        begin = np.sort(np.r_[begin, extra])
        owner = np.searchsorted(starts, begin, "right") - 1
        end = np.minimum(np.r_[begin[1:], len(flat)], starts[owner] + lengths[owner])
    walks = mix(name[begin] + np.uint64(1))
    seen, at, shift = np.zeros((STEPS + RUN - 1, len(begin)), np.uint64), begin.copy(), (walks % np.uint64(PERIOD)).astype(np.int64)
    for j in range(STEPS + RUN - 1):
        c = np.where(at < end, flat[at], 0)
        seen[j] = c
        at += table[(shift + j) % PERIOD * 256 + c]
    value = seen[:STEPS].copy()
    for k in range(1, RUN):
        value = (value << np.uint64(8)) | seen[k : STEPS + k]
    value = (mix(value) >> np.uint64(56)).astype(np.uint8)
    priority = (mix(walks[None, :] + np.arange(STEPS, dtype=np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95)) >> np.uint64(32)).astype(np.uint32)
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    both = (priority.astype(np.uint64) << np.uint64(8) | value).T
    result = []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own = both[i:j].ravel()
        if len(own) > 4 * BANDS:
            own = np.partition(own, 4 * BANDS - 1)[: 4 * BANDS]
        own = np.sort(own)
        key = own >> np.uint64(8)
        own = own[np.r_[True, key[1:] != key[:-1]]][:BANDS] if len(own) else own
        result.append(own.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].tobytes().hex())
    return result


def bands_of(fingerprint: str) -> np.ndarray:
    """Priority and value of each band as one number, in order."""
    raw = np.zeros((len(fingerprint) // WIDTH, 8), np.uint8)
    raw[:, 3:] = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, WIDTH // 2)
    return raw.reshape(-1).view(">u8").astype(np.uint64)


def likeness(a: str, b: str) -> float:
    """Common share of two texts as their fingerprints say: 0 to 1; 1.0 for two empty texts."""
    if a == b:
        return 1.0
    x, y = bands_of(a), bands_of(b)
    if not len(x) or not len(y):
        return 0.0
    every = np.union1d(x >> np.uint64(8), y >> np.uint64(8))
    if max(len(x), len(y)) == BANDS:
        every = every[:BANDS]
    same = np.intersect1d(x, y, assume_unique=True)
    j = float((same >> np.uint64(8) <= every[-1]).sum() / len(every))
    return 2 * j / (1 + j)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "fingerprint": fingerprints(batch["text"].tolist())})

    return docs.select("doc_id", whole_text().alias("text")).mapInPandas(tidied(run), "doc_id long, fingerprint string")


GROUPS, BLOCK = 32, 256


def near_classes(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """class_id of every row of prints (doc_id, fingerprint): the smallest doc_id that links of texts at least so alike
    lead to. Rows of equal fingerprints are one; two fingerprints are compared if they share two bands that follow each
    other among their first GROUPS. The least of each such group is compared to the others first, then, in blocks of
    BLOCK, what is not in one class yet; so no pair that shares bands goes uncompared unless links join it already."""
    spark = prints.sparkSession
    known = settle(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.min(F.xxhash64("fingerprint")).alias("node")))
    two = 2 * WIDTH
    groups = F.expr(f"transform(sequence(0, greatest(0, least({GROUPS}, length(fingerprint) div {WIDTH}) - 2)), i -> xxhash64(substring(fingerprint, 1 + i * {WIDTH}, {two})))")
    banded = settle(known.where("fingerprint <> ''").select("node", F.explode(F.array_distinct(groups)).alias("g")))
    heads = settle(banded.groupBy("g").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    stars = join_counted(banded, heads, ["g"]).where("a < node").select("a", F.col("node").alias("b")).distinct()
    texts = known.select("node", "fingerprint")
    asked = stars.join(texts.withColumnsRenamed({"node": "a", "fingerprint": "x"}), "a").join(texts.withColumnsRenamed({"node": "b", "fingerprint": "y"}), "b")

    @F.pandas_udf("double")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([likeness(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    links = settle(asked.where(alike("x", "y") >= least).select("a", "b"))
    labels = components(links)
    members = banded.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = members.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).where("lo <> hi").select("g", "parts")
    own = members.join(mixed, "g").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")})

    def compare(rows: pd.DataFrame) -> list[tuple[int, int]]:
        found, of, across = [], dict(zip(rows["node"], rows["comp"], strict=True)), rows["p"].iat[0] != rows["q"].iat[0]
        items = list(zip(rows["node"].tolist(), rows["fingerprint"].tolist(), rows["part"].tolist(), strict=True))
        for i, (a, x, m) in enumerate(items):
            for b, y, n in items[i + 1 :]:
                if of[a] != of[b] and not (across and m == n) and likeness(x, y) >= least:
                    found.append((a, b))
                    old, new = of[b], of[a]
                    of.update({k: new for k, v in of.items() if v == old})
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if not len(rows):
                continue
            last = (rows[["g", "p", "q"]] == rows[["g", "p", "q"]].iloc[-1]).all(axis=1)
            held = rows[last]
            for _, part in rows[~last].groupby(["g", "p", "q"], sort=False):
                yield pd.DataFrame(compare(part), columns=["a", "b"], dtype="int64")
        if held is not None:
            yield pd.DataFrame(compare(held), columns=["a", "b"], dtype="int64")

    sorted_ = dealt.join(texts, "node").repartition(slots(spark), "g", "p", "q").sortWithinPartitions("g", "p", "q")
    more = settle(sorted_.select("g", "p", "q", "part", "node", "comp", "fingerprint").mapInPandas(tidied(run), "a long, b long"))
    final = components(links.unionByName(more))
    classed = known.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    ids = classed.groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    return prints.join(settle(classed.join(ids, "comp").select("fingerprint", "class_id")), "fingerprint", "left").select(*prints.columns, "class_id")


LOWEST = -(1 << 63)


def chained(docs: DataFrame, buckets: int) -> DataFrame:
    """The rows (doc_id, text, bucket, tail) so dealt that each bucket holds a stretch of falling doc_ids and, marked
    as tail, the row that follows the stretch. Heads are one doc_id a bucket."""
    keyed = docs.select("doc_id", whole_text().alias("text"), F.coalesce(F.col("doc_id"), F.lit(LOWEST)).alias("key"))
    cuts = sorted({int(x) for x in keyed.approxQuantile("key", [k / buckets for k in range(1, buckets)], 0.1 / buckets)} if buckets > 1 else (), reverse=True)
    bucket = F.lit(len(cuts)) if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c >= F.col("key")))
    keyed = keyed.withColumn("bucket", bucket.cast("int"))
    heads = sorted((r["bucket"], r["head"]) for r in keyed.groupBy("bucket").agg(F.max("key").alias("head")).collect())
    tails = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]
    small = F.broadcast(docs.sparkSession.createDataFrame(tails or [(0, 0)], "key long, target int").limit(len(tails)))
    tail = keyed.join(small, "key").select("doc_id", "text", "key", F.col("target").alias("bucket"), F.lit(True).alias("tail"))
    return keyed.select("doc_id", "text", "key", "bucket", F.lit(False).alias("tail")).unionByName(tail)


def edited(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row's text and of its edited text, with their likeness and the next document's."""
    bounded_batches(docs.sparkSession)
    dealt = chained(docs, slots(docs.sparkSession))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            part = batch if held is None else pd.concat([held, batch], ignore_index=True)
            texts, tails, n = part["text"].tolist(), part["tail"].tolist(), len(part)
            new = [edited(texts[i], texts[i + 1]) for i in range(n - 1)]
            prints = fingerprints(texts + new)
            rows = [
                (part["doc_id"].iat[i], len(texts[i]), hashlib.sha256(new[i].encode("utf-8", "surrogatepass")).hexdigest(), prints[i], prints[n + i], likeness(prints[i], prints[n + i]), likeness(prints[i], prints[i + 1]))
                for i in range(n - 1)
                if not tails[i]
            ]
            held = part.tail(1)
            yield pd.DataFrame(rows, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]).astype({"doc_id": "Int64"})

    sorted_ = dealt.repartition(slots(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), F.desc("text"))
    return sorted_.select("doc_id", "text", "tail").mapInPandas(tidied(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
