"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer numpy network.

Every word type and every word shape has a sparse random index vector. A word's vector is the sum of the index vectors
of its neighbours (types and shapes) over the fitting sample; a document is the mean of its words' vectors and of its
shapes' vectors, with two length features. The network's probabilities are calibrated by a temperature fitted on a
fifth of the sample that its weights never saw.

Fitting reads a bounded sample of labelled rows (`max_rows`, by least hash of doc_id) whose crc32(doc_id) mod 5 is not
0, in one task; scoring is a single pass over all rows without a shuffle. Labels, lang, source and doc_id never enter
a score.

Defined results: null and empty texts are scored from zero vectors; unlabelled tables give 0.5, a single class its
smoothed share; repeated rows get equal scores; whole texts are read; extra columns pass through `score`.
"""

from __future__ import annotations

import functools
import math
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import FORGET, bounded_batches, tidied, whole_text

WORD = re.compile("[^\t-\r ]+")
DIM, NONZERO, WINDOW, HIDDEN = 32, 4, 2, 24
MAX_ROWS = 4000
CACHE_WORDS, PART = 150_000, 512
RUNS = [(re.compile(p), by) for p, by in (("[^\\W\\d_]+", lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa"), (r"\d+", "9"), (r"([^\w\s])\1+", r"\1\1"))]


def shape(word: str) -> str:
    for pattern, by in RUNS:
        word = pattern.sub(by, word)
    return word[:12]


def index_vector(token: str) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(token.encode("utf-8", "surrogatepass")))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return v


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


class Vectors:
    """Word and shape vectors; rows of `words` and `shapes` by name, row 0 for those unknown."""

    def __init__(self, texts: list[str]):
        number: defaultdict[str, int] = defaultdict(lambda: len(number))
        docs = [np.array([number[x] for x in WORD.findall(t)], np.int32) for t in texts]  # words as numbers: 4 bytes each
        counts = np.zeros(len(number), np.int64)
        for d in docs:
            np.add.at(counts, d, 1)
        names = [w for w, n in zip(number, counts.tolist(), strict=True) if n >= 3]
        kinds = [shape(w) for w in number]
        self.word = {w: i + 1 for i, w in enumerate(names)}
        self.shape = {s: i + 1 for i, s in enumerate(sorted(set(kinds)))}
        word_of, shape_of = np.array([self.word.get(w, 0) for w in number], np.int64), np.array([self.shape[s] for s in kinds], np.int64)
        del number, kinds
        of_word = np.vstack([np.zeros(DIM, np.float32), *map(index_vector, names)])
        of_shape = np.vstack([np.zeros(DIM, np.float32), *(index_vector("\0" + s) for s in self.shape)])
        self.words, self.shapes = np.zeros_like(of_word), np.zeros_like(of_shape)
        for d in docs:
            if not len(d):
                continue
            w, s = word_of[d], shape_of[d]
            own = of_word[w] + of_shape[s]
            sums = np.vstack([np.zeros(DIM, np.float32), np.cumsum(own, axis=0, dtype=np.float64).astype(np.float32)])
            i = np.arange(len(d))
            around = sums[np.minimum(i + WINDOW + 1, len(d))] - sums[np.maximum(i - WINDOW, 0)] - own
            np.add.at(self.words, w, around)
            np.add.at(self.shapes, s, around + of_shape[s])
        for m in (self.words, self.shapes):
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-6)
        self.words[0] = 0
        self.cache: dict[str, tuple[int, int]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def pooled_parts(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Of few texts at a time, so that the words of few are held."""
        for a in range(0, len(texts), PART):
            yield self.pooled(texts[a : a + PART])

    def pooled(self, texts: list[str]) -> np.ndarray:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        docs, cache = [WORD.findall(t) for t in texts], self.cache
        for x in (w for w in set().union(*docs) if w not in cache):
            cache[x] = self.word.get(x, 0), self.shape.get(shape(x), 0)
        out = np.zeros((len(texts), 2 * DIM + 2), np.float32)
        for k, d in enumerate(docs):
            if d:
                rows = np.array([cache[x] for x in d])
                out[k, :DIM] = self.words[rows[:, 0]].mean(axis=0)
                out[k, DIM : 2 * DIM] = (np.bincount(rows[:, 1], minlength=len(self.shapes)) / len(d)) @ self.shapes
            out[k, 2 * DIM :] = math.log1p(len(d)), math.log1p(len(texts[k])) - math.log1p(len(d))
        return out


class Network:
    """Standardised input, tanh layer, logistic output, temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 400):
        rng = np.random.default_rng(7)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        x, fit = self.standard(x), np.arange(len(y)) % 5 != 4
        p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        xf, yf = x[fit], y[fit]
        for t in range(1, epochs + 1):  # full-batch Adam
            h = np.tanh(xf @ p[0] + p[1])
            e = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - yf) / len(yf)
            back = np.outer(e, p[2]) * (1 - h * h)
            for k, g in enumerate((xf.T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ e + 1e-4 * p[2], e.sum(keepdims=True))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0
        z, held = self.logits(x), ~fit if (~fit).any() else fit
        loss = lambda t: np.logaddexp(0, np.where(y[held] == 1, -z[held], z[held]) / t).mean()
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.standard(x)) / self.temperature, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> bytes:
    """The pickled model: (vectors, network) or (None, probability)."""
    known = labels.where(~held_out()).select("doc_id", F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    sample = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id")

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:3])
        y, texts = np.array([r[3] for r in data], float), [r[2] for r in data]
        if len(set(y)) < 2:
            model = None, (y.sum() + 1) / (len(y) + 2)
        else:
            vectors = Vectors(texts)
            model = vectors, Network(np.concatenate(list(vectors.pooled_parts(texts))).astype(float), y)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    bounded_batches(docs.sparkSession)
    found = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "text", "y").repartition(1).mapInArrow(tidied(train), "model binary").collect()
    return bytes(found[0][0]) if found else pickle.dumps((None, 0.5))


@functools.lru_cache(2)
def loaded(model: bytes):
    return pickle.loads(model)


FORGET[__name__] = loaded.cache_clear


def score(docs: DataFrame, model: bytes, name: str = "score", columns: list[str] | None = None, least: float | None = None) -> DataFrame:
    """`columns` of docs (all, if None) with the score as one more column, which replaces one of that name; only rows
    of at least `least`, if given."""
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() != name.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = loaded(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if vectors is None:
                p = np.full(len(texts), network)
            else:
                p = np.concatenate([network.probability(x) for x in vectors.pooled_parts(texts)] or [np.zeros(0)])
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(p, pa.float64())], names=[*kept, name])
            yield out if least is None else out.filter(pa.array(p >= least))

    bounded_batches(docs.sparkSession)
    types = dict(docs.dtypes)
    source = docs.select(*dict.fromkeys([*kept, "text"]))
    return source.mapInArrow(tidied(run), ", ".join(f"`{c}` {types[c]}" for c in kept) + f", `{name}` double")
