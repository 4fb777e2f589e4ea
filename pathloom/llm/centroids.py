"""Centroid clustering of integer vectors, nearest centroids found by annulus search.

Centroids are sorted by norm. A vector's exact distance to the centroids next to it by norm bounds the distance to its
nearest one; by the triangle inequality that one's norm differs from the vector's by no more than the bound, so a binary
search gives the candidates, which are compared exactly, those at the border included. Nothing is kept for a vector
between rounds: each round is one scan in which a task adds up its own vectors by centroid, and only sums per centroid
are shuffled and sent to the driver (k times the dimensions, whatever the table holds).

Defined results: rows whose vector is null, has another number of components or a null or non-finite one are dropped;
components beyond 2^27 in size count as that, since distances would not fit a long; a null vec_id is hashed as an empty
number, rows of equal vec_id are vectors of their own (as first centroids by their components); with fewer vectors than
centroids each vector is one; other columns are dropped whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pathloom.llm.common import bounded_batches, settle, tidied

SCALE, LARGEST = 256, 1 << 27
#: Up to this size of components all products and their sums are exact in float64.
EXACT = 1 << 21
#: Vectors compared at once.
BLOCK = 4096
MOST_LONG = (1 << 63) - 1


def kept(vectors: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding of the rows that have a whole vector."""
    whole = (F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & whole)


def integers(vectors: pa.Array, dims: int) -> np.ndarray:
    """Rows of floor(SCALE * component)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims)
    return np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)


class Centroids:
    """Centroids sorted by norm."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.square = rows, (rows * rows).sum(1)
        self.order = np.argsort(self.square, kind="stable")
        self.norm = np.sqrt(self.square[self.order].astype(np.float64))
        self.small = int(np.abs(rows).max(initial=0)) <= EXACT

    def distances(self, x: np.ndarray, square: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Exact squared distances of rows of x to the centroids numbered to."""
        c = self.rows[to]
        if self.small and int(np.abs(x).max(initial=0)) <= EXACT:
            dot = (x.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        else:
            dot = x @ c.T
        return square[:, None] + self.square[to] - 2 * dot

    def bound(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Distance of each row to one of the two centroids next to it by norm."""
        at = np.searchsorted(self.norm, norm)
        least = np.full(len(x), np.inf)
        for k in (np.maximum(at - 1, 0), np.minimum(at, len(self.norm) - 1)):
            apart = x - self.rows[self.order[k]]
            least = np.minimum(least, (apart * apart).sum(1).astype(np.float64))
        return np.sqrt(least)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller one) and squared distance for each row."""
        number, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), BLOCK):
            own = x[a : a + BLOCK]
            square = (own * own).sum(1)
            norm = np.sqrt(square.astype(np.float64))
            wide = self.bound(own, norm) * (1 + 1e-9) + norm * 1e-9 + 1e-6  # rounding of roots never drops a border
            lo, hi = np.searchsorted(self.norm, norm - wide, "left"), np.searchsorted(self.norm, norm + wide, "right")
            by = np.lexsort((hi, lo))
            cuts = np.flatnonzero(np.r_[True, (np.diff(lo[by]) != 0) | (np.diff(hi[by]) != 0), True])
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):  # vectors with the same candidates together
                rows = by[i:j]
                to = np.sort(self.order[lo[rows[0]] : hi[rows[0]]])
                d = self.distances(own[rows], square[rows], to)
                best = d.argmin(1)  # the first of the least
                number[a + rows], least[a + rows] = to[best], d[np.arange(len(rows)), best]
        return number, least


def first_centroids(vectors: DataFrame, k: int, dims: int, by: Column) -> np.ndarray:
    """The k rows that come first by a hash: k rows at the driver."""
    head = vectors.select(by.alias("by"), "embedding").orderBy("by", "embedding").limit(k).collect()
    return integers(pa.array([r.embedding for r in head], pa.list_(pa.float64())), dims) if head else np.zeros((0, dims), np.int64)


def summed(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, dim, n, total: how many vectors each centroid is nearest to and the sum of each of their components.
    Each task adds up its own rows first."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n, total = Centroids(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x = integers(batch.column("embedding"), dims)
            number, _ = own.nearest(x)
            by = np.argsort(number, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(number[by]) != 0]) if len(by) else by
            if len(at):
                total[number[by[at]]] += np.add.reduceat(x[by], at)
            n += np.bincount(number, minlength=k)
        some = np.flatnonzero(n)
        cluster, dim = np.repeat(some, dims), np.tile(np.arange(dims), len(some))
        yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(np.repeat(n[some], dims)), pa.array(total[some].reshape(-1))], ["cluster", "dim", "n", "total"])

    parts = vectors.select("embedding").mapInArrow(tidied(run), "cluster int, dim int, n long, total long")
    return parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def moved(centroids: np.ndarray, sums: DataFrame) -> np.ndarray:
    """Centroids at floor(sum / count) of their vectors; those without any stay."""
    out = centroids.copy()
    for r in sums.collect():  # k times dims rows
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def fitted(vectors: DataFrame, start: np.ndarray, rounds: int) -> np.ndarray:
    for _ in range(rounds):
        start = moved(start, summed(vectors, start))
    return start


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of every row."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Centroids(centroids)
        for batch in batches:
            number, least = own.nearest(integers(batch.column("embedding"), dims))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(tidied(run), "vec_id long, cluster int, distance long")


def name_of(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every kept vector after rounds
    of moving the centroids, which start as the k vectors with the smallest SHA-256 of `seed:vec_id`."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = kept(vectors, dims)
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    start = first_centroids(rows, k, dims, by)
    if not len(start):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    return with_inertia(spark, rows, fitted(rows, start, rounds))


def with_inertia(spark: SparkSession, rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    ended = settle(assigned(rows, centroids))
    long: Callable[[Column], Column] = lambda c: F.least(c, F.lit(MOST_LONG).cast("decimal(38,0)")).cast("long")
    each = ended.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    each = each.select("cluster", long(F.col("total")).alias("cluster_inertia"), long(F.sum("total").over(Window.partitionBy())).alias("inertia"))  # a row per cluster
    names = spark.createDataFrame([(i, name_of(c)) for i, c in enumerate(centroids)], "cluster int, centroid_sha256 string")
    return ended.join(F.broadcast(each.join(F.broadcast(names), "cluster")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 40, rounds: int = 5, dims: int = 64, seed: int = 2) -> str:
    """The same in DuckDB's SQL, every distance computed."""
    nearest = "select rid, d as distance, c as cluster from (select rid, c, d, row_number() over (partition by rid order by d, c) as place from (select v.rid, m.c, sum((v.x - m.x) * (v.x - m.x)) as d from v join m{r} m on v.i = m.i group by v.rid, m.c)) where place = 1"
    parts = [
        f"kept as materialized (select row_number() over (order by sha256('{seed}:' || coalesce(vec_id::varchar, '')), embedding) as rid, vec_id, embedding from embeddings where len(embedding) = {dims} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dims})",
        f"v as materialized (select rid, i, floor({SCALE} * embedding[i]::double)::bigint as x from kept, range(1, {dims + 1}) as t(i))",
        f"m0 as materialized (select rid - 1 as c, i, x from v where rid <= {k})",
    ]
    for r in range(rounds):
        parts.append(f"a{r} as materialized ({nearest.format(r=r)})")
        parts.append(f"s{r} as materialized (select a.cluster as c, v.i, sum(v.x)::bigint as total, count(*) as n from v join a{r} a on a.rid = v.rid group by 1, 2)")
        parts.append(f"m{r + 1} as materialized (select m.c, m.i, coalesce((s.total - ((s.total % s.n) + s.n) % s.n) // s.n, m.x) as x from m{r} m left join s{r} s on s.c = m.c and s.i = m.i)")
    parts.append(f"ended as materialized ({nearest.format(r=rounds)})")
    parts.append(f"names as (select c, sha256(string_agg(x::varchar, ',' order by i)) as name from m{rounds} group by c)")
    return (
        "with " + ",\n".join(parts) + "\nselect k.vec_id, e.cluster::int as cluster, e.distance::bigint as distance, (sum(e.distance) over (partition by e.cluster))::bigint as cluster_inertia, "
        "(sum(e.distance) over ())::bigint as inertia, n.name as centroid_sha256 from ended e join kept k on k.rid = e.rid join names n on n.c = e.cluster"
    )
