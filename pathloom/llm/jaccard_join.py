"""Exact near-duplicate classes by a join in the metric space of Jaccard distance between shingle sets.

1. Rows with equal sets are one class, held by the first of them in the table.
2. Single shingles are pivots: a set's distance to a pivot it holds is less than 1, to any other it is 1, and pivots
   are ordered, so that a set's first pivot is its region. By the triangle inequality a set within EPSILON of it has
   one of the set's first `window` pivots in common with it, so each set is copied to the regions of that window.
   Pivots that more than HOT_ROWS sets share come last in the order: any order gives the same links.
3. Each region's smallest class is compared to the region's other members (over the first PROBES pivots of each
   window); the links found give components. After that only pairs across components matter: two sets of one
   component need no comparison, so a dense group of n costs about n comparisons.
4. Regions of up to SMALL members give their pairs across components; pairs that meet in `least_common` of them are
   compared. (A linked pair that doesn't has a pivot of a larger region in common.)
5. Members of larger regions get windows anew, with the pivots that the fewest of these members have first, and step 4
   is done on those. What is large then is split recursively: two members are pivots, each member goes to the Voronoi
   cell of the nearer one and, if its two distances differ by at most 2 EPSILON, to the other cell too, until cells are
   small, within one component, or stop shrinking; then their pairs that sizes and the triangle inequality leave open
   are compared, each once.

Comparisons are exact. Links and components stay distributed; what is broadcast is bounded (HOT_PIVOTS, NEAR_NODES).

Defined results: a null or empty text, or one without words, has an empty set and links with nothing; with fewer than
five words the whole sequence is the one shingle; repeated rows are one class; rows of one doc_id with unlike texts are
joined each on its own, as are rows without one, which don't count for the smallest doc_id (a component of such rows
alone has none); whole texts are read; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import KEY, NO_ID, bounded_batches, join_counted, keyed, release, settle, slots, tidied
from pathloom.llm.graph import components
from pathloom.llm.hashing import among
from pathloom.llm.shingles import shingle_sets

EPSILON, LINK, OF = 0.2, 80, 100
HOT_ROWS, HOT_PIVOTS, NEAR_NODES, NEAR_COPIES = 64, 1_000_000, 200_000, 500_000
PROBES, SHARED_PROBES = 8, 2
SMALL, BLOCK, DEPTH, ROUNDS = 64, 256, 8, 2
CELL, SENT_BYTES = 4096, 1 << 21


def least_common(n):
    """How many pivots two linked sets, of at least n shingles each, have in common within their windows."""
    return (n + 19) // 20


def windows(docs: DataFrame, hot: Broadcast | None = None) -> DataFrame:
    """The rows' keys with n, key (of the set) and the pivots of its window: those not hot, then hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hot.value if hot is not None else np.zeros(0, np.uint64)
        for batch in batches:
            n, key, cold_, hot_ = [], [], [], []
            for s in shingle_sets(batch.column(4)):
                w = len(s) - (-(-LINK * len(s) // OF)) + least_common(len(s))
                busy = np.zeros(len(s), bool)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    busy = known[at] == s
                cold = s[~busy][:w]
                n.append(len(s))
                key.append(hashlib.md5(s.tobytes()).digest())
                cold_.append(cold.view(np.int64))
                hot_.append(s[busy][: w - len(cold)].view(np.int64))
            lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum([len(x) for x in xs])].astype(np.int32), np.concatenate([*xs, np.zeros(0, np.int64)])) for xs in (cold_, hot_)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(n, pa.int64()), pa.array(key, pa.binary()), *lists], names=["row", *KEY, "n", "key", "cold", "hot"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), *KEY, F.col("text").cast("string"))
    return rows.mapInArrow(tidied(run), "row long, __id long, __digest binary, __copy long, n long, key binary, cold array<long>, hot array<long>")


class Sets:
    """Where the sets of nodes come from. docs: keyed; names: node and the row's KEY."""

    def __init__(self, docs: DataFrame, names: DataFrame):
        self.docs, self.names = docs, names

    def of(self, nodes: DataFrame) -> DataFrame:
        """node and its set as bytes. nodes: node long, distinct."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, len(batch), 512):
                    part = batch.slice(a, 512)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1))], pa.binary())], names=["node", "set"])

        asked = self.names.join(nodes, "node")
        if nodes.count() <= NEAR_NODES:
            asked = F.broadcast(asked)
        return self.docs.join(asked, KEY).select("node", F.col("text").cast("string")).mapInArrow(tidied(run), "node long, set binary")

    def sent(self, to: DataFrame, few: bool) -> DataFrame:
        """a, block, b and the set of the node, of every row of to (node, a, block, b: long; few: it can be broadcast)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, len(batch), 512):
                    part = batch.slice(i, 512)
                    sets = [s.tobytes() for s in shingle_sets(part.column(1))]
                    own = np.repeat(np.arange(len(part)), part.column(0).value_lengths().to_numpy(zero_copy_only=False))
                    to = part.column(0).flatten().flatten()
                    piece = np.cumsum(np.array([len(x) for x in sets], np.int64)[own]) // SENT_BYTES
                    cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(own)]
                    for j, k in zip(cuts, cuts[1:], strict=False):
                        yield pa.RecordBatch.from_arrays([*(x.slice(j, k - j) for x in to), pa.array([sets[x] for x in own[j:k].tolist()], pa.binary())], names=["a", "block", "b", "set"])

        asked = self.names.join(to.groupBy("node").agg(F.collect_list(F.struct("a", "block", "b")).alias("to")), "node")
        rows = self.docs.join(F.broadcast(asked) if few else asked, KEY).select("to", F.col("text").cast("string"))
        return rows.mapInArrow(tidied(run), "a long, block long, b long, set binary")


def compare(source: Sets, pairs: DataFrame) -> DataFrame:
    """a, b, common, n_a, n_b of distinct pairs. A set goes to each block of up to about BLOCK of its partners, from
    where it is made."""
    pairs = settle(pairs)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = settle(pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), "blocks").alias("block")))
    heads = dealt.select(F.col("a").alias("node"), "a", "block").distinct().withColumn("b", F.lit(None).cast("long"))
    to = heads.unionByName(dealt.select(F.col("b").alias("node"), "a", "block", "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for a, b, data in zip(batch["a"], batch["b"], batch["set"], strict=True):
                s = np.frombuffer(data, np.uint64)
                if pd.isna(b):
                    own = s
                    continue
                x, y = (own, s) if len(own) < len(s) else (s, own)
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                out.append((a, int(b), common, len(own), len(s)))
            yield pd.DataFrame(out, columns=["a", "b", "common", "n_a", "n_b"])

    rows = source.sent(to, pairs.count() <= NEAR_NODES).repartition(slots(pairs.sparkSession), "a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    out = settle(rows.select("a", "b", "set").mapInPandas(tidied(run), "a long, b long, common long, n_a long, n_b long"))
    release(pairs, dealt)
    return out


UNION = "(n_a + n_b - common)"


def linked(compared: DataFrame) -> DataFrame:
    return compared.where(f"{OF} * common >= {LINK} * {UNION}").select("a", "b")


def windows_anew(source: Sets, nodes: DataFrame) -> DataFrame:
    """s, node, comp, n, own of the pivots of each node's window, those first that the fewest of these nodes (node,
    comp, n) have. own: how many of a node's shingles no other of them has. They are lost to every pair, so nodes with
    too many of them go; the others' are no pivots that anything has in common."""

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            node = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(v) for v in values])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.concatenate([*values, np.zeros(0, np.int64)]))], names=["node", "s"])

    held = settle(source.of(nodes.select("node")).mapInArrow(tidied(numbers), "node long, s long"))
    counts = settle(held.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    shared = join_counted(held, counts, ["s"], "c").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("shared"))
    left = nodes.join(shared, "node").withColumn("own", F.expr("n - size(shared)")).where(f"{OF} * (n - own) >= {LINK} * n")
    size = f"n - ({LINK} * n + {OF - 1}) div {OF} + (n + 19) div 20 - own"
    out = settle(left.select(F.explode(F.expr(f"slice(shared, 1, cast({size} as int)).s")).alias("s"), "node", "comp", "n", "own"))
    release(held, counts)
    return out


def single_regions(regions: DataFrame) -> DataFrame:
    """The regions that more than one component is in; of those of the same members one."""
    left = settle(mixed_only(regions).drop("size"))
    same = left.groupBy("region").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64(F.lit("b"), "node").cast("decimal(38,0)")).alias("y"), F.count(F.lit(1)).alias("c"))
    return left.join(same.groupBy("x", "y", "c").agg(F.min("region").alias("region")).select("region"), "region", "left_semi")


def cold_pairs(members: DataFrame) -> DataFrame:
    """Pairs a, b across components in regions by pivot, n: in how many regions they must meet. Regions over SMALL come
    out whole, as (region, a: node, b: -1, comp, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(s: np.ndarray, node: np.ndarray, comp: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(s)])
            mixed = np.zeros(len(starts), bool)
            if len(s):
                mixed = (np.minimum.reduceat(comp, starts) != np.maximum.reduceat(comp, starts)) & (sizes > 1)
            a, b, c, m, region = [], [], [], [], []
            for i, k in zip(starts[mixed].tolist(), sizes[mixed].tolist(), strict=True):
                own = slice(i, i + k)
                if k > SMALL:
                    a.append(node[own]), b.append(np.full(k, -1)), c.append(comp[own]), m.append(n[own]), region.append(s[own])
                    continue
                x, y = np.triu_indices(k, 1)
                nx, ny, cx, cy = n[own][x], n[own][y], comp[own][x], comp[own][y]
                good = (cx != cy) & (OF * np.minimum(nx, ny) >= LINK * np.maximum(nx, ny))
                p, q = node[own][x[good]], node[own][y[good]]
                a.append(np.minimum(p, q)), b.append(np.maximum(p, q)), c.append(np.zeros(len(p), np.int64)), m.append(least_common(np.minimum(nx, ny)[good])), region.append(np.full(len(p), np.int64(0)))
            cols = [np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for v in (region, a, b, c, m)]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=["region", "a", "b", "comp", "n"])

        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            now = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False)]) for i, h in enumerate(held)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            held = [v[cut:] for v in now]
            yield emit(*(v[:cut] for v in now))
        yield emit(*held)

    rows = members.repartition(slots(members.sparkSession), "s").sortWithinPartitions("s")
    return rows.select("s", "node", "comp", "n").mapInArrow(tidied(run), "region long, a long, b long, comp long, n long")


def meetings(cold: DataFrame) -> DataFrame:
    """a, b of pairs that meet in enough regions."""
    return cold.where("b >= 0").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("need")).where("c >= need").select("a", "b")


def large_regions(cold: DataFrame) -> DataFrame:
    """The members of regions over SMALL: region string, node, comp, n."""
    return cold.where("b < 0").select(F.col("region").cast("string"), F.col("a").alias("node"), "comp", "n")


def mixed_only(regions: DataFrame) -> DataFrame:
    """The members of regions that more than one component is in."""
    ends = regions.groupBy("region").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    return regions.join(ends.select("region", "size"), "region")


def cell_pairs(cells: DataFrame) -> DataFrame:
    """a, b: pairs across components within a cell that sizes and the distances to the cell's pivots leave open. A pair
    that meets in many cells comes from the first of them alone. Cells over CELL members are dealt in blocks of them,
    each two blocks to a task."""
    spark = cells.sparkSession
    numbered = settle(cells.withColumn("region", F.xxhash64("region")))
    sizes = numbered.groupBy("region").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    homes = numbered.groupBy("node").agg(F.array_sort(F.collect_set("region")).alias("homes"))
    own = numbered.join(sizes, "region").join(homes, "node").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumns({"lo": F.least("part", "other"), "hi": F.greatest("part", "other")})

    def pairs(g: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        g = g.sort_values("node")
        node, comp, n, own_, d1, d2, part = (g[c].to_numpy() for c in ("node", "comp", "n", "own", "d1", "d2", "part"))
        region, across = g["region"].iat[0], g["lo"].iat[0] != g["hi"].iat[0]
        earlier = [h[: np.searchsorted(h, region)] for h in g["homes"]]
        names = np.unique(np.concatenate(earlier))
        bits = np.zeros((len(g), len(names) // 64 + 1), np.uint64)
        for i, h in enumerate(earlier):
            at = np.searchsorted(names, h)
            np.bitwise_or.at(bits[i], at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        for i in range(len(g) - 1):
            j = np.arange(i + 1, len(g))
            most = np.minimum(n[i] - own_[i], n[j] - own_[j])
            j = j[(comp[j] != comp[i]) & (OF * most >= LINK * (n[i] + n[j] - most)) & (abs(d1[j] - d1[i]) <= EPSILON + 1e-9) & (abs(d2[j] - d2[i]) <= EPSILON + 1e-9) & ((part[j] != part[i]) | (not across))]
            j = j[~(bits[j] & bits[i]).any(axis=1)]
            yield np.full(len(j), node[i]), node[j]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            keys = list(zip(rows["region"], rows["lo"], rows["hi"], strict=True))
            held = rows[[k == keys[-1] for k in keys]] if keys else rows
            for _, g in rows[[k != keys[-1] for k in keys]].groupby(["region", "lo", "hi"], sort=False) if keys else ():
                yield give(g)
        if held is not None and len(held):
            yield give(held)

    def give(g: pd.DataFrame) -> pd.DataFrame:
        found = list(zip(*pairs(g), strict=True)) or [(), ()]
        return pd.DataFrame({c: np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for c, v in zip("ab", found, strict=True)})

    rows = dealt.repartition(slots(spark), "region", "lo", "hi").sortWithinPartitions("region", "lo", "hi")
    return rows.select("region", "lo", "hi", "part", "node", "comp", "n", "own", "d1", "d2", "homes").mapInPandas(tidied(run), "a long, b long")


def mixed_hot(nodes: DataFrame) -> DataFrame:
    """node, comp, n of those nodes that hold a hot pivot (hot: of each node) which more than one component has. Each
    task first brings the pivots it sees down to a row each; the few that are left are told to all tasks."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot, comp = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            s, c = hot.flatten().to_numpy(zero_copy_only=False), np.repeat(comp, hot.value_lengths().to_numpy(zero_copy_only=False))
            order = np.argsort(s)
            s, c = s[order], c[order]
            starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
            lo, hi = (f.reduceat(c, starts) if len(s) else s for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s[starts], lo, hi)], names=["s", "lo", "hi"])

    seen = nodes.select("hot", "comp").mapInArrow(tidied(ends), "s long, lo long, hi long").groupBy("s").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    mixed = settle(seen.where("lo <> hi").select("s"))
    known = nodes.sparkSession.sparkContext.broadcast(np.sort(np.array([r["s"] for r in mixed.toLocalIterator()], np.int64)))  # of at most HOT_PIVOTS
    release(mixed)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hot = batch.column(0)
            own = np.repeat(np.arange(len(batch)), hot.value_lengths().to_numpy(zero_copy_only=False))
            keep = np.unique(own[among(hot.flatten().to_numpy(zero_copy_only=False), known.value)])
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(i).to_numpy(zero_copy_only=False)[keep]) for i in (1, 2, 3)], names=["node", "comp", "n"])

    return nodes.select("hot", "node", "comp", "n").mapInArrow(tidied(members), "node long, comp long, n long")


def relabel(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """comp of every node brought up to date."""
    return rows.join(labels.select(F.col("node").alias("comp"), F.col("comp").alias("now")), "comp", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")


def split_regions(source: Sets, regions: DataFrame) -> DataFrame:
    """Links across components in large regions (region string, node, comp, n, own), by recursive Voronoi cells."""
    spark, found = regions.sparkSession, []
    for depth in range(DEPTH + 1):
        before, regions = regions, settle(mixed_only(regions))
        release(before)
        if regions.isEmpty():
            break
        central = F.struct("own", F.xxhash64(F.lit(depth), "node"))  # few shingles that others lack
        pivots = regions.groupBy("region").agg(F.min_by("node", central).alias("p1"), F.max_by("node", F.struct("comp", "node")).alias("p2"))
        placed = regions.join(pivots, "region")
        ask = reduce(DataFrame.unionByName, [placed.where(f"node <> {p}").select(F.col(p).alias("a"), F.col("node").alias("b")) for p in ("p1", "p2")]).distinct()
        compared = compare(source, ask)
        found.append(linked(compared))
        far = compared.select("a", "b", F.expr(f"coalesce(1 - try_divide(common, {UNION}), 1.0D)").alias("d"))
        for k in ("1", "2"):
            own = far.select(F.col("a").alias(f"p{k}"), F.col("b").alias("node"), F.col("d").alias(f"d{k}"))
            placed = placed.join(own, [f"p{k}", "node"], "left").withColumn(f"d{k}", F.when(F.col(f"p{k}") == F.col("node"), 0.0).otherwise(F.col(f"d{k}")))
        placed = settle(relabel(placed, components(found[-1].union(placed.select("node", "comp")))))
        cell = F.explode(F.concat(F.when(F.expr(f"d1 - d2 <= 2 * {EPSILON} + 1e-9"), F.array(F.lit("1"))).otherwise(F.array().cast("array<string>")), F.when(F.expr(f"d2 - d1 <= 2 * {EPSILON} + 1e-9"), F.array(F.lit("2"))).otherwise(F.array().cast("array<string>"))))
        cells = placed.withColumn("cell", cell).withColumn("region", F.concat("region", F.lit("/"), "cell"))
        cells = settle(mixed_only(cells.withColumnRenamed("size", "before")))
        last = (F.col("size") <= SMALL) | ((F.col("size") > 0.9 * F.col("before")) & F.lit(depth + 1 >= ROUNDS)) | F.lit(depth == DEPTH)
        rest = cell_pairs(cells.where(last))
        found.append(linked(compare(source, rest)))
        regions = cells.where(~last).select("region", "node", "comp", "n", "own")
        regions = relabel(regions, components(found[-1].union(regions.select("node", "comp"))))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """Of every row its KEY (docs: keyed), n (set size), component_id and whether it stays if one row of each component
    does: the first by doc_id, then the table's order."""
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    counts = windows(docs).select(F.explode("cold").alias("s")).groupBy("s").count().where(F.col("count") > HOT_ROWS)
    hot = np.sort(np.array([r["s"] for r in counts.orderBy(F.desc("count"), "s").limit(HOT_PIVOTS).toLocalIterator()], np.int64).view(np.uint64))
    known = settle(windows(docs, spark.sparkContext.broadcast(hot)).withColumn("doc_id", F.when(F.col("__id") != NO_ID, F.col("__id"))))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    classes = settle(known.where("n > 0").groupBy("key").agg(F.min("row").alias("node"), first, F.count(F.lit(1)).alias("rows")))
    nonempty = known.where("n > 0").withColumnRenamed("row", "node")
    copies = settle(nonempty.select("node").join(classes.select("node"), "node", "left_anti"))
    members = settle(nonempty.join(F.broadcast(copies) if copies.count() <= NEAR_COPIES else copies, "node", "left_anti").select("node", *KEY, "n", "cold", "hot"))
    source = Sets(docs, members.select("node", *KEY))

    probes = settle(members.select("node", F.least("n", F.lit(SHARED_PROBES)).alias("need"), F.explode(F.slice(F.concat("cold", "hot"), 1, PROBES)).alias("s")))
    heads = settle(probes.groupBy("s").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    stars = join_counted(probes, heads, ["s"], "c").where("a < node").groupBy("a", F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need")).where("c >= need").select("a", "b")
    links = linked(compare(source, stars))
    release(probes, heads)
    labels = components(links)

    marked = settle(members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    cold = settle(cold_pairs(marked.select(F.explode("cold").alias("s"), "node", "comp", "n")))
    links = links.unionByName(linked(compare(source, meetings(cold))))
    final = components(links)
    large = mixed_only(relabel(large_regions(cold), final)).select("node", "comp", "n")
    busy = mixed_hot(settle(relabel(marked.where("size(hot) > 0").select("hot", "node", "comp", "n"), final)))
    nodes = settle(large.unionByName(busy).distinct())
    if not nodes.isEmpty():
        anew = windows_anew(source, nodes)
        again = settle(cold_pairs(anew))
        links = links.unionByName(linked(compare(source, meetings(again))))
        final = components(links)
        regions = relabel(large_regions(again), final).join(anew.select("node", "own").distinct(), "node")
        regions = settle(single_regions(regions))
        if not regions.isEmpty():
            final = components(links.unionByName(split_regions(source, regions)))
        release(anew, again, regions)
    release(members, marked, cold, nodes, copies)
    per_class = classes.join(final, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    firsts = per_class.groupBy("comp").agg(F.min("first").alias("least"))
    found = settle(per_class.join(firsts, "comp").select("key", "least", "rows"))
    sets = join_counted(known.where("n > 0"), found, ["key"], "rows").select(*KEY, "doc_id", "n", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("stays"))
    return sets.unionByName(known.where("n = 0").select(*KEY, "doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    return grouped(keyed(docs)).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)
      UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d AS doc_id, min(c) AS component_id FROM r GROUP BY d) m USING (doc_id)
"""
