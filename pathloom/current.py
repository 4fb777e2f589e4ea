"""Current state: the newest row of each identity and session, in buckets of (router, peer).

A generation adds its rows to the buckets it touches, in a folder of its own, and then a manifest that names for each
bucket the generations that hold it; a bucket of many generations is rewritten as one. A manifest counts once its
writer's last file, _SUCCESS, is there, so a crash at any point leaves the generation before. One writer at a time holds
a table's lease. Folders are never overwritten while a reader may hold them: what no manifest of the last `kept` ones
names can be deleted with `vacuum`. Files are sorted as questions ask, and a question on one peer reads one bucket.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.latest import order
from pathloom.schemas import IDENTITY

BUCKETS = 64
#: Generations of a bucket from which on it is rewritten as one.
MOST_PARTS = 8
#: Seconds after which a lease that nobody gave back is taken over, and that a writer waits for one.
LEASE_S, WAIT_S = 1800, 3600


class LeaseTaken(RuntimeError):
    """Another writer held the table for too long."""


def newest_state(rows: DataFrame, table: str) -> DataFrame:
    """Newest row of each identity and session; whatever order rows come in, the result is the same."""
    keys = [*IDENTITY[table], "session_id"]
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order()).alias("_v")).select(*keys, "_v.*").select(rows.columns)


def bucket() -> Column:
    return F.pmod(F.xxhash64("router_ip", "peer_ip"), F.lit(BUCKETS)).cast("int")


class CurrentTables:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def folder(self, path: str):
        """Hadoop's file system and path of a folder: it may be in any store."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def generations(self, table: str) -> list[int]:
        """Complete generations, newest first."""
        root = f"{self.path}/{table}_current/manifest"
        fs, at = self.folder(root)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(n) for n in names if n.isdigit() and fs.exists(self.folder(f"{root}/{n}/_SUCCESS")[1])), reverse=True)

    def generation(self, table: str) -> int:
        return next(iter(self.generations(table)), 0)

    def manifest(self, table: str, generation: int) -> dict[int, list[int]]:
        """bucket: the generations that hold its rows."""
        if not generation:
            return {}
        out: dict[int, list[int]] = {}
        for r in self.spark.read.schema("bucket int, generation int").json(f"{self.path}/{table}_current/manifest/{generation}").collect():
            out.setdefault(r["bucket"], []).append(r["generation"])
        return out

    def read(self, table: str, buckets: set[int] | None = None) -> DataFrame | None:
        """The newest rows; of buckets in one generation as they stand, of others by comparison."""
        known = {b: g for b, g in self.manifest(table, self.generation(table)).items() if buckets is None or b in buckets}
        paths = lambda one: [f"{self.path}/{table}_current/data/{g}/bucket={b}" for b, gs in sorted(known.items()) for g in gs if (len(gs) == 1) == one]
        whole, parts = (self.spark.read.parquet(*p) if p else None for p in (paths(True), paths(False)))
        if parts is None:
            return whole
        newest = newest_state(parts, table)
        return newest if whole is None else whole.unionByName(newest)

    def of_peer(self, table: str, router_ip: str, peer_ip: str) -> DataFrame | None:
        """The rows of one peer's bucket."""
        own = self.spark.range(1).select(F.lit(router_ip).alias("router_ip"), F.lit(peer_ip).alias("peer_ip")).select(bucket()).first()[0]
        return self.read(table, {own})

    @contextmanager
    def lease(self, table: str) -> Iterator[None]:
        """Only one writer of a table at a time: the one that could create the file."""
        fs, at = self.folder(f"{self.path}/{table}_current/lease")
        until = time.monotonic() + WAIT_S
        while True:
            try:
                fs.create(at, False).close()
                break
            except Py4JJavaError as e:
                if not fs.exists(at):
                    if "AlreadyExists" not in str(e.java_exception.getClass()):
                        raise
                    continue
                if time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > LEASE_S:
                    fs.delete(at, False)
                elif time.monotonic() > until:
                    raise LeaseTaken(table) from e
                else:
                    time.sleep(0.2)
        try:
            yield
        finally:
            fs.delete(at, False)

    def write(self, table: str, rows: DataFrame, replaced: set[int]) -> None:
        """A generation that adds rows; buckets that are replaced hold just these. Under the lease."""
        before = self.generation(table)
        known, n = self.manifest(table, before), before + 1
        data = f"{self.path}/{table}_current/data/{n}"
        dealt = rows.withColumn("bucket", bucket()).repartition("bucket").sortWithinPartitions("bucket", *IDENTITY[table])
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(data)
        fs, at = self.folder(data)
        made = {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(at) if s.getPath().getName().startswith("bucket=")}
        now = {b: ([] if b in replaced else known.get(b, [])) + ([n] if b in made else []) for b in known.keys() | made}
        pairs = [(b, g) for b, gs in now.items() for g in gs]
        self.spark.createDataFrame(pairs, "bucket int, generation int").coalesce(1).write.mode("overwrite").json(f"{self.path}/{table}_current/manifest/{n}")

    def replace(self, table: str, rows: DataFrame) -> None:
        with self.lease(table):
            self.write(table, rows, set(range(BUCKETS)))

    def rewrite(self, table: str, change: Callable[[DataFrame], DataFrame]) -> None:
        """The table, changed as a whole; no other writer comes between."""
        with self.lease(table):
            if (rows := self.read(table)) is not None:
                self.write(table, change(rows), set(range(BUCKETS)))

    def upsert(self, table: str, rows: DataFrame) -> None:
        """Add rows: as a part of their buckets, of which those of many parts are put together."""
        own = newest_state(rows, table)
        touched = {r["b"] for r in rows.select(bucket().alias("b")).distinct().collect()}  # BUCKETS at most
        if not touched:
            return
        with self.lease(table):
            known = self.manifest(table, self.generation(table))
            full = {b for b in touched if len(known.get(b, [])) >= MOST_PARTS}
            before = self.read(table, full) if full else None
            self.write(table, own if before is None else newest_state(before.unionByName(own), table), full)

    def vacuum(self, table: str, kept: int = 100) -> None:
        """Delete what only manifests older than the last `kept` name."""
        every = self.generations(table)
        used = {g for n in every[:kept] for gs in self.manifest(table, n).values() for g in gs}
        newest = max(every, default=0)
        for kind, keep in (("manifest", set(every[:kept])), ("data", used)):
            fs, at = self.folder(f"{self.path}/{table}_current/{kind}")
            for s in fs.listStatus(at) if fs.exists(at) else ():
                if (name := s.getPath().getName()).isdigit() and int(name) not in keep and int(name) <= newest:
                    fs.delete(s.getPath(), True)
