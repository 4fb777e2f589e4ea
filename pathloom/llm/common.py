"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which it counts as hot, and how many hot keys are broadcast at most (about 32 bytes each).
HOT_KEY, HOT_KEYS = 1000, 500_000
BATCH_BYTES = 1 << 21
NO_ID, FEW_COPIES = -(1 << 63), 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Only a session on one machine may lack it, as in
    tests; it gets a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path}/llm"


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder as Parquet and read again: cuts the lineage, survives lost executors."""
    path = f"{work_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(*frames: DataFrame) -> None:
    """Delete settled tables that nothing reads any more. Shuffle files go when the driver's JVM finds that no frame
    holds them, so it is asked to look."""
    for f in frames:
        if path := getattr(f, "settled_at", None):
            remove_path(f.sparkSession, path)
    if frames:
        frames[0].sparkSession.sparkContext._jvm.System.gc()


def clear_work(spark: SparkSession) -> None:
    """Delete all intermediate tables. Only when no DataFrame still reads them."""
    remove_path(spark, work_dir(spark))


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(c: str = "text") -> Column:
    """A text column with null as empty."""
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def digest_of(text: Column) -> Column:
    """16 bytes that name a text."""
    return F.unhex(F.md5(text.cast("binary")))


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is: in the folder PATHLOOM_TOKENIZERS, or where its package has it."""
    if folder := os.environ.get("PATHLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, whatever the length of texts. Every operator asks for the same, so it
    doesn't matter when a lazy frame runs."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Bytes of a worker's freed memory that a task uses again, and from which an array has pages of its own.
REUSED, OWN_PAGES = 1 << 24, 1 << 23


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """malloc_trim, if there is one. Else arrays of some MB would get new pages from the system each time."""
    c = ctypes.CDLL(None)
    if mallopt := getattr(c, "mallopt", None):
        mallopt(-1, REUSED)  # M_TRIM_THRESHOLD
        mallopt(-3, OWN_PAGES)  # M_MMAP_THRESHOLD
    return getattr(c, "malloc_trim", None)


#: By module: what forgets the tables that its tasks keep in a worker.
FORGET: dict[str, Callable[[], None]] = {}


def enter(module: str) -> None:
    """Before a task of this module: a worker keeps no tables of other modules' tasks."""
    _trim()
    for name, forget in FORGET.items():
        if name != module:
            forget()


def leave() -> None:
    """After a task: the worker, which is kept for later ones, gives its freed memory back."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, with a worker's memory looked after."""
    module = run.__module__

    def tidy(batches: Iterator) -> Iterator:
        enter(module)
        try:
            yield from run(batches)
        finally:
            leave()

    return tidy


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """rows joined with counted, which has a row for each key and in n how many rows have it. The most frequent keys
    are broadcast, HOT_KEYS at most, so that no task gets all rows of one; the others meet by a shuffle."""
    hot = settle(counted.where(F.col(n) > HOT_KEY).orderBy(F.desc(n)).limit(HOT_KEYS))
    if hot.isEmpty():
        return rows.join(counted, keys)
    few = F.broadcast(hot.select(keys))
    cold = rows.join(few, keys, "left_anti").join(counted.join(few, keys, "left_anti"), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys).select(cold.columns))


KEY = ["__id", "__digest", "__copy"]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with a key for each row: doc_id, the text's digest and, where rows share both, a number. Digests are made
    only if rows share a doc_id (else they are empty), and compared among such rows only."""
    base = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), "__digest": digest_of(whole_text())})
    shared = settle(base.groupBy("__id").count().where("count > 1").select("__id"))
    once = base.withColumn("__copy", F.lit(-1).cast("long"))
    if shared.isEmpty():
        return once.withColumn("__digest", F.lit(b""))
    some = base.join(F.broadcast(shared), "__id", "left_semi") if shared.count() <= FEW_COPIES else base
    again = settle(some.groupBy("__id", "__digest").count().where("count > 1").select("__id", "__digest"))
    if again.isEmpty():
        return once
    few = F.broadcast(again) if again.count() <= FEW_COPIES else again
    copies = settle(base.join(few, ["__id", "__digest"], "left_semi").withColumn("__copy", F.monotonically_increasing_id()))
    return once.join(few, ["__id", "__digest"], "left_anti").unionByName(copies)
