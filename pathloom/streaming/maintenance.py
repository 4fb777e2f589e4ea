"""Retention, clean-up of superseded sessions, and purges."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.archive import Archive
from pathloom.current import CurrentTables
from pathloom.operators.session import PAIR, target_liveness
from pathloom.streaming.ingest import CURRENT

KEPT_SESSIONS = 2


class LiveTarget(RuntimeError):
    """What was to be purged is still fed."""


def floors(peer_current: DataFrame) -> DataFrame:
    """The oldest session that stays, per (collector, router)."""
    newest = W.partitionBy(*PAIR).orderBy(F.desc("session_id"))
    ranked = peer_current.select(*PAIR, "session_id").distinct().withColumn("n", F.row_number().over(newest))
    return ranked.where(F.col("n") <= KEPT_SESSIONS).groupBy(*PAIR).agg(F.min("session_id").alias("floor"))


def without_superseded(rows: DataFrame, floor: DataFrame) -> DataFrame:
    return rows.join(floor, PAIR, "left").where("floor is null or session_id >= floor").drop("floor")


def clean_up(spark: SparkSession, path: str) -> None:
    """Rewrites the current tables without superseded sessions, peers last: they say which sessions those are."""
    tables = CurrentTables(spark, path)
    peers = tables.read("peer_events")
    if peers is None:
        return
    floor = floors(peers)
    for table in sorted(CURRENT, key=lambda t: t == "peer_events"):
        tables.rewrite(table, lambda rows: without_superseded(rows, floor))


def purge_plan(archive: Archive, collector: str, router: str | None = None) -> DataFrame:
    """Per (collector, router): the newest session and how many rows a purge would delete; refused for live targets."""
    alive = target_liveness(archive, collector, router).first()
    if alive["live_sessions"] and alive["beat_fresh"]:
        raise LiveTarget(f"{collector} has {alive['live_sessions']} live sessions")
    rows = archive["peer_events"].where(F.col("collector_id") == collector)
    rows = rows if router is None else rows.where(F.col("router_ip") == router)
    return rows.groupBy(*PAIR).agg(F.max("session_id").alias("up_to"), F.count(F.lit(1)).alias("rows"))


def purged(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows that the plan leaves: later sessions stay even if they came after it was made."""
    return rows.join(plan.select(*PAIR, "up_to"), PAIR, "left").where("up_to is null or session_id > up_to").drop("up_to")


def expire(spark: SparkSession, path: str, table: str, now: datetime, days: int = 90) -> list[str]:
    """Drops whole months of history that retention has passed; returns them. Current tables never expire."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/{table}")
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    limit, gone = (now - timedelta(days=days)).strftime("%Y-%m"), []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("month=") and name.removeprefix("month=") < limit:
            fs.delete(status.getPath(), True)
            gone.append(name.removeprefix("month="))
    return sorted(gone)
