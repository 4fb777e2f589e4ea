"""The archive: logical tables, the clock that answers are as of, and its settings."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.current import CurrentTables
from pathloom.schemas import DDL, IDENTITY, SCHEMA_VERSION


class WrongSchema(ValueError):
    """The archive was written under another schema version."""


@dataclass
class Archive:
    """`tables` is history; `current` holds, where ingest keeps it, the newest row of each identity and session."""

    tables: dict[str, DataFrame]
    as_of: datetime
    stale_after: timedelta = timedelta(seconds=90)
    retention_days: int = 90
    #: How far back a read of the whole fleet may reach; None: any.
    most_unscoped: timedelta | None = None
    current: dict[str, DataFrame] = field(default_factory=dict)
    #: Where the current tables are, for questions on one peer.
    kept: CurrentTables | None = None

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name].drop("month")

    def newest(self, name: str, router_ip: str | None = None, peer_ip: str | None = None) -> DataFrame:
        """Rows among which the newest of each identity and session is: the current table (of one peer, its bucket), or
        else history."""
        if name in self.current and self.kept is not None and router_ip is not None and peer_ip is not None:
            own = self.kept.of_peer(name, router_ip, peer_ip)
            return self.current[name].limit(0) if own is None else own
        return self.current[name] if name in self.current else self[name]

    def scan(self, name: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """History within a window: whole months first, which prune folders."""
        rows = self.tables[name]
        if "month" in rows.columns:
            rows = rows if since is None else rows.where(F.col("month") >= since.strftime("%Y-%m"))
            rows = rows if until is None else rows.where(F.col("month") <= until.strftime("%Y-%m"))
        rows = rows if since is None else rows.where(F.col("ts_collector") >= F.lit(since))
        rows = rows if until is None else rows.where(F.col("ts_collector") < F.lit(until))
        return rows.drop("month")

    def distinct(self, name: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
        """History without redelivered rows: they are equal in identity, session and log position, and came with one
        ts_collector, so the window goes first. Dealt by identity once; what groups by identity needs no other shuffle."""
        identity = IDENTITY.get(name, ["router_ip", "peer_ip", "rib"])
        rows = self.scan(name, since, until).repartition(*identity)
        return rows.dropDuplicates([c for c in (*identity, "session_id", "seq", "stream_seq") if c in rows.columns])

    def beat_limit(self) -> Column:
        return F.lit(self.as_of - self.stale_after)


def open_archive(spark: SparkSession, path: str, as_of: datetime, since: datetime | None = None) -> Archive:
    """Parquet tables partitioned by the month of ts_collector; `since` prunes months as well as rows. Current tables
    are read at their newest complete generation. A table that nothing was written to yet is empty."""
    version = spark.read.json(f"{path}/_schema_version").first()
    if version is None or version["version"] != SCHEMA_VERSION:
        raise WrongSchema(f"archive has version {version and version['version']}, this engine reads {SCHEMA_VERSION}")
    tables, current, kept = {}, {}, CurrentTables(spark, path)
    for name, ddl in DDL.items():
        timed = "ts_collector" in ddl
        schema = ddl + ", month string" if timed else ddl
        fs, at = kept.folder(f"{path}/{name}")
        rows = spark.read.schema(schema).parquet(f"{path}/{name}") if fs.exists(at) else spark.createDataFrame([], schema)
        if timed and since is not None:
            rows = rows.where((F.col("month") >= since.strftime("%Y-%m")) & (F.col("ts_collector") >= F.lit(since)))
        tables[name] = rows
        if name in IDENTITY and (newest := kept.read(name)) is not None:
            current[name] = newest
    return Archive(tables, as_of, current=current, kept=kept)
