"""Session dumps: End-of-RIB markers and which observations belong to a dump."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.archive import Archive
from pathloom.schemas import IDENTITY, OBSERVER, SERVED


def markers(archive: Archive) -> DataFrame:
    """Which (observer, session, family) has a marker: existence only, duplicates don't count."""
    return archive.newest("eor_events").select(*OBSERVER, "session_id", "family").distinct().withColumn("marked", F.lit(1))


def dump_state(state: str = "state", marked: str = "marked") -> Column:
    """unknown unless the peer is served; then complete with a marker, else dumping."""
    return F.when(~F.coalesce(F.col(state), F.lit("unspecified")).isin(*SERVED), "unknown").when(F.col(marked) == 1, "complete").otherwise("dumping")


def classified(archive: Archive, table: str, since: datetime | None = None, until: datetime | None = None) -> DataFrame:
    """History with `is_dump`: an announcement that is the first of its identity in its session. The time window is
    applied before, so that it means: the first within the window. Rows are dealt by all that tells them apart, so that
    a busy identity's don't meet in one task; where each identity begins comes from an aggregation of numbers, which
    redelivered rows don't change."""
    key = [*IDENTITY[table], "session_id"]
    found = archive.scan(table, since, until)
    rows = found.repartition(*key, "seq", "stream_seq").dropDuplicates([*key, "seq", "stream_seq"])
    first = found.groupBy(*key).agg(F.min(place()).alias("_first")).withColumnsRenamed({k: f"_{k}" for k in key})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    return rows.join(first, same, "left").withColumn("is_dump", (F.col("is_withdraw") == 0) & (place() == F.col("_first"))).drop("_first", *(f"_{k}" for k in key))


def place() -> Column:
    """The order of rows as one number: `seq`, then `stream_seq`."""
    return (F.col("seq").cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + F.col("stream_seq").cast("decimal(19,0)")).cast("decimal(38,0)")
