"""What the archive lacks of its log: gaps in stream sequences, redeliveries, and how far behind a query is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.window import Window

from pathloom.archive import Archive
from pathloom.schemas import FLAGGED, IDENTITY, stream_of

#: Sequence numbers that one window partition looks at.
STRETCH = 1 << 20


def delivered(archive: Archive) -> DataFrame:
    """stream, stream_seq: once for each message that left rows."""
    parts = [archive[t].select(F.lit(stream_of(t)).alias("stream"), "stream_seq").distinct() for t in FLAGGED if t in archive.tables]
    return reduce(DataFrame.unionByName, parts).distinct()


def gaps(archive: Archive, stretch: int = STRETCH) -> DataFrame:
    """stream, after, before, missing: sequence numbers between two that left rows. (Messages without rows, as those
    that were rejected, are gaps too.) A stream is looked at in stretches, whose ends then meet."""
    seen = delivered(archive).withColumn("stretch", F.floor(F.col("stream_seq") / stretch))
    inside = seen.withColumn("after", F.lag("stream_seq").over(Window.partitionBy("stream", "stretch").orderBy("stream_seq"))).select("stream", "after", F.col("stream_seq").alias("before"))
    ends = seen.groupBy("stream", "stretch").agg(F.min("stream_seq").alias("before"), F.max("stream_seq").alias("last"))
    between = ends.withColumn("after", F.lag("last").over(Window.partitionBy("stream").orderBy("stretch"))).select("stream", "after", "before")
    return inside.unionByName(between).where("before - after > 1").withColumn("missing", F.col("before") - F.col("after") - 1)


def redelivered(archive: Archive) -> DataFrame:
    """stream, redelivered: messages of which a row was stored more than once."""
    parts = []
    for t in (t for t in FLAGGED if t in archive.tables):
        keys = [c for c in (*IDENTITY.get(t, ["router_ip", "peer_ip", "rib"]), "session_id", "seq", "stream_seq") if c in archive[t].columns]
        keys += [c for c in ("is_withdraw",) if c in archive[t].columns]
        parts.append(archive[t].groupBy(*keys).count().where("count > 1").select(F.lit(stream_of(t)).alias("stream"), "stream_seq").distinct())
    return reduce(DataFrame.unionByName, parts).distinct().groupBy("stream").agg(F.count(F.lit(1)).alias("redelivered"))


def accounts(archive: Archive) -> DataFrame:
    """Per stream: first and last sequence number, messages archived, missing between them, in how many gaps, redelivered."""
    span = delivered(archive).groupBy("stream").agg(F.min("stream_seq").alias("first"), F.max("stream_seq").alias("last"), F.count(F.lit(1)).alias("archived"))
    holes = gaps(archive).groupBy("stream").agg(F.count(F.lit(1)).alias("gaps"))
    out = span.join(holes, "stream", "left").join(redelivered(archive), "stream", "left")
    return out.select("stream", "first", "last", "archived", (F.col("last") - F.col("first") + 1 - F.col("archived")).alias("missing"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "redelivered")))


class Progress(StreamingQueryListener):
    """Batches of the session's queries as they end: rows read, and seconds from a batch's start to its commit."""

    def __init__(self, most: int = 10_000):
        self.most, self.batches = most, list[tuple]()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches = [*self.batches, (str(p.id), p.batchId, p.timestamp, p.numInputRows, (p.durationMs or {}).get("triggerExecution", 0) / 1000)][-self.most :]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.batches, "query string, batch long, began string, rows long, seconds double")
