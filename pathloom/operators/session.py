"""Sessions, liveness and the gate that decides whose routes are served."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.archive import Archive
from pathloom.operators.latest import newest_if, order
from pathloom.schemas import SERVED

PAIR = ["collector_id", "router_ip"]


def live(archive: Archive) -> DataFrame:
    """Per collector: newest process start (ns), newest heartbeat, whether there was one."""
    beats = archive["collector_beats"].select("collector_id", "started_at", "inserted_at", F.lit(1).alias("seen"))
    zero = archive["peer_events"].select("collector_id").distinct().select("collector_id", F.lit(0).cast("long").alias("started_at"), F.timestamp_seconds(F.lit(0)).alias("inserted_at"), F.lit(0).alias("seen"))
    return beats.unionByName(zero).groupBy("collector_id").agg(F.max("started_at").alias("epoch"), F.max("inserted_at").alias("last_beat"), F.max("seen").alias("beat_seen"))


def current(archive: Archive) -> DataFrame:
    """The newest session of each (collector, router), with its collector's liveness."""
    newest = archive["peer_events"].groupBy(*PAIR).agg(F.max("session_id").alias("session_id"))
    return newest.join(live(archive), "collector_id")


def epoch_lost() -> Column:
    return F.col("session_id") < F.col("epoch")


def beat_stale(archive: Archive) -> Column:
    return F.col("last_beat") < archive.beat_limit()


def live_state(archive: Archive, stored: str = "stored_state") -> Column:
    """A stored `up` reads view_lost if its session is older than its collector's process, stale if the collector is silent."""
    up = F.col(stored) == "up"
    return F.when(up & epoch_lost(), "view_lost").when(up & beat_stale(archive), "stale").otherwise(F.col(stored))


def in_session(archive: Archive, rows: DataFrame) -> DataFrame:
    return rows.join(current(archive), [*PAIR, "session_id"])


def peer_state(archive: Archive) -> DataFrame:
    """Per (collector, router, peer, rib) of the current session: state and session facts."""
    seen = F.col("hold_time_seen") == 1
    events = in_session(archive, archive["peer_events"])
    newest = lambda c: F.max_by(c, order()).alias(c)
    state = events.groupBy(*PAIR, "peer_ip", "rib", "session_id", "epoch", "last_beat").agg(
        F.max_by("kind", order()).alias("stored_state"), newest("peer_asn"), newest("router_sysname"),
        F.max("ts_collector").alias("last_seen"), newest_if("hold_time", seen, 0), F.max("hold_time_seen").alias("hold_time_seen"),
        newest_if("mp_families", seen), newest_if("addpath_families", seen), newest_if("sys_descr", F.col("sys_descr") != "", ""),
        newest_if("ts_collector", F.col("kind") == "up").alias("up_since"), F.max((F.col("kind") == "up").cast("int")).alias("up_seen"),
    )
    return state.withColumn("state", live_state(archive)).drop("epoch", "last_beat")


def peer_up(archive: Archive) -> DataFrame:
    """Per (collector, router, peer), whatever the rib: routes are gated on this, not on a rib's own events."""
    events = in_session(archive, archive["peer_events"])
    state = events.groupBy(*PAIR, "peer_ip", "session_id", "epoch", "last_beat").agg(F.max_by("kind", order()).alias("stored_state"))
    return state.withColumn("state", live_state(archive)).drop("epoch", "last_beat")


def served(archive: Archive) -> DataFrame:
    """The peers whose routes are served: (collector, router, peer, session)."""
    return peer_up(archive).where(F.col("state").isin(*SERVED)).select(*PAIR, "peer_ip", "session_id")


def stale_pairs(archive: Archive) -> DataFrame:
    """(collector, router) whose current session is stale, not superseded, and has a peer stored up."""
    up = peer_up(archive).where("stored_state = 'up'").select(*PAIR, "session_id").distinct()
    return current(archive).where(~epoch_lost() & beat_stale(archive)).join(up, [*PAIR, "session_id"], "left_semi").select(*PAIR)


def target_liveness(archive: Archive, collector: str, router: str | None = None) -> DataFrame:
    """One row on a purge target: heartbeat facts and its sessions that are live."""
    facts = live(archive).where(F.col("collector_id") == collector).agg(F.coalesce(F.max("beat_seen"), F.lit(0)).alias("has_beat"), F.max("last_beat").alias("newest_beat"), F.max("epoch").alias("newest_start"))
    up = peer_up(archive).where("stored_state = 'up'").select(*PAIR, "session_id").distinct()
    sessions = current(archive).where((F.col("collector_id") == collector) & ~epoch_lost())
    if router is not None:
        sessions = sessions.where(F.col("router_ip") == router)
    n = sessions.join(up, [*PAIR, "session_id"], "left_semi").agg(F.count(F.lit(1)).alias("live_sessions"))
    return facts.crossJoin(n).withColumn("beat_fresh", F.coalesce(F.col("newest_beat") >= archive.beat_limit(), F.lit(False)))
