"""Peers, routers, collectors and their events."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.archive import Archive
from pathloom.functions.communities import BadFilter
from pathloom.operators.latest import latest
from pathloom.operators.session import PAIR, live, peer_state, peer_up, served
from pathloom.plans.filters import Window, all_of
from pathloom.schemas import FLAGGED, OBSERVER, SERVED

EVENT_KEY = ["router_ip", "peer_ip", "rib", "ts_router", "stream_seq"]


def dump_states(archive: Archive) -> DataFrame:
    """Per observer and session: each family's dump state, as a map."""
    marked = archive.newest("eor_events").where("family <> 'ls'").select(*OBSERVER, "session_id", "family", F.lit(1).alias("m"))
    parts = [archive.newest(t).select(*OBSERVER, "session_id", F.col("family") if t != "route_evpn" else F.lit("evpn").alias("family"), F.lit(0).alias("m")) for t in ("route_unicast", "route_vpn", "route_evpn")]
    families = reduce(DataFrame.unionByName, [marked, *parts]).groupBy(*OBSERVER, "session_id", "family").agg(F.max("m").alias("m"))
    state = F.struct("family", F.when(F.col("m") == 1, "complete").otherwise("dumping"))
    return families.groupBy(*OBSERVER, "session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(state))).alias("dump_states"))


def route_counts(archive: Archive) -> DataFrame:
    """Live unicast routes per observer and session, of served peers only."""
    rows = archive.newest("route_unicast").join(served(archive), [*PAIR, "peer_ip", "session_id"], "left_semi")
    newest = latest(rows, [*OBSERVER, "session_id", "prefix", "path_id"], ["is_withdraw"]).where("is_withdraw = 0")
    return newest.groupBy(*OBSERVER, "session_id").agg(F.count(F.lit(1)).alias("routes"))


def peers(archive: Archive) -> DataFrame:
    """A row per (collector, router, peer, rib)."""
    keys = [*OBSERVER, "session_id"]
    up = peer_up(archive).select(*PAIR, "peer_ip", "session_id", F.col("state").alias("peer_state"))
    joined = peer_state(archive).join(up, [*PAIR, "peer_ip", "session_id"]).join(dump_states(archive), keys, "left").join(route_counts(archive), keys, "left")
    empty = F.create_map().cast("map<string,string>")
    shown = F.when(F.col("state").isin(*SERVED), F.coalesce("dump_states", empty)).otherwise(empty)
    return joined.withColumns({"dump_states": shown, "routes": F.coalesce("routes", F.lit(0))}).drop("peer_state")


def routers(archive: Archive) -> DataFrame:
    """A row per (collector, router): peers by state, last seen."""
    state = F.col("state")
    per_peer = peer_up(archive).groupBy(*PAIR, "session_id").agg(*(F.count_if(state == s).alias(s) for s in ("up", "down", "view_lost", "stale")))
    facts = peer_state(archive).groupBy(*PAIR, "session_id").agg(F.max_by("router_sysname", "last_seen").alias("sysname"), F.max("last_seen").alias("last_seen"), F.max("sys_descr").alias("sys_descr"))
    return facts.join(per_peer, [*PAIR, "session_id"])


def best_routers(archive: Archive) -> DataFrame:
    """A row per router, from the collector whose word counts most: one that is heard from before one that is silent,
    before one that lost its view; then the one that sees most peers; then the greater name."""
    seen = F.col("up") + F.col("down") + F.col("view_lost") + F.col("stale")
    tier = F.when(F.col("stale") > 0, 1).when(F.col("up") + F.col("down") > 0, 2).otherwise(0)
    found = routers(archive)
    return found.groupBy("router_ip").agg(F.max_by(F.struct(*(c for c in found.columns if c != "router_ip")), F.struct(tier.alias("tier"), seen.alias("seen"), "collector_id")).alias("_b")).select("router_ip", "_b.*")


def best_counts(rows: DataFrame, keys: list[str], measure: Column, name: str) -> DataFrame:
    """A measure of each collector's rows alone, the largest per key: a second observer must not make a count grow."""
    return rows.groupBy(*keys, "collector_id").agg(measure.alias(name)).groupBy(*keys).agg(F.max(name).alias(name))


def collectors(archive: Archive) -> DataFrame:
    """A row per (collector, router) with the collector's heartbeat facts and newest row over all tables."""
    rows = [archive[t].select("collector_id", "ts_collector") for t in FLAGGED if t in archive.tables]
    newest = reduce(DataFrame.unionByName, rows).groupBy("collector_id").agg(F.max("ts_collector").alias("last_row_at"))
    seen = F.col("beat_seen") == 1
    facts = live(archive).select("collector_id", F.when(seen, F.col("last_beat")).alias("last_beat_at"), F.when(seen, F.col("epoch")).alias("started_at"))
    return routers(archive).join(newest, "collector_id", "left").join(facts, "collector_id", "left")


def collector_activity(archive: Archive, start: datetime, end: datetime) -> DataFrame:
    """Rows archived per collector and minute, minutes without rows as 0."""
    rows = reduce(DataFrame.unionByName, [archive.scan(t, start, end).select("collector_id", "ts_collector") for t in FLAGGED if t in archive.tables])
    counts = rows.groupBy("collector_id", F.date_trunc("minute", "ts_collector").alias("minute")).agg(F.count(F.lit(1)).alias("rows"))
    spine = counts.select("collector_id").distinct().select("collector_id", F.explode(F.expr(f"sequence(timestamp'{start:%Y-%m-%d %H:%M:00}', timestamp'{end:%Y-%m-%d %H:%M:00}' - interval 1 minute, interval 1 minute)")).alias("minute"))
    return spine.join(counts, ["collector_id", "minute"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def peer_events(archive: Archive, window: Window = Window(), router_ip: str | None = None, peer_ip: str | None = None, after: tuple[datetime, int] | None = None, limit: int = 1000) -> DataFrame:
    """Peer events, newest first; duplicates resolved by the newest arrival. A fleet-wide read needs `since`.
    `after`: (ts_collector, stream_seq) of the last event seen."""
    if router_ip is None:
        if window.since is None:
            raise BadFilter("events of the whole fleet need since")
        window.check_unscoped(archive.as_of, archive.most_unscoped)
    rows = archive.scan("peer_events", *window.bounds())
    scope = [F.col(c) == v for c, v in (("router_ip", router_ip), ("peer_ip", peer_ip)) if v is not None]
    if (c := all_of(scope)) is not None:
        rows = rows.where(c)
    others = ["ts_collector", "seq", "session_id", "collector_id", "router_sysname", "peer_asn", "kind", "down_reason", "local_ip", "local_port", "remote_port"]
    events = latest(rows, EVENT_KEY, others, F.struct("ts_collector", *others[1:4]))
    if after is not None:
        events = events.where(F.struct("ts_collector", "stream_seq") < F.struct(F.lit(after[0]).cast(events.schema["ts_collector"].dataType), F.lit(after[1]).cast("long")))
    return events.orderBy(F.desc("ts_collector"), F.desc("stream_seq")).limit(limit)


def count_events(archive: Archive, window: Window) -> DataFrame:
    rows = archive.scan("peer_events", *window.bounds())
    return rows.select(*EVENT_KEY).distinct().agg(F.count(F.lit(1)).alias("total"))


def session_ages(archive: Archive) -> DataFrame:
    """Age in seconds and reconnects of each (collector, router): sessions seen, first event of the current one."""
    events = archive["peer_events"]
    newest = events.groupBy(*PAIR).agg(F.max("session_id").alias("session_id"), F.count_distinct("session_id").alias("sessions"))
    start = events.groupBy(*PAIR, "session_id").agg(F.min("ts_collector").alias("began"))
    age = (F.unix_timestamp(F.lit(archive.as_of)) - F.unix_timestamp("began")).alias("age_s")
    return newest.join(start, [*PAIR, "session_id"]).select(*PAIR, "session_id", age, (F.col("sessions") - 1).alias("reconnects"))


