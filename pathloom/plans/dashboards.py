"""Questions of the dashboards that the read API doesn't ask."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pathloom.archive import Archive
from pathloom.functions import addresses
from pathloom.functions.names import evpn_shown, looked_up
from pathloom.operators.latest import latest, order
from pathloom.operators.observers import best_rows
from pathloom.operators.session import PAIR, current
from pathloom.plans.filters import Window, all_of, any_of
from pathloom.plans.linkstate import node_key
from pathloom.schemas import FLAGGED, IDENTITY, NODE_KEY, OBSERVER, stream_of

ARRIVAL = ("ts_collector", "stream_seq")


def newest_seen(archive: Archive, window: Window, table: str = "route_unicast") -> DataFrame:
    """The newest observation of each route by arrival, whatever its session."""
    rows = archive.distinct(table, *window.bounds())
    columns = ["as_path", "is_withdraw", "next_hop", "med", "local_pref", "session_id", "router_sysname", "ts_collector"]
    return latest(rows, IDENTITY[table], columns, F.struct(*ARRIVAL)).withColumnRenamed("ts_collector", "last_seen")


def neighbours(path: str = "as_path") -> Column:
    """(asn, neighbour, direction) for each two ASes next to each other."""
    p, steps = F.col(path), F.sequence(F.lit(1), F.size(path) - 1)
    pair = lambda a, b, d: F.struct(a.alias("asn"), b.alias("neighbour"), F.lit(d).alias("direction"))
    both = F.flatten(F.transform(steps, lambda i: F.array(pair(F.get(p, i), F.get(p, i - 1), "toward collector"), pair(F.get(p, i - 1), F.get(p, i), "toward origin"))))
    return F.when(F.size(path) > 1, F.filter(both, lambda x: x["asn"] != x["neighbour"])).otherwise(F.array().cast("array<struct<asn:bigint,neighbour:bigint,direction:string>>"))


def asn_table(archive: Archive, window: Window = Window()) -> DataFrame:
    """Per AS: prefixes originated and transited, routers, neighbours."""
    live = newest_seen(archive, window).where("is_withdraw = 0 and size(as_path) > 0")
    each = live.select("router_ip", "prefix", F.try_element_at("as_path", F.lit(-1)).alias("last"), F.explode(F.array_distinct("as_path")).alias("asn"))
    at_end = F.col("asn") == F.col("last")
    # observers of one prefix and router are put together before distinct counts multiply the rows
    once = each.groupBy("asn", "prefix", "router_ip").agg(F.max(at_end).alias("end"), F.max(~at_end).alias("within"))
    roles = once.groupBy("asn").agg(F.count_distinct(F.when(F.col("end"), F.col("prefix"))).alias("originated"), F.count_distinct(F.when(F.col("within"), F.col("prefix"))).alias("transited"), F.count_distinct("router_ip").alias("routers"))
    near = adjacent_asns(archive, window).groupBy("asn").agg(F.count_distinct("neighbour").alias("neighbours"))
    return roles.join(near, "asn", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def adjacent_asns(archive: Archive, window: Window = Window()) -> DataFrame:
    live = newest_seen(archive, window).where("is_withdraw = 0")
    return live.select("prefix", F.explode(neighbours()).alias("n")).groupBy("n.asn", "n.neighbour", "n.direction").agg(F.count_distinct("prefix").alias("prefixes"))


def asn_prefixes(archive: Archive, asn: int, window: Window = Window()) -> DataFrame:
    """Each route whose path holds the AS: its role, state and whether its session is the current one."""
    rows = newest_seen(archive, window).where(F.array_contains("as_path", F.lit(asn).cast("long")))
    role = F.when(F.try_element_at("as_path", F.lit(-1)) == asn, "origin").otherwise("transit").alias("role")
    return session_marked(archive, rows).select("collector_id", "prefix", role, F.array_join("as_path", " ").alias("path"), "router_sysname", "peer_ip", "rib", shown_state(), "next_hop", "last_seen", "session_current")


def shown_state() -> Column:
    return F.when(F.col("is_withdraw") == 1, "withdrawn").otherwise("advertised").alias("state")


def session_marked(archive: Archive, rows: DataFrame) -> DataFrame:
    newest = archive["peer_events"].groupBy(*PAIR).agg(F.max("session_id").alias("sid"))
    return rows.join(newest, PAIR, "left").withColumn("session_current", (F.col("session_id") == F.coalesce("sid", F.lit(0))).cast("int")).drop("sid")


def looking_glass(archive: Archive, address: str, window: Window = Window(), table: str = "route_unicast") -> DataFrame:
    """Routes that cover an address, marked by length and whether their session is current."""
    rows = newest_seen(archive, window, table).where(addresses.covers(F.col("prefix"), address))
    length = F.substring_index("prefix", "/", -1).cast("int").alias("length")
    return session_marked(archive, rows).withColumn("length", length).withColumn("state", shown_state())


def looking_glass_summary(archive: Archive, address: str, window: Window = Window(), table: str = "route_unicast") -> DataFrame:
    rows = looking_glass(archive, address, window, table)
    return rows.agg(F.count(F.lit(1)).alias("routes"), F.count_distinct("prefix").alias("prefixes"), F.max("length").alias("most_specific"), F.count_if(F.col("session_current") == 0).alias("superseded"))


def flap_rows(archive: Archive, window: Window = Window()) -> DataFrame:
    """EVPN observations with the next one of the same route (whatever its session): a flap is a withdrawal that an
    announcement follows."""
    rows = archive.distinct("route_evpn", *window.bounds())
    w = W.partitionBy("collector_id", "router_ip", "peer_ip", "rib", "route_type", "rd", "mac", "ip", "prefix", "ethernet_tag", "path_id").orderBy(*ARRIVAL)
    after, back = F.lead("ts_collector").over(w), F.lead("is_withdraw").over(w)
    shown = rows.withColumns({"next_at": after, "next_withdraw": back, "route": evpn_shown(F.col("route_type")), "type_name": looked_up(F.col("route_type"), {2: "mac-ip", 3: "imet", 5: "ip-prefix"}, "other")})
    flap = F.coalesce((F.col("is_withdraw") == 1) & (F.col("next_withdraw") == 0) & (F.col("next_at") > F.col("ts_collector")), F.lit(False))
    return shown.withColumn("is_flap", flap).withColumn("gap_ms", F.when(F.col("is_flap"), F.timestamp_diff("MILLISECOND", "ts_collector", "next_at")).otherwise(F.lit(0).cast("long")))


def flap_summary(archive: Archive, window: Window = Window()) -> DataFrame:
    """Routes, flapping routes, cycles and the median time away in ms, as the best observer saw them."""
    what = F.struct("route", "rd", "router_sysname")
    per = flap_rows(archive, window).groupBy("collector_id").agg(F.count(F.lit(1)).alias("obs"), F.count_distinct(what).alias("routes"), F.count_distinct(F.when(F.col("is_flap"), what)).alias("flapping"), F.count_if("is_flap").alias("cycles"), F.coalesce(F.median(F.when(F.col("is_flap"), F.col("gap_ms"))), F.lit(0.0)).alias("median_ms"))
    return best_rows(per.withColumn("all", F.lit(1)), ["all"], "obs", ["routes", "flapping", "cycles", "median_ms"]).drop("all")


def unstable_routes(archive: Archive, window: Window = Window(), top: int = 50) -> DataFrame:
    per = flap_rows(archive, window).groupBy("route", "rd", "router_sysname", "collector_id").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("is_withdraw") == 0).alias("advertisements"), F.count_if(F.col("is_withdraw") == 1).alias("withdrawals"),
        F.count_if("is_flap").alias("flaps"), F.sum("gap_ms").alias("away_ms"), F.max("ts_collector").alias("last_seen"),
    )
    best = best_rows(per, ["route", "rd", "router_sysname"], "observations", ["advertisements", "withdrawals", "flaps", "away_ms", "last_seen"])
    return best.orderBy(F.desc("flaps"), F.desc("withdrawals"), "route", "rd", "router_sysname").limit(top)


def flap_cycles(archive: Archive, window: Window = Window(), top: int = 50) -> DataFrame:
    cycles = flap_rows(archive, window).where("is_flap")
    return cycles.select("collector_id", "route", "rd", "router_sysname", F.col("ts_collector").alias("withdrawn_at"), F.col("next_at").alias("returned_at"), "gap_ms", "stream_seq").orderBy(F.desc("gap_ms"), F.desc("withdrawn_at"), F.desc("stream_seq")).limit(top)


def vpn_observations(archive: Archive, window: Window = Window()) -> DataFrame:
    """L3VPN history of the observer with the most rows, per (family, rd, prefix, router)."""
    rows = archive.distinct("route_vpn", *window.bounds())
    entity = ["family", "rd", "prefix", "router_ip"]
    counts = rows.groupBy(*entity, "collector_id").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(*entity).agg(F.max_by("collector_id", F.struct("n", "collector_id")).alias("collector_id"))
    return rows.join(best, [*entity, "collector_id"], "left_semi")


def top_vpn_prefixes(archive: Archive, window: Window = Window(), top: int = 50) -> DataFrame:
    counts = vpn_observations(archive, window).groupBy("family", "rd", "prefix").agg(F.count_distinct("router_ip").alias("routers"), F.count_distinct("session_id").alias("sessions"), F.count(F.lit(1)).alias("observations"), F.count_if(F.col("is_withdraw") == 1).alias("withdrawals"), F.max("ts_collector").alias("last_seen"))
    return counts.orderBy(F.desc("routers"), F.desc("sessions"), F.desc("observations"), "prefix", "rd", "family").limit(top)


def top_rds(archive: Archive, window: Window = Window(), top: int = 50) -> DataFrame:
    counts = vpn_observations(archive, window).groupBy("family", "rd").agg(F.count_distinct("prefix").alias("prefixes"), F.count_distinct("router_ip").alias("routers"), F.count_distinct("session_id").alias("sessions"))
    return counts.orderBy(F.desc("prefixes"), F.desc("routers"), "rd", "family").limit(top)


def vpn_routes_header(archive: Archive, window: Window = Window(), ribs: list[str] | None = None, families: list[str] | None = None, rds: list[str] | None = None) -> DataFrame:
    """One row on the VPN routes seen: routes, VRFs, targets, routers, and observations that carry no target. Each choice
    is a list of texts or patterns."""
    rows = archive.distinct("route_vpn", *window.bounds())
    if (scope := all_of([c for c in (any_of("rib", ribs), any_of("family", families), any_of("rd", rds)) if c is not None])) is not None:
        rows = rows.where(scope)
    # one row a route before anything distinct is counted
    routes = rows.groupBy("family", "rd", "prefix", "router_ip").agg(F.count_if((F.col("family") != "lu4") & (F.size("route_targets") == 0)).alias("bare"), F.array_distinct(F.flatten(F.collect_set("route_targets"))).alias("targets"))
    targets = routes.select(F.explode("targets").alias("t")).distinct().agg(F.count(F.lit(1)).alias("n"))
    facts = routes.agg(F.count(F.lit(1)).alias("routes"), F.count_distinct(F.when(F.col("rd") != "", F.col("rd"))).alias("vrfs"), F.count_distinct("router_ip").alias("routers"), F.coalesce(F.sum("bare"), F.lit(0)).alias("no_route_target"))
    return facts.withColumn("targets", targets.scalar())


def vpn_header(archive: Archive, window: Window = Window()) -> DataFrame:
    return vpn_observations(archive, window).agg(F.count_distinct(F.struct("rd", "prefix")).alias("prefixes"), F.count_distinct(F.when(F.col("rd") != "", F.col("rd"))).alias("rds"), F.count_distinct("router_ip").alias("routers"), F.count_if(F.col("is_withdraw") == 1).alias("withdrawals"))


def route_target_rollup(archive: Archive, window: Window = Window()) -> DataFrame:
    """Per route target: prefixes, RDs and routers that carry it."""
    rows = vpn_observations(archive, window).where("is_withdraw = 0").select("rd", "prefix", "router_ip", F.explode("route_targets").alias("route_target"))
    return rows.groupBy("route_target").agg(F.count_distinct(F.struct("rd", "prefix")).alias("prefixes"), F.count_distinct("rd").alias("rds"), F.count_distinct("router_ip").alias("routers"))


def anomalies(archive: Archive, window: Window = Window()) -> DataFrame:
    """Parse flags by table: rows, sessions and routers under an accommodation."""
    parts = None
    for t in FLAGGED:
        if t in archive.tables:
            rows = archive.scan(t, *window.bounds())
            own = rows.where(F.size("parse_flags") > 0).select(F.lit(t).alias("source"), "router_ip", "session_id", "collector_id", "stream_seq", F.explode("parse_flags").alias("flag"))
            parts = own if parts is None else parts.unionByName(own)
    return parts.groupBy("flag", "source").agg(F.count_distinct("stream_seq").alias("messages"), F.count_distinct(F.struct("collector_id", "router_ip", "session_id")).alias("sessions"), F.count_distinct("router_ip").alias("routers"))


#: What one object of a table is, for counting how many a flag affects.
OBJECTS = {
    "route_unicast": ["prefix"], "route_vpn": ["rd", "prefix"], "route_evpn": ["route_type", "rd", "mac", "ip", "prefix"], "ls_events": ["stream_seq"], "ls_nodes": NODE_KEY, "ls_links": [f"{side}_{c}" if c in NODE_KEY[2:] else c for side in ("local", "remote") for c in NODE_KEY],
    "ls_prefixes": [*NODE_KEY, "prefix", "prefix_len"], "peer_events": ["router_ip", "peer_ip"], "stats_events": ["router_ip", "peer_ip"], "eor_events": ["peer_ip", "rib", "family"],
}


def flagged(archive: Archive, window: Window = Window()) -> DataFrame:
    """A row per flag of each flagged observation: where, of which object and message."""
    parts = []
    for t in (t for t in FLAGGED if t in archive.tables):
        rows = archive.scan(t, *window.bounds()).where(F.size("parse_flags") > 0)
        named = F.concat_ws("|", *(F.col(c).cast("string") for c in dict.fromkeys(OBJECTS[t])))
        parts.append(rows.select(F.explode("parse_flags").alias("flag"), F.lit(t).alias("source"), F.lit(stream_of(t)).alias("stream"), "stream_seq", "router_ip", "router_sysname", "session_id", named.alias("object"), "ts_collector"))
    return reduce(DataFrame.unionByName, parts)


def flags_by_platform(archive: Archive, window: Window = Window()) -> DataFrame:
    """Per flag, platform and router: objects, sessions, messages and tables affected. Repeated observations of an object
    are put together before anything distinct is counted."""
    platform = F.when(F.coalesce("router_sysname", F.lit("")) == "", "(no sysName TLV)").otherwise(F.col("router_sysname")).alias("platform")
    key = ["flag", "platform", "router_ip"]
    once = flagged(archive, window).select("flag", platform, "router_ip", "source", "stream", "stream_seq", "session_id", "object", "ts_collector").groupBy(*key, "source", "stream", "stream_seq", "session_id", "object").agg(F.max("ts_collector").alias("seen"))
    return once.groupBy(*key).agg(F.count_distinct("object").alias("affected"), F.count_distinct("session_id").alias("sessions"), F.count_distinct(F.struct("stream", "stream_seq")).alias("events"), F.count_distinct("source").alias("in_tables"), F.max("seen").alias("last_seen"))


def flags_over_time(archive: Archive, window: Window, seconds: int) -> DataFrame:
    """Messages per flag and time bucket."""
    bucket = F.window("ts_collector", f"{seconds} seconds")["start"].alias("bucket")
    return flagged(archive, window).select(bucket, "flag", "stream", "stream_seq").distinct().groupBy("bucket", "flag").agg(F.count(F.lit(1)).alias("events"))


def link_state_stats(archive: Archive, router_ip: str, peer_ip: str, window: Window = Window()) -> DataFrame:
    """Per collector and kind of object: how many the current session of a router carries on a peer, and how many were
    seen in the window, from one scan each."""
    now = current(archive).where(F.col("router_ip") == router_ip).select("collector_id", F.col("session_id").alias("now"))
    within = all_of(window.conditions())
    parts = []
    for kind in ("nodes", "links", "prefixes"):
        t = f"ls_{kind}"
        own = [c for c in IDENTITY[t] if c not in OBSERVER]
        rows = archive[t].where((F.col("router_ip") == router_ip) & (F.col("peer_ip") == peer_ip)).join(now, "collector_id")
        seen = rows.groupBy("collector_id", *own).agg(F.max(F.col("session_id") == F.col("now")).alias("here"), F.max(F.lit(True) if within is None else within).alias("lately"))
        parts.append(seen.groupBy("collector_id").agg(F.count_if("here").alias("in_current_session"), F.count_if("lately").alias("in_window")).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, parts)


def link_state_nodes(archive: Archive, router_ip: str, peer_ip: str, states: tuple[int, ...] = (0,), focus: int | None = None) -> DataFrame:
    """The nodes that the current session of a router carries on a peer, as a table shows them. `focus`: one node's key."""
    now = current(archive).where(F.col("router_ip") == router_ip).select("collector_id", "session_id")
    rows = archive.newest("ls_nodes", router_ip, peer_ip).where((F.col("router_ip") == router_ip) & (F.col("peer_ip") == peer_ip)).join(now, ["collector_id", "session_id"], "left_semi").withColumn("node_key", node_key())
    if focus is not None:
        rows = rows.where(F.col("node_key") == focus)
    columns = ["is_withdraw", *(c for c in ("name", "router_id_v4", "srgb_base", "srgb_size", "srlb_base", "srlb_size", "sr_algorithms", "unknown_tlvs") if c in rows.columns)]
    found = rows.groupBy("collector_id", *NODE_KEY, "node_key").agg(F.max_by(F.struct(*columns), order()).alias("v"), F.max("ts_collector").alias("last_seen")).where(F.col("v.is_withdraw").isin(*states))
    text = lambda c: F.coalesce(F.col(f"v.{c}"), F.lit(""))
    span = lambda c: F.when(F.coalesce(F.col(f"v.{c}_size"), F.lit(0)) > 0, F.concat_ws("-", F.col(f"v.{c}_base"), F.col(f"v.{c}_base") + F.col(f"v.{c}_size") - 1)).otherwise("") if f"{c}_size" in columns else F.lit("")
    quad = F.when(F.length("router_id") == 8, addresses.dotted(F.col("router_id"))).otherwise(F.col("router_id"))
    label = F.when(text("name") != "", text("name")).when(text("router_id_v4") != "", text("router_id_v4")).otherwise(quad)
    algorithms = F.array_join("v.sr_algorithms", ", ") if "sr_algorithms" in columns else F.lit("")
    unknown = F.coalesce(F.size("v.unknown_tlvs"), F.lit(0)) if "unknown_tlvs" in columns else F.lit(0)
    return found.select("collector_id", label.alias("node"), "router_id", text("router_id_v4").alias("router_id_v4"), "protocol", "area", "asn", span("srgb").alias("srgb"), span("srlb").alias("srlb"), algorithms.alias("sr_algorithms"), unknown.alias("unknown_tlv_count"), "last_seen")


def view_completeness(archive: Archive, window: Window = Window()) -> DataFrame:
    """Per collector and router: sessions in the window; link-state nodes and edges that its current session carries and
    that were seen in the window. What a new session has not sent yet shows as the difference."""
    key, within = ["collector_id", "router_sysname", "router_ip"], all_of(window.conditions())
    lately = F.lit(True) if within is None else within
    spine = archive["peer_events"].groupBy(*key).agg(F.max("session_id").alias("now"), F.count_distinct(F.when(lately, F.col("session_id"))).alias("sessions"))
    out = spine
    for table, name, own in (("ls_nodes", "nodes", NODE_KEY), ("ls_links", "edges", OBJECTS["ls_links"])):
        rows = archive[table].join(spine.select(*key, "now"), key)
        seen = rows.groupBy(*key, *dict.fromkeys(own)).agg(F.max(F.col("session_id") == F.col("now")).alias("here"), F.max(lately).alias("lately"))
        out = out.join(seen.groupBy(*key).agg(F.count_if("here").alias(f"{name}_current_session"), F.count_if("lately").alias(f"{name}_in_window")), key, "left")
    counts = [f"{n}_{c}" for n in ("nodes", "edges") for c in ("current_session", "in_window")]
    return out.drop("now").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
