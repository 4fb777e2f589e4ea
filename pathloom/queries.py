"""The engine's questions over the bridged archive, each with the SQL that must give the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom import wire_queries
from pathloom.archive import Archive
from pathloom.current import CurrentTables, newest_state
from pathloom.functions import addresses, communities
from pathloom.functions.names import down_reason, evpn_shown, protocol
from pathloom.operators import session
from pathloom.operators.dumps import classified
from pathloom.plans import churn, dashboards, linkstate, lookup, peers, results, routes, topology
from pathloom.plans.filters import LinkStateFilter, RouteFilter, Window
from pathloom.sources.bridge import bridge, oracle_ctes
from pathloom.streaming import lag

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = Window(datetime(2024, 1, 20), datetime(2024, 1, 27))
LONG = Window(datetime(1996, 1, 1), datetime(2024, 1, 31))
ASN, THROUGH = 64605, 64503

STALE = "TIMESTAMP '2024-01-30 23:59:00'"
#: The shared sub-plans, in SQL.
SESSIONS = f"""
live AS (SELECT collector_id, max(started_at) AS epoch, max(inserted_at) AS last_beat, max(seen) AS beat_seen
         FROM (SELECT collector_id, started_at, inserted_at, 1 AS seen FROM collector_beats
               UNION ALL SELECT DISTINCT collector_id, 0, TIMESTAMP '1970-01-01', 0 FROM peer_events) GROUP BY collector_id),
cur AS (SELECT c.*, epoch, last_beat FROM (SELECT collector_id, router_ip, max(session_id) AS session_id FROM peer_events GROUP BY ALL) c JOIN live USING (collector_id)),
here AS (SELECT p.*, epoch, last_beat FROM peer_events p JOIN cur USING (collector_id, router_ip, session_id)),
ps0 AS (SELECT collector_id, router_ip, peer_ip, rib, session_id, arg_max_null(kind, seq) AS stored, arg_max_null(peer_asn, seq) AS peer_asn, arg_max_null(router_sysname, seq) AS sysname,
               max(ts_collector) AS last_seen, arg_max(hold_time, seq) FILTER (WHERE hold_time_seen = 1) AS hold_time, max(hold_time_seen) AS hold_time_seen,
               arg_max(sys_descr, seq) FILTER (WHERE sys_descr <> '') AS sys_descr, arg_max(ts_collector, seq) FILTER (WHERE kind = 'up') AS up_since, any_value(epoch) AS epoch, any_value(last_beat) AS last_beat
        FROM here GROUP BY ALL),
peer_state AS (SELECT *, CASE WHEN stored = 'up' AND session_id < epoch THEN 'view_lost' WHEN stored = 'up' AND last_beat < {STALE} THEN 'stale' ELSE stored END AS state FROM ps0),
pu0 AS (SELECT collector_id, router_ip, peer_ip, session_id, arg_max_null(kind, seq) AS stored, any_value(epoch) AS epoch, any_value(last_beat) AS last_beat FROM here GROUP BY ALL),
peer_up AS (SELECT *, CASE WHEN stored = 'up' AND session_id < epoch THEN 'view_lost' WHEN stored = 'up' AND last_beat < {STALE} THEN 'stale' ELSE stored END AS state FROM pu0),
served AS (SELECT collector_id, router_ip, peer_ip, session_id FROM peer_up WHERE state IN ('up', 'stale')),
eor AS (SELECT DISTINCT collector_id, router_ip, peer_ip, rib, session_id, family, 1 AS marked FROM eor_events)"""
#: Newest unicast observations of served sessions.
UNICAST = """
newest AS (SELECT r.collector_id, r.router_ip, r.peer_ip, r.rib, r.family, r.prefix, r.path_id, r.session_id, arg_max_null(is_withdraw, seq) AS is_withdraw, arg_max_null(as_path, seq) AS as_path, arg_max_null(next_hop, seq) AS next_hop,
                  arg_max_null(med, seq) AS med, arg_max_null(local_pref, seq) AS local_pref, arg_max_null(communities, seq) AS communities, arg_max_null(large_communities, seq) AS large_communities, arg_max_null(route_targets, seq) AS route_targets
           FROM route_unicast r JOIN served USING (collector_id, router_ip, peer_ip, session_id) GROUP BY ALL),
shown AS (SELECT n.*, coalesce(s.sysname, '') AS sysname, n.as_path[-1] AS origin_asn, CASE WHEN coalesce(s.state, 'unspecified') NOT IN ('up', 'stale') THEN 'unknown' WHEN e.marked = 1 THEN 'complete' ELSE 'dumping' END AS dump_state
          FROM newest n LEFT JOIN peer_state s USING (collector_id, router_ip, peer_ip, rib, session_id) LEFT JOIN eor e USING (collector_id, router_ip, peer_ip, rib, session_id, family) WHERE n.is_withdraw = 0)"""
ROUTE_OUT = "sysname, collector_id, router_ip, peer_ip, rib, family, prefix, path_id, next_hop, array_to_string(as_path, ' ') AS path, origin_asn, med, local_pref, dump_state"


def window_sql(w: Window, ts: str = "ts_collector") -> str:
    return f"{ts} >= TIMESTAMP '{w.since}' AND {ts} < TIMESTAMP '{w.until}'"


IDENT = {
    "route_unicast": "collector_id, router_ip, peer_ip, rib, family, prefix, path_id, session_id",
    "route_vpn": "collector_id, router_ip, peer_ip, rib, family, rd, prefix, path_id, session_id",
    "route_evpn": "collector_id, router_ip, peer_ip, rib, route_type, rd, prefix, mac, ip, ethernet_tag, esi, path_id, session_id",
}


def observed_sql(w: Window, tables: tuple[str, ...] = tuple(IDENT)) -> str:
    each = (f"SELECT collector_id, router_ip, router_sysname, peer_ip, peer_asn, ts_collector, seq, is_withdraw, is_withdraw = 0 AND seq = min(seq) OVER (PARTITION BY {IDENT[t]}) AS is_dump FROM {t} WHERE {window_sql(w)}" for t in tables)
    return "obs AS (" + "\nUNION ALL ".join(each) + ")"


MEASURES_SQL = "count(*) FILTER (WHERE NOT is_dump AND is_withdraw = 0) AS readvertise, count(*) FILTER (WHERE is_withdraw = 1) AS withdraw, count(*) FILTER (WHERE is_dump) AS dump, count(*) AS total"


def question(body: str | None = None, *ctes: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(bridge(spark, sf_dir))
        if body is not None:
            ORACLE_SQL[f.__name__] = "WITH " + ",\n".join([oracle_ctes(), *ctes]) + "\n" + body
        return f

    return add


def route_out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("sysname", "collector_id", "router_ip", "peer_ip", "rib", "family", "prefix", "path_id", "next_hop", F.array_join("as_path", " ").alias("path"), "origin_asn", "med", "local_pref", "dump_state", *more)


# --- routes


@question(f"SELECT {ROUTE_OUT} FROM shown WHERE prefix = '172.18.0.0/16'", SESSIONS, UNICAST)
def q1_routes(a):
    return route_out(routes.current_routes(a, RouteFilter(prefix="172.18.0.0/16")))


@question("SELECT count(*) AS total FROM shown WHERE prefix = '172.18.0.0/16'", SESSIONS, UNICAST)
def q2_count_routes(a):
    return routes.count_routes(a, RouteFilter(prefix="172.18.0.0/16"))


@question(f"SELECT {ROUTE_OUT} FROM shown WHERE origin_asn = {ASN}", SESSIONS, UNICAST)
def q1_routes_origin_asn(a):
    return route_out(routes.current_routes(a, RouteFilter(origin_asn=ASN)))


def with_current(a: Archive, *names: str) -> Archive:
    """The archive with current tables, written as ingest writes them and read back."""
    spark = a[names[0]].sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="pathloom-")
    kept = CurrentTables(spark, f"{root}/current/{uuid.uuid4().hex}")
    for n in names:
        kept.replace(n, newest_state(a[n], n))
    return replace(a, current={n: kept.read(n) for n in names}, kept=kept)


@question(f"SELECT {ROUTE_OUT} FROM shown WHERE origin_asn = {ASN}", SESSIONS, UNICAST)
def q1_routes_origin_asn_current(a):
    """The same from a stored current table: no aggregation when asked."""
    a = with_current(a, "route_unicast")
    return route_out(routes.current_routes(a, RouteFilter(origin_asn=ASN)))


@question(f"SELECT {ROUTE_OUT} FROM shown WHERE router_ip = '10.0.0.1' AND peer_ip = '10.1.0.1' AND list_contains(as_path, {THROUGH})", SESSIONS, UNICAST)
def t9_routes_of_one_peer(a):
    """One bucket of a stored current table."""
    return route_out(routes.current_routes(with_current(a, "route_unicast"), RouteFilter(router_ip="10.0.0.1", peer_ip="::ffff:10.1.0.1", through_asn=THROUGH)))


@question(f"SELECT {ROUTE_OUT} FROM shown WHERE list_contains(as_path, {THROUGH})", SESSIONS, UNICAST)
def q1_routes_through_asn(a):
    return route_out(routes.current_routes(a, RouteFilter(through_asn=THROUGH)))


@question(f"SELECT {ROUTE_OUT} FROM shown WHERE origin_asn = {ASN}", SESSIONS, UNICAST)
def r1_routes_without_semi_join(a):
    return route_out(routes.current_routes(a, RouteFilter(origin_asn=ASN), semi_join=False))


@question(f"SELECT {ROUTE_OUT} FROM shown WHERE list_contains(communities, 65000::BIGINT * 65536 + 3) OR list_contains(route_targets, '65000:3')", SESSIONS, UNICAST)
def f8_routes_community(a):
    return route_out(routes.current_routes(a, RouteFilter(community="65000:3")))


@question(f"SELECT {ROUTE_OUT} FROM shown WHERE prefix = '172.19.0.0/16'", SESSIONS, UNICAST)
def f5_routes_covers(a):
    return route_out(routes.current_routes(a, RouteFilter(covers="172.19.7.1")))


VPN = """
vnew AS (SELECT r.collector_id, r.router_ip, r.peer_ip, r.rib, r.family, r.rd, r.prefix, r.path_id, r.session_id, arg_max_null(is_withdraw, seq) AS is_withdraw, arg_max_null(labels, seq) AS labels, arg_max_null(route_targets, seq) AS route_targets
         FROM route_vpn r JOIN served USING (collector_id, router_ip, peer_ip, session_id) GROUP BY ALL)"""


@question("""SELECT n.collector_id, n.router_ip, n.peer_ip, n.rib, n.rd, n.prefix, CASE WHEN labels[1] <> 524288 THEN labels[1] END AS label, array_to_string(route_targets, ' ') AS targets,
  CASE WHEN coalesce(s.state, 'unspecified') NOT IN ('up', 'stale') THEN 'unknown' WHEN e.marked = 1 THEN 'complete' ELSE 'dumping' END AS dump_state
  FROM vnew n LEFT JOIN peer_state s USING (collector_id, router_ip, peer_ip, rib, session_id) LEFT JOIN eor e USING (collector_id, router_ip, peer_ip, rib, session_id, family) WHERE is_withdraw = 0 AND rd = '65000:2'""", SESSIONS, VPN)
def q3_vpn_routes(a):
    r = routes.current_routes(a, RouteFilter(rd="65000:2"), "route_vpn")
    return r.select("collector_id", "router_ip", "peer_ip", "rib", "rd", "prefix", "label", F.array_join("route_targets", " ").alias("targets"), "dump_state")


@question("""SELECT n.collector_id, n.router_ip, n.peer_ip, n.rib, n.route_type, n.rd, n.prefix, n.mac, n.ethernet_tag, label,
  CASE WHEN coalesce(s.state, 'unspecified') NOT IN ('up', 'stale') THEN 'unknown' WHEN e.marked = 1 THEN 'complete' ELSE 'dumping' END AS dump_state
  FROM (SELECT r.collector_id, r.router_ip, r.peer_ip, r.rib, r.route_type, r.rd, r.prefix, r.mac, r.ip, r.ethernet_tag, r.esi, r.path_id, r.session_id, arg_max_null(is_withdraw, seq) AS w, arg_max_null(labels[1], seq) AS label
        FROM route_evpn r JOIN served USING (collector_id, router_ip, peer_ip, session_id) WHERE rd = '65000:1' GROUP BY ALL) n
  LEFT JOIN peer_state s USING (collector_id, router_ip, peer_ip, rib, session_id) LEFT JOIN (SELECT * FROM eor WHERE family = 'evpn') e USING (collector_id, router_ip, peer_ip, rib, session_id) WHERE w = 0""", SESSIONS)
def q4_evpn_routes(a):
    r = routes.current_routes(a, RouteFilter(rd="65000:1"), "route_evpn")
    return r.select("collector_id", "router_ip", "peer_ip", "rib", "route_type", "rd", "prefix", "mac", "ethernet_tag", F.get("labels", 0).alias("label"), "dump_state")


@question("""SELECT rib, family, prefix, path_id, next_hop, dump_state FROM (SELECT *, row_number() OVER (ORDER BY CASE rib WHEN 'in_pre' THEN 0 WHEN 'in_post' THEN 1 ELSE 4 END, family, prefix, path_id) AS n
  FROM shown WHERE collector_id = 'c0' AND router_ip = (SELECT min(router_ip) FROM served WHERE collector_id = 'c0') AND peer_ip = (SELECT min(peer_ip) FROM served WHERE collector_id = 'c0' AND router_ip = (SELECT min(router_ip) FROM served WHERE collector_id = 'c0'))) WHERE n > 5 AND n <= 15""", SESSIONS, UNICAST)
def q5_rib_page(a):
    """The second page of a walk, after a first one of five rows."""
    first = session.served(a).where("collector_id = 'c0'").orderBy("router_ip", "peer_ip").first()
    cursor = routes.start_walk(a, first["router_ip"], first["peer_ip"], "c0")
    _, more = routes.walk_page(a, cursor, 5)
    page, _ = routes.walk_page(a, more or cursor, 10)
    return page.select("rib", "family", "prefix", "path_id", "next_hop", "dump_state")


@question("""SELECT kind, count(*) AS routes FROM (SELECT 'unicast' AS kind FROM shown WHERE router_ip = '10.0.0.2' UNION ALL SELECT 'vpn' FROM vnew WHERE is_withdraw = 0 AND router_ip = '10.0.0.2'
  UNION ALL SELECT 'evpn' FROM (SELECT arg_max_null(is_withdraw, seq) AS w FROM route_evpn r JOIN served USING (collector_id, router_ip, peer_ip, session_id) WHERE router_ip = '10.0.0.2' GROUP BY r.collector_id, r.router_ip, r.peer_ip, r.rib, r.route_type, r.rd, r.prefix, r.mac, r.ip, r.ethernet_tag, r.esi, r.path_id, r.session_id) WHERE w = 0) GROUP BY kind""", SESSIONS, UNICAST, VPN)
def q32_all_routes(a):
    return routes.all_routes(a, RouteFilter(router_ip="10.0.0.2")).groupBy("kind").agg(F.count(F.lit(1)).alias("routes"))


@question("SELECT DISTINCT ts_collector, seq, session_id, collector_id, router_ip, peer_ip, rib, prefix, path_id, CASE WHEN is_withdraw = 1 THEN 'withdraw' ELSE 'announce' END AS action, next_hop, array_to_string(as_path, ' ') AS path FROM route_unicast WHERE prefix = '172.20.0.0/16' AND " + window_sql(LONG))
def q13_route_history(a):
    h = routes.route_history(a, "172.20.0.0/16", LONG)
    return h.select("ts_collector", "seq", "session_id", "collector_id", "router_ip", "peer_ip", "rib", "prefix", "path_id", "action", "next_hop", F.array_join("as_path", " ").alias("path"))


# --- peers


PEERS = """
fam AS (SELECT collector_id, router_ip, peer_ip, rib, session_id, family, max(m) AS m FROM (
    SELECT collector_id, router_ip, peer_ip, rib, session_id, family, 1 AS m FROM eor_events WHERE family <> 'ls' UNION ALL SELECT collector_id, router_ip, peer_ip, rib, session_id, family, 0 FROM route_unicast
    UNION ALL SELECT collector_id, router_ip, peer_ip, rib, session_id, family, 0 FROM route_vpn UNION ALL SELECT collector_id, router_ip, peer_ip, rib, session_id, 'evpn', 0 FROM route_evpn) GROUP BY ALL),
dm AS (SELECT collector_id, router_ip, peer_ip, rib, session_id, string_agg(family || '=' || CASE WHEN m = 1 THEN 'complete' ELSE 'dumping' END, ',' ORDER BY family) AS dumps FROM fam GROUP BY ALL),
rc AS (SELECT collector_id, router_ip, peer_ip, rib, session_id, count(*) AS routes FROM (SELECT r.collector_id, r.router_ip, r.peer_ip, r.rib, r.session_id, prefix, path_id, arg_max_null(is_withdraw, seq) AS w FROM route_unicast r JOIN served USING (collector_id, router_ip, peer_ip, session_id) GROUP BY ALL) WHERE w = 0 GROUP BY ALL)"""


@question("""SELECT collector_id, router_ip, peer_ip, rib, session_id, p.state, peer_asn, CASE WHEN p.state IN ('up', 'stale') THEN coalesce(dumps, '') ELSE '' END AS dumps, coalesce(routes, 0) AS routes, coalesce(hold_time, 0) AS hold_time, hold_time_seen, coalesce(sys_descr, '') AS sys_descr, up_since
  FROM peer_state p LEFT JOIN dm USING (collector_id, router_ip, peer_ip, rib, session_id) LEFT JOIN rc USING (collector_id, router_ip, peer_ip, rib, session_id)""", SESSIONS, PEERS)
def q9_peers(a):
    dumps = F.array_join(F.transform(F.array_sort(F.map_entries("dump_states")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return peers.peers(a).select("collector_id", "router_ip", "peer_ip", "rib", "session_id", "state", "peer_asn", dumps.alias("dumps"), "routes", "hold_time", "hold_time_seen", "sys_descr", "up_since")


ROUTERS = """
rp AS (SELECT collector_id, router_ip, session_id, count(*) FILTER (WHERE state = 'up') AS up, count(*) FILTER (WHERE state = 'down') AS down, count(*) FILTER (WHERE state = 'view_lost') AS view_lost, count(*) FILTER (WHERE state = 'stale') AS stale FROM peer_up GROUP BY ALL),
rs AS (SELECT collector_id, router_ip, session_id, max(last_seen) AS last_seen, max(sysname) AS sysname FROM peer_state GROUP BY ALL)"""


@question("SELECT sysname, router_ip, collector_id, session_id, up, down, view_lost, stale, last_seen FROM rs JOIN rp USING (collector_id, router_ip, session_id)", SESSIONS, ROUTERS)
def q10_routers(a):
    return peers.routers(a).select("sysname", "router_ip", "collector_id", "session_id", "up", "down", "view_lost", "stale", "last_seen")


ALL_ROWS = "allrows AS (" + " UNION ALL ".join(f"SELECT collector_id, ts_collector FROM {t}" for t in ("route_unicast", "route_vpn", "route_evpn", "ls_nodes", "ls_links", "ls_prefixes", "peer_events", "eor_events", "stats_events")) + ")"


@question("""SELECT collector_id, router_ip, up, down, view_lost, stale, last_row_at, CASE WHEN beat_seen = 1 THEN last_beat END AS last_beat_at FROM rs JOIN rp USING (collector_id, router_ip, session_id)
  LEFT JOIN (SELECT collector_id, max(ts_collector) AS last_row_at FROM allrows GROUP BY 1) USING (collector_id) LEFT JOIN live USING (collector_id)""", SESSIONS, ROUTERS, ALL_ROWS)
def q11_collectors(a):
    return peers.collectors(a).select("collector_id", "router_ip", "up", "down", "view_lost", "stale", "last_row_at", "last_beat_at")


@question("""SELECT c.collector_id, m.minute, count(a.ts_collector) AS rows FROM (SELECT DISTINCT collector_id FROM allrows WHERE ts_collector >= TIMESTAMP '2024-01-10' AND ts_collector < TIMESTAMP '2024-01-10 06:00:00') c
  CROSS JOIN (SELECT unnest(range(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-10 06:00:00', INTERVAL 1 MINUTE)) AS minute) m LEFT JOIN allrows a ON a.collector_id = c.collector_id AND date_trunc('minute', a.ts_collector) = m.minute GROUP BY ALL""", ALL_ROWS)
def q12_collector_activity(a):
    return peers.collector_activity(a, datetime(2024, 1, 10), datetime(2024, 1, 10, 6))


EVENTS = "SELECT router_ip, peer_ip, rib, ts_router, stream_seq, ts_collector, seq, session_id, collector_id, router_sysname, peer_asn, kind, down_reason FROM peer_events WHERE "


@question(EVENTS + f"router_ip = '10.0.0.3' AND {window_sql(DAY)} AND (ts_collector, stream_seq) < (TIMESTAMP '2024-01-25', 0) ORDER BY ts_collector DESC, stream_seq DESC LIMIT 100")
def q14_peer_events_page(a):
    return peers.peer_events(a, DAY, router_ip="10.0.0.3", after=(datetime(2024, 1, 25), 0), limit=100).drop("local_ip", "local_port", "remote_port")


@question(EVENTS + f"{window_sql(DAY)} ORDER BY ts_collector DESC, stream_seq DESC LIMIT 500")
def q15_fleet_events(a):
    return peers.peer_events(a, DAY, limit=500).drop("local_ip", "local_port", "remote_port")


@question(f"SELECT count(*) AS total FROM peer_events WHERE {window_sql(DAY)}")
def q15_count_fleet_events(a):
    return peers.count_events(a, DAY)


# --- collection and churn


@question("SELECT router_ip, last(router_sysname ORDER BY ts_collector, seq) AS sysname, count(*) AS archived, count(*) FILTER (WHERE is_dump) AS dumps, count(*) FILTER (WHERE NOT is_dump) AS changes FROM obs GROUP BY ALL", observed_sql(LONG))
def q16_dump_counts(a):
    return churn.dump_counts(a, LONG)


@question(f"""SELECT router_ip, sysname, sessions, up, down, view_lost FROM (SELECT *, row_number() OVER (PARTITION BY router_ip ORDER BY up + down DESC, collector_id DESC) AS n, CAST(sum(vl) OVER (PARTITION BY router_ip) AS BIGINT) AS view_lost
  FROM (SELECT router_ip, collector_id, last(router_sysname ORDER BY ts_collector, seq, stream_seq) AS sysname, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE kind = 'up') AS up, count(*) FILTER (WHERE kind = 'down') AS down, count(*) FILTER (WHERE kind = 'view_lost') AS vl FROM peer_events WHERE {window_sql(DAY)} GROUP BY ALL)) WHERE n = 1""")
def q17_session_counts(a):
    return churn.session_counts(a, DAY)


@question("""SELECT router_ip, peer_ip, coalesce(reported, 0) AS reported, coalesce(archived, 0) AS archived, coalesce(has_stat, 0) AS has_stat FROM
  (SELECT router_ip, peer_ip, CAST(arg_max(counters, stream_seq) AS BIGINT) AS reported, 1 AS has_stat FROM stats_events GROUP BY ALL) FULL JOIN
  (SELECT router_ip, peer_ip, count(*) AS archived FROM (SELECT router_ip, peer_ip, rib, family, prefix, path_id, arg_max_null(is_withdraw, seq) AS w FROM route_unicast r
     JOIN (SELECT collector_id, router_ip, max(session_id) AS session_id FROM (SELECT collector_id, router_ip, session_id FROM cur UNION ALL SELECT collector_id, router_ip, session_id FROM route_unicast WHERE rib = 'loc_rib') GROUP BY ALL) USING (collector_id, router_ip, session_id)
     WHERE rib = 'loc_rib' GROUP BY ALL) WHERE w = 0 GROUP BY ALL) USING (router_ip, peer_ip)""", SESSIONS)
def q18_locrib_comparison(a):
    return churn.locrib_comparison(a)


FLAGGED_SQL = " UNION ".join(f"SELECT '{s}' AS stream, stream_seq, unnest(parse_flags) AS flag FROM {t}" for t, s in (("route_unicast", "routes"), ("route_vpn", "routes"), ("route_evpn", "routes"), ("ls_nodes", "ls"), ("ls_links", "ls"), ("ls_prefixes", "ls"), ("peer_events", "peer"), ("eor_events", "routes"), ("stats_events", "stats")))


@question(f"SELECT flag, count(*) AS envelopes FROM (SELECT DISTINCT * FROM ({FLAGGED_SQL})) GROUP BY flag")
def q19_flag_counts(a):
    return churn.flag_counts(a)


def buckets_sql(ctes: str, interval: str) -> str:
    return f"""SELECT bucket, CAST(sum(readvertise) AS BIGINT) AS readvertise, CAST(sum(withdraw) AS BIGINT) AS withdraw, CAST(sum(dump) AS BIGINT) AS dump FROM
  (SELECT *, first_value(collector_id) OVER (PARTITION BY router_ip ORDER BY w DESC, collector_id DESC) AS best FROM (SELECT *, sum(total) OVER (PARTITION BY router_ip, collector_id) AS w FROM
  (SELECT time_bucket(INTERVAL {interval}, ts_collector, TIMESTAMP '1970-01-01') AS bucket, router_ip, collector_id, {MEASURES_SQL} FROM {ctes} GROUP BY ALL))) WHERE collector_id = best GROUP BY bucket"""


@question(buckets_sql("obs", "'6 hours'"), observed_sql(DAY))
def q20_churn_buckets(a):
    return churn.churn_buckets(a, DAY, 6 * 3600)


@question(f"""SELECT router_ip, peer_ip, sysname, asn, readvertise, withdraw, dump FROM (SELECT *, row_number() OVER (PARTITION BY router_ip, peer_ip ORDER BY total DESC, collector_id DESC) AS n FROM
  (SELECT router_ip, peer_ip, collector_id, arg_max(router_sysname, seq) AS sysname, arg_max(peer_asn, seq) AS asn, {MEASURES_SQL} FROM obs GROUP BY ALL)) WHERE n = 1""", observed_sql(LONG))
def q21_churn_by_peer(a):
    return churn.churn_by_peer(a, LONG)


@question(f"""SELECT router_ip, peer_ip, bucket, readvertise + withdraw AS changes FROM (SELECT *, first_value(collector_id) OVER (PARTITION BY router_ip, peer_ip ORDER BY w DESC, collector_id DESC) AS best FROM
  (SELECT *, sum(total) OVER (PARTITION BY router_ip, peer_ip, collector_id) AS w FROM (SELECT router_ip, peer_ip, collector_id, time_bucket(INTERVAL '1 day', ts_collector, TIMESTAMP '1970-01-01') AS bucket, {MEASURES_SQL} FROM obs GROUP BY ALL)))
  WHERE collector_id = best AND readvertise + withdraw > 0""", observed_sql(DAY))
def q22_churn_activity(a):
    return churn.churn_activity(a, DAY, 86400)


@question(f"""SELECT prefix, observations, readvertise, withdraw, dump, routes, sessions FROM (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY total DESC, collector_id DESC) AS n FROM
  (SELECT prefix, collector_id, count(*) AS observations, {MEASURES_SQL}, count(DISTINCT (router_ip, peer_ip, rib, family, path_id)) AS routes, count(DISTINCT session_id) AS sessions FROM
  (SELECT *, is_withdraw = 0 AND seq = min(seq) OVER (PARTITION BY {IDENT['route_unicast']}) AS is_dump FROM route_unicast WHERE {window_sql(LONG)}) WHERE prefix <> '' GROUP BY ALL)) WHERE n = 1""")
def q23_churn_by_prefix(a):
    return churn.churn_by_prefix(a, LONG)


@question(f"SELECT collector_id, session_id, count(*) FILTER (WHERE d) AS dumps, count(*) AS rows FROM (SELECT collector_id, session_id, is_withdraw = 0 AND seq = min(seq) OVER (PARTITION BY {IDENT['route_vpn']}) AS d FROM route_vpn WHERE {window_sql(LONG)}) GROUP BY ALL")
def w1_dump_classification(a):
    rows = classified(a, "route_vpn", *LONG.bounds())
    return rows.groupBy("collector_id", "session_id").agg(F.count_if("is_dump").alias("dumps"), F.count(F.lit(1)).alias("rows"))


# --- topology


GRAPH = """
g AS (SELECT * FROM (SELECT r.collector_id, r.router_ip, r.peer_ip, r.rib, r.family, r.prefix, r.path_id, arg_max(as_path, seq) FILTER (WHERE is_withdraw = 0) AS as_path, arg_max_null(is_withdraw, seq) AS w, any_value(r.peer_asn) AS peer_asn, min(ts_collector) AS first_seen
      FROM route_unicast r JOIN served USING (collector_id, router_ip, peer_ip, session_id) WHERE router_ip = '10.0.0.1' GROUP BY ALL) WHERE len(as_path) > 0),
k AS (SELECT *, (router_ip, peer_ip, rib, family, prefix, path_id) AS route FROM g)"""


@question("""SELECT src, dst, count(DISTINCT route) AS routes, count(DISTINCT route) FILTER (WHERE w = 0) AS live_routes, min(first_seen) AS first_seen FROM
  (SELECT route, w, first_seen, as_path[i] AS src, as_path[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(as_path))) AS i FROM k)) WHERE src <> dst GROUP BY ALL""", SESSIONS, GRAPH)
def q24_topology_edges(a):
    return topology.edges(topology.topology_routes(a, RouteFilter(router_ip="10.0.0.1")))


@question("""SELECT asn, count(DISTINCT route) AS routes, max(CASE WHEN asn = as_path[-1] THEN 1 ELSE 0 END) AS origin, max(CASE WHEN asn <> as_path[-1] THEN 1 ELSE 0 END) AS transit, max(CASE WHEN asn = peer_asn THEN 1 ELSE 0 END) AS peer, min(first_seen) AS first_seen
  FROM (SELECT *, unnest(list_distinct(as_path)) AS asn FROM k) GROUP BY asn""", SESSIONS, GRAPH)
def q24_topology_nodes(a):
    return topology.nodes(topology.topology_routes(a, RouteFilter(router_ip="10.0.0.1")))


@question("SELECT count(DISTINCT route) AS routes FROM k", SESSIONS, GRAPH)
def q24_topology_population(a):
    return topology.population(topology.topology_routes(a, RouteFilter(router_ip="10.0.0.1")))


@question(f"""SELECT src, dst FROM (SELECT DISTINCT src, dst FROM (SELECT as_path[i] AS src, as_path[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(as_path))) AS i FROM k)) WHERE src <> dst) e
  WHERE dst = {ASN} OR dst IN (SELECT src FROM (SELECT as_path[i] AS src, as_path[i + 1] AS dst FROM (SELECT *, unnest(range(1, len(as_path))) AS i FROM k)) WHERE dst = {ASN} AND src <> dst)""", SESSIONS, GRAPH)
def c3_trimmed_graph(a):
    e = topology.edges(topology.topology_routes(a, RouteFilter(router_ip="10.0.0.1")))
    return topology.trimmed(e, e.sparkSession.createDataFrame([(ASN,)], "asn long"), 2).select("src", "dst")


# --- link-state


LS = """
ln AS (SELECT * FROM (SELECT r.collector_id, r.router_ip, r.peer_ip, r.rib, protocol, identifier, asn, bgpls_id, area, router_id, r.session_id, arg_max_null(is_withdraw, seq) AS w, arg_max_null(name, seq) AS name, arg_max_null(router_id_v4, seq) AS v4
       FROM ls_nodes r JOIN served USING (collector_id, router_ip, peer_ip, session_id) GROUP BY ALL) WHERE w = 0),
ll AS (SELECT * FROM (SELECT r.collector_id, r.router_ip, r.peer_ip, r.rib, protocol, local_area, local_router_id, remote_area, remote_router_id, local_ifaddr, remote_ifaddr, link_local_id, link_remote_id, r.session_id, arg_max_null(is_withdraw, seq) AS w, arg_max_null(igp_metric, seq) AS igp_metric
       FROM ls_links r JOIN served USING (collector_id, router_ip, peer_ip, session_id) GROUP BY ALL) WHERE w = 0),
lp AS (SELECT * FROM (SELECT r.collector_id, r.router_ip, r.peer_ip, r.rib, protocol, area, router_id, prefix, prefix_len, r.session_id, arg_max_null(is_withdraw, seq) AS w, arg_max_null(prefix_sid, seq) AS prefix_sid, arg_max_null(prefix_metric, seq) AS prefix_metric
       FROM ls_prefixes r JOIN served USING (collector_id, router_ip, peer_ip, session_id) GROUP BY ALL) WHERE w = 0)"""
LS_STATE = "CASE WHEN coalesce(s.state, 'unspecified') NOT IN ('up', 'stale') THEN 'unknown' WHEN e.marked = 1 THEN 'complete' ELSE 'dumping' END AS dump_state"
LS_JOIN = "LEFT JOIN peer_state s USING (collector_id, router_ip, peer_ip, rib, session_id) LEFT JOIN (SELECT * FROM eor WHERE family = 'ls') e USING (collector_id, router_ip, peer_ip, rib, session_id)"
PROTO = "CASE protocol WHEN 1 THEN 'isis-l1' WHEN 2 THEN 'isis-l2' ELSE 'unknown' END AS protocol_name"


@question(f"SELECT collector_id, router_ip, peer_ip, rib, {PROTO}, area, router_id, v4 AS router_id_v4, name, {LS_STATE} FROM ln {LS_JOIN}", SESSIONS, LS)
def q25_ls_nodes(a):
    return linkstate.ls_nodes(a).select("collector_id", "router_ip", "peer_ip", "rib", "protocol_name", "area", "router_id", "router_id_v4", "name", "dump_state")


@question(f"SELECT collector_id, router_ip, peer_ip, rib, {PROTO}, area, prefix || '/' || prefix_len AS cidr, prefix_sid, prefix_metric, {LS_STATE} FROM lp {LS_JOIN} WHERE area = 0", SESSIONS, LS)
def q26_ls_prefixes(a):
    return linkstate.ls_prefixes(a, LinkStateFilter(area=0)).select("collector_id", "router_ip", "peer_ip", "rib", "protocol_name", "area", "cidr", "prefix_sid", "prefix_metric", "dump_state")


LABELS = """
own AS (SELECT collector_id, router_ip, peer_ip, rib, protocol, area, router_id, max(name) AS oname, max(v4) AS ov4 FROM ln GROUP BY ALL),
fleet AS (SELECT protocol, area, router_id, max(name) AS fname, max(router_id_v4) AS fv4 FROM ls_nodes r JOIN served USING (collector_id, router_ip, peer_ip, session_id) WHERE is_withdraw = 0 GROUP BY ALL)"""


@question("""SELECT l.collector_id, l.router_ip, l.peer_ip, l.rib, local_router_id, remote_router_id, local_ifaddr, igp_metric,
  coalesce(nullif(o.oname, ''), nullif(o.ov4, ''), nullif(f.fname, ''), nullif(f.fv4, ''), local_router_id) AS local_label, CASE WHEN coalesce(nullif(o.oname, ''), nullif(o.ov4, '')) IS NOT NULL THEN 'observer' WHEN coalesce(nullif(f.fname, ''), nullif(f.fv4, '')) IS NOT NULL THEN 'fleet' ELSE 'identifier' END AS local_source
  FROM ll l LEFT JOIN own o ON o.collector_id = l.collector_id AND o.router_ip = l.router_ip AND o.peer_ip = l.peer_ip AND o.rib = l.rib AND o.protocol = l.protocol AND o.area = l.local_area AND o.router_id = l.local_router_id
  LEFT JOIN fleet f ON f.protocol = l.protocol AND f.area = l.local_area AND f.router_id = l.local_router_id""", SESSIONS, LS, LABELS)
def q27_ls_links(a):
    return linkstate.ls_links(a).select("collector_id", "router_ip", "peer_ip", "rib", "local_router_id", "remote_router_id", "local_ifaddr", "igp_metric", "local_label", F.col("local_label_source").alias("local_source"))


@question("""SELECT x.router_id AS src, x.remote_router_id AS dst, x.metrics, x.members, y.n IS NULL AS one_sided FROM (SELECT protocol, local_area, local_router_id AS router_id, remote_area, remote_router_id, array_to_string(list_sort(list_distinct(list(igp_metric))), ',') AS metrics, count(*) AS members FROM ll GROUP BY ALL) x
  LEFT JOIN (SELECT protocol, local_area, local_router_id, remote_area, remote_router_id, count(*) AS n FROM ll GROUP BY ALL) y ON y.protocol = x.protocol AND y.local_router_id = x.remote_router_id AND y.remote_router_id = x.router_id AND y.local_area = x.remote_area AND y.remote_area = x.local_area""", SESSIONS, LS)
def c1_adjacencies(a):
    links = linkstate.newest(a, "ls_links", LinkStateFilter()).withColumns({"local_node_key": linkstate.node_key("local_"), "remote_node_key": linkstate.node_key("remote_")})
    names = links.select(F.col("local_node_key").alias("key"), F.col("local_router_id").alias("id")).unionByName(links.select(F.col("remote_node_key").alias("key"), F.col("remote_router_id").alias("id"))).distinct()
    adj = linkstate.adjacencies(links)
    src, dst = (names.select(F.col("key").alias(c), F.col("id").alias(f"{c}_id")) for c in ("src", "dst"))
    return adj.join(src, "src").join(dst, "dst").select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.array_join("metrics", ",").alias("metrics"), "members", "one_sided")


@question("""SELECT router_id, max(adv) AS advertised, string_agg(DISTINCT collector_id, ',' ORDER BY collector_id) AS collectors FROM (SELECT collector_id, protocol, area, router_id, 1 AS adv FROM ln UNION ALL SELECT collector_id, protocol, local_area, local_router_id, 0 FROM ll
  UNION ALL SELECT collector_id, protocol, remote_area, remote_router_id, 0 FROM ll) GROUP BY protocol, area, router_id""", SESSIONS, LS)
def b12_graph_nodes(a):
    return linkstate.graph_nodes(a).select("router_id", "advertised", "collectors")


# --- liveness, names, scalars


@question(f"SELECT collector_id, router_ip FROM cur WHERE session_id >= epoch AND last_beat < {STALE} AND (collector_id, router_ip, session_id) IN (SELECT (collector_id, router_ip, session_id) FROM peer_up WHERE stored = 'up')", SESSIONS)
def q28_stale_pairs(a):
    return session.stale_pairs(a)


@question(f"""SELECT (SELECT max(beat_seen) FROM live WHERE collector_id = 'c0') AS has_beat, (SELECT max(last_beat) FROM live WHERE collector_id = 'c0') AS newest_beat, (SELECT max(epoch) FROM live WHERE collector_id = 'c0') AS newest_start,
  (SELECT count(*) FROM cur WHERE collector_id = 'c0' AND session_id >= epoch AND (collector_id, router_ip, session_id) IN (SELECT (collector_id, router_ip, session_id) FROM peer_up WHERE stored = 'up')) AS live_sessions, (SELECT max(last_beat) FROM live WHERE collector_id = 'c0') >= {STALE} AS beat_fresh""", SESSIONS)
def q29_target_liveness(a):
    return session.target_liveness(a, "c0")


@question("SELECT q.asn, coalesce(name, '') AS name, coalesce(country, '') AS country, CASE WHEN name IS NULL THEN 0 ELSE 1 END AS listed FROM (SELECT unnest([65001, 65002, 99]::BIGINT[]) AS asn) q LEFT JOIN asnames USING (asn)")
def q30_as_names(a):
    return lookup.names_of(a, [65001, 65002, 99])


@question("SELECT count(*) > 0 AS published, count(*) AS names FROM asnames")
def q30_names_published(a):
    return lookup.names_published(a)


@question("SELECT collector_id, router_ip, session_id, CAST(epoch(TIMESTAMP '2024-01-31 00:00:30') AS BIGINT) - CAST(floor(epoch(began)) AS BIGINT) AS age_s, reconnects FROM (SELECT collector_id, router_ip, max(session_id) AS session_id, count(DISTINCT session_id) - 1 AS reconnects FROM peer_events GROUP BY ALL) JOIN (SELECT collector_id, router_ip, session_id, min(ts_collector) AS began FROM peer_events GROUP BY ALL) USING (collector_id, router_ip, session_id)")
def b13_session_ages(a):
    return peers.session_ages(a)


@question("SELECT DISTINCT peer_ip, 2886729728 + 0 AS base, CASE WHEN prefix = '172.17.0.0/16' THEN 1 ELSE 0 END AS covered, '00000000000000000000ffff0a01' || lpad(lower(printf('%x', CAST(split_part(peer_ip, '.', 3) AS INT) * 256 + CAST(split_part(peer_ip, '.', 4) AS INT))), 4, '0') AS key FROM route_unicast")
def a11_address_keys(a):
    rows = a["route_unicast"].select("peer_ip", "prefix").distinct()
    return rows.select("peer_ip", addresses.v4_number(F.lit("172.16.0.0")).alias("base"), addresses.covers(F.col("prefix"), "172.17.3.4").cast("int").alias("covered"), F.lower(F.hex(addresses.key(F.col("peer_ip")))).alias("key")).distinct()


@question("SELECT DISTINCT CAST(communities[1] // 65536 AS VARCHAR) || ':' || CAST(communities[1] % 65536 AS VARCHAR) AS shown FROM route_unicast")
def a14_community_text(a):
    return a["route_unicast"].select(F.array_join(communities.shown("communities"), " ").alias("shown")).distinct()


@question("SELECT kind, down_reason AS code, CASE WHEN kind <> 'down' THEN '' ELSE ['local_notification', 'local_no_notification', 'remote_notification', 'remote_no_notification', 'de_configured', 'local_vrf_or_tlv'][down_reason] END AS reason, count(*) AS n FROM peer_events GROUP BY ALL")
def a20_down_reasons(a):
    e = a["peer_events"]
    return e.groupBy("kind", F.col("down_reason").alias("code"), down_reason(F.col("kind"), F.col("down_reason")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- dashboards


SEEN = "seen AS (SELECT collector_id, router_ip, peer_ip, rib, family, prefix, path_id, arg_max_null(as_path, stream_seq) AS as_path, arg_max_null(is_withdraw, stream_seq) AS w, arg_max_null(session_id, stream_seq) AS session_id, max(ts_collector) AS last_seen FROM (SELECT * REPLACE (CAST(epoch_us(ts_collector) AS HUGEINT) * 1000000000 + stream_seq AS stream_seq) FROM route_unicast) GROUP BY ALL),\nnb AS (SELECT DISTINCT prefix, asn, neighbour, direction FROM (SELECT prefix, as_path[i + 1] AS asn, as_path[i] AS neighbour, 'toward collector' AS direction FROM (SELECT *, unnest(range(1, len(as_path))) AS i FROM seen WHERE w = 0) UNION ALL SELECT prefix, as_path[i], as_path[i + 1], 'toward origin' FROM (SELECT *, unnest(range(1, len(as_path))) AS i FROM seen WHERE w = 0)) WHERE asn <> neighbour)"


@question("SELECT asn, originated, transited, routers, coalesce(neighbours, 0) AS neighbours FROM (SELECT asn, count(DISTINCT prefix) FILTER (WHERE asn = as_path[-1]) AS originated, count(DISTINCT prefix) FILTER (WHERE asn <> as_path[-1]) AS transited, count(DISTINCT router_ip) AS routers FROM (SELECT *, unnest(list_distinct(as_path)) AS asn FROM seen WHERE w = 0) GROUP BY asn) LEFT JOIN (SELECT asn, count(DISTINCT neighbour) AS neighbours FROM nb GROUP BY asn) USING (asn)", SEEN)
def b1_asn_table(a):
    return dashboards.asn_table(a)


@question("SELECT asn, neighbour, direction, count(*) AS prefixes FROM nb GROUP BY ALL", SEEN)
def b2_adjacent_asns(a):
    return dashboards.adjacent_asns(a)


@question(f"SELECT collector_id, prefix, CASE WHEN as_path[-1] = {THROUGH} THEN 'origin' ELSE 'transit' END AS role, array_to_string(as_path, ' ') AS path, peer_ip, rib, path_id, CASE WHEN w = 1 THEN 'withdrawn' ELSE 'advertised' END AS state, last_seen, CASE WHEN seen.session_id = sid THEN 1 ELSE 0 END AS session_current FROM seen LEFT JOIN (SELECT collector_id, router_ip, max(session_id) AS sid FROM peer_events GROUP BY ALL) USING (collector_id, router_ip) WHERE list_contains(as_path, {THROUGH})", SEEN)
def b2_asn_prefixes(a):
    rows = dashboards.newest_seen(a, Window()).where(F.array_contains("as_path", F.lit(THROUGH).cast("long")))
    role = F.when(F.try_element_at("as_path", F.lit(-1)) == THROUGH, "origin").otherwise("transit").alias("role")
    return dashboards.session_marked(a, rows).select("collector_id", "prefix", role, F.array_join("as_path", " ").alias("path"), "peer_ip", "rib", "path_id", dashboards.shown_state(), "last_seen", "session_current")


FLAPS = """flaps AS (SELECT *, coalesce(is_withdraw = 1 AND nw = 0 AND nt > ts_collector, false) AS is_flap FROM (SELECT *, lead(ts_collector) OVER w AS nt, lead(is_withdraw) OVER w AS nw, CASE route_type WHEN 2 THEN 'mac-ip ' || mac WHEN 3 THEN 'imet tag ' || ethernet_tag ELSE 'ip-prefix ' || prefix END AS route
  FROM route_evpn WINDOW w AS (PARTITION BY collector_id, router_ip, peer_ip, rib, route_type, rd, mac, ip, prefix, ethernet_tag, path_id ORDER BY ts_collector, stream_seq))),
gaps AS (SELECT *, CASE WHEN is_flap THEN (epoch_us(nt) - epoch_us(ts_collector)) // 1000 ELSE 0 END AS gap_ms FROM flaps)"""


@question("""SELECT routes, flapping, cycles, median_ms FROM (SELECT collector_id, count(*) AS obs, count(DISTINCT (route, rd, router_sysname)) AS routes, count(DISTINCT (route, rd, router_sysname)) FILTER (WHERE is_flap) AS flapping, count(*) FILTER (WHERE is_flap) AS cycles, CAST(coalesce(median(gap_ms) FILTER (WHERE is_flap), 0) AS DOUBLE) AS median_ms FROM gaps GROUP BY 1) ORDER BY obs DESC, collector_id DESC LIMIT 1""", FLAPS)
def b3_flap_summary(a):
    return dashboards.flap_summary(a)


@question("""SELECT route, rd, router_sysname, advertisements, withdrawals, flaps, away_ms, last_seen FROM (SELECT *, row_number() OVER (PARTITION BY route, rd, router_sysname ORDER BY obs DESC, collector_id DESC) AS n FROM (SELECT route, rd, router_sysname, collector_id, count(*) AS obs, count(*) FILTER (WHERE is_withdraw = 0) AS advertisements, count(*) FILTER (WHERE is_withdraw = 1) AS withdrawals,
  count(*) FILTER (WHERE is_flap) AS flaps, CAST(sum(gap_ms) AS BIGINT) AS away_ms, max(ts_collector) AS last_seen FROM gaps GROUP BY ALL)) WHERE n = 1 ORDER BY flaps DESC, withdrawals DESC, route, rd, router_sysname LIMIT 50""", FLAPS)
def b4_unstable_routes(a):
    return dashboards.unstable_routes(a)


@question("SELECT collector_id, route, rd, router_sysname, ts_collector AS withdrawn_at, nt AS returned_at, gap_ms, stream_seq FROM gaps WHERE is_flap ORDER BY gap_ms DESC, withdrawn_at DESC, stream_seq DESC LIMIT 50", FLAPS)
def b4_flap_cycles(a):
    return dashboards.flap_cycles(a)


@question(buckets_sql("obs", "'1 day'"), observed_sql(DAY, ("route_evpn",)))
def b5_evpn_churn(a):
    return churn.churn_buckets(a, DAY, 86400, ("route_evpn",))


@question(buckets_sql("obs", "'30 days'"), observed_sql(LONG, ("route_unicast",)))
def b9_unicast_churn(a):
    return churn.churn_buckets(a, LONG, 30 * 86400, ("route_unicast",))


VOBS = "vo AS (SELECT * FROM (SELECT *, first_value(collector_id) OVER (PARTITION BY family, rd, prefix, router_ip ORDER BY n DESC, collector_id DESC) AS best FROM (SELECT *, count(*) OVER (PARTITION BY family, rd, prefix, router_ip, collector_id) AS n FROM route_vpn)) WHERE collector_id = best)"


@question("SELECT family, rd, prefix, count(DISTINCT router_ip) AS routers, count(DISTINCT session_id) AS sessions, count(*) AS observations, count(*) FILTER (WHERE is_withdraw = 1) AS withdrawals, max(ts_collector) AS last_seen FROM vo GROUP BY ALL ORDER BY routers DESC, sessions DESC, observations DESC, prefix, rd, family LIMIT 50", VOBS)
def b10_top_vpn_prefixes(a):
    return dashboards.top_vpn_prefixes(a)


@question("SELECT family, rd, count(DISTINCT prefix) AS prefixes, count(DISTINCT router_ip) AS routers, count(DISTINCT session_id) AS sessions FROM vo GROUP BY ALL", VOBS)
def b10_top_rds(a):
    return dashboards.top_rds(a)


@question("SELECT count(DISTINCT (rd, prefix)) AS prefixes, count(DISTINCT rd) FILTER (WHERE rd <> '') AS rds, count(DISTINCT router_ip) AS routers, count(*) FILTER (WHERE is_withdraw = 1) AS withdrawals FROM vo", VOBS)
def b10_vpn_header(a):
    return dashboards.vpn_header(a)


@question("SELECT route_target, count(DISTINCT (rd, prefix)) AS prefixes, count(DISTINCT rd) AS rds, count(DISTINCT router_ip) AS routers FROM (SELECT rd, prefix, router_ip, unnest(route_targets) AS route_target FROM vo WHERE is_withdraw = 0) GROUP BY 1", VOBS)
def b6_route_targets(a):
    return dashboards.route_target_rollup(a)


@question("SELECT count(*) AS routes, count(DISTINCT prefix) AS prefixes, max(CAST(string_split(prefix, '/')[2] AS INTEGER)) AS most_specific, count(*) FILTER (WHERE seen.session_id <> sid) AS superseded FROM seen LEFT JOIN (SELECT collector_id, router_ip, max(session_id) AS sid FROM peer_events GROUP BY ALL) USING (collector_id, router_ip) WHERE prefix = '172.21.0.0/16'", SEEN)
def b7_looking_glass(a):
    return dashboards.looking_glass_summary(a, "172.21.200.9")


ANOMALIES = " UNION ALL ".join(f"SELECT '{t}' AS source, router_ip, session_id, collector_id, stream_seq, unnest(parse_flags) AS flag FROM {t}" for t in ("route_unicast", "route_vpn", "route_evpn", "ls_nodes", "ls_links", "ls_prefixes", "peer_events", "eor_events", "stats_events"))


@question(f"SELECT flag, source, count(DISTINCT stream_seq) AS messages, count(DISTINCT (collector_id, router_ip, session_id)) AS sessions, count(DISTINCT router_ip) AS routers FROM ({ANOMALIES}) GROUP BY ALL")
def b8_anomalies(a):
    return dashboards.anomalies(a)


@question("SELECT DISTINCT CASE route_type WHEN 2 THEN 'mac-ip ' || mac WHEN 3 THEN 'imet tag ' || ethernet_tag ELSE 'ip-prefix ' || prefix END AS route, CASE WHEN route_type = 2 THEN 'isis-l2' WHEN route_type = 3 THEN 'ospfv2' ELSE 'static' END AS proto FROM route_evpn")
def a19_descriptions(a):
    return a["route_evpn"].select(evpn_shown(F.col("route_type")).alias("route"), protocol(F.col("route_type")).alias("proto")).distinct()


# --- more panels

_NODE_SQL = "protocol, identifier, {s}asn, {s}bgpls_id, {s}area, {s}router_id"
OBJECT_SQL = {
    "route_unicast": "prefix", "route_vpn": "concat_ws('|', rd, prefix)", "route_evpn": "concat_ws('|', route_type, rd, mac, ip, prefix)", "ls_nodes": f"concat_ws('|', {_NODE_SQL.format(s='')})", "ls_links": f"concat_ws('|', {_NODE_SQL.format(s='local_')}, {_NODE_SQL.format(s='remote_').replace('protocol, identifier, ', '')})",
    "ls_prefixes": f"concat_ws('|', {_NODE_SQL.format(s='')}, prefix, prefix_len)", "peer_events": "concat_ws('|', router_ip, peer_ip)", "stats_events": "concat_ws('|', router_ip, peer_ip)", "eor_events": "concat_ws('|', peer_ip, rib, family)",
}
FLAG_ROWS = "fr AS (" + " UNION ALL ".join(f"SELECT unnest(parse_flags) AS flag, '{t}' AS source, '{'routes' if t.startswith('route_') or t == 'eor_events' else 'ls' if t.startswith('ls_') else 'stats' if t == 'stats_events' else 'peer'}' AS stream, stream_seq, router_ip, router_sysname, session_id, {o} AS object, ts_collector FROM {t}" for t, o in OBJECT_SQL.items()) + ")"


@question("SELECT flag, CASE WHEN router_sysname = '' THEN '(no sysName TLV)' ELSE router_sysname END AS platform, router_ip, count(DISTINCT object) AS affected, count(DISTINCT session_id) AS sessions, count(DISTINCT (stream, stream_seq)) AS events, count(DISTINCT source) AS in_tables, max(ts_collector) AS last_seen FROM fr GROUP BY ALL", FLAG_ROWS)
def b8_flags_by_platform(a):
    return dashboards.flags_by_platform(a)


@question(f"SELECT time_bucket(INTERVAL '6 hours', ts_collector, TIMESTAMP '1970-01-01') AS bucket, flag, count(DISTINCT (stream, stream_seq)) AS events FROM fr WHERE {window_sql(DAY)} GROUP BY ALL", FLAG_ROWS)
def b8_flags_over_time(a):
    return dashboards.flags_over_time(a, DAY, 6 * 3600)


def _stats_sql(kind: str, key: str) -> str:
    return f"SELECT '{kind}' AS kind, collector_id, count(DISTINCT ({key})) FILTER (WHERE session_id = sid) AS in_current_session, count(DISTINCT ({key})) FILTER (WHERE {window_sql(Window(datetime(2024, 1, 30), datetime(2024, 1, 31)))}) AS in_window FROM ls_{kind} JOIN now USING (collector_id) WHERE router_ip = '10.0.0.2' AND peer_ip = '10.1.0.7' GROUP BY 2"


NOW = "now AS (SELECT collector_id, max(session_id) AS sid FROM peer_events WHERE router_ip = '10.0.0.2' GROUP BY 1)"


@question(" UNION ALL ".join(_stats_sql(k, key) for k, key in (("nodes", "protocol, asn, area, router_id"), ("links", "protocol, local_area, local_router_id, remote_area, remote_router_id, local_ifaddr, remote_ifaddr, link_local_id, link_remote_id"), ("prefixes", "protocol, area, router_id, prefix, prefix_len"))), NOW)
def b11_link_state_stats(a):
    return dashboards.link_state_stats(a, "10.0.0.2", "10.1.0.7", Window(datetime(2024, 1, 30), datetime(2024, 1, 31)))


@question("""SELECT collector_id, CASE WHEN name <> '' THEN name WHEN v4 <> '' THEN v4 ELSE router_id END AS node, router_id, v4 AS router_id_v4, protocol, area, asn, base || '-' || (base + size - 1) AS srgb, last_seen FROM
  (SELECT n.collector_id, protocol, identifier, asn, bgpls_id, area, router_id, arg_max_null(is_withdraw, seq) AS w, arg_max_null(name, seq) AS name, arg_max_null(router_id_v4, seq) AS v4, arg_max_null(srgb_base, seq) AS base, arg_max_null(srgb_size, seq) AS size, max(ts_collector) AS last_seen
   FROM ls_nodes n JOIN now ON now.collector_id = n.collector_id AND now.sid = n.session_id WHERE router_ip = '10.0.0.2' AND peer_ip = '10.1.0.7' GROUP BY ALL) WHERE w IN (0, 1)""", NOW)
def b11_link_state_nodes(a):
    return dashboards.link_state_nodes(a, "10.0.0.2", "10.1.0.7", (0, 1)).drop("srlb", "sr_algorithms", "unknown_tlv_count")


COMPLETE = "spine AS (SELECT collector_id, router_sysname, router_ip, max(session_id) AS now, count(DISTINCT session_id) FILTER (WHERE " + window_sql(DAY) + ") AS sessions FROM peer_events GROUP BY 1, 2, 3)"


def _seen_sql(table: str, name: str, key: str) -> str:
    return f"{name} AS (SELECT l.collector_id, l.router_sysname, l.router_ip, count(DISTINCT ({key})) FILTER (WHERE session_id = now) AS {name}_current_session, count(DISTINCT ({key})) FILTER (WHERE {window_sql(DAY)}) AS {name}_in_window FROM {table} l JOIN spine s ON s.collector_id = l.collector_id AND s.router_sysname = l.router_sysname AND s.router_ip = l.router_ip GROUP BY 1, 2, 3)"


@question("""SELECT s.collector_id, s.router_sysname, s.router_ip, sessions, coalesce(nodes_current_session, 0) AS nodes_current_session, coalesce(nodes_in_window, 0) AS nodes_in_window, coalesce(edges_current_session, 0) AS edges_current_session, coalesce(edges_in_window, 0) AS edges_in_window
  FROM spine s LEFT JOIN nodes USING (collector_id, router_sysname, router_ip) LEFT JOIN edges USING (collector_id, router_sysname, router_ip)""", COMPLETE, _seen_sql("ls_nodes", "nodes", "protocol, asn, area, router_id"), _seen_sql("ls_links", "edges", "protocol, local_area, local_router_id, remote_area, remote_router_id"))
def b13_view_completeness(a):
    return dashboards.view_completeness(a, DAY)


# --- pages with totals


def page_of(name: str, order: str, limit: int) -> str:
    """The first rows of another question's SQL, with how many there are."""
    return f"SELECT *, count(*) OVER () AS total_matched FROM ({ORACLE_SQL[name]}) ORDER BY {order} LIMIT {limit}"


def page(of: str, report: str, order: str, limit: int) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: results.with_total(f(bridge(spark, sf_dir)), results.order_of(report), limit)
        ORACLE_SQL[f.__name__] = page_of(of, order, limit)
        return f

    return add


@page("q16_dump_counts", "dumps", "archived DESC, router_ip", 3)
def w3_dump_counts_page(a):
    return churn.dump_counts(a, LONG)


@page("q17_session_counts", "sessions", "sessions DESC, router_ip", 2)
def w3_session_counts_page(a):
    return churn.session_counts(a, DAY)


@page("q18_locrib_comparison", "locrib", "archived DESC, router_ip, CAST(split_part(peer_ip, '.', 4) AS INTEGER)", 7)
def w3_locrib_page(a):
    return churn.locrib_comparison(a)


@page("q19_flag_counts", "flags", "envelopes DESC, flag", 2)
def w3_flag_counts_page(a):
    return churn.flag_counts(a)


# --- a log delivered twice must not change an answer


def twice(a: Archive) -> Archive:
    """The archive with every row of history redelivered."""
    return replace(a, tables={n: rows if n in ("asnames", "collector_beats") else rows.unionByName(rows) for n, rows in a.tables.items()})


def unchanged(of: str, ask: Callable[[Archive], DataFrame]) -> None:
    name = f"t1_{of}_redelivered"
    QUERIES[name] = lambda spark, sf_dir: ask(twice(bridge(spark, sf_dir)))
    ORACLE_SQL[name] = ORACLE_SQL[of]


unchanged("q1_routes", lambda a: route_out(routes.current_routes(a, RouteFilter(prefix="172.18.0.0/16"))))
unchanged("q16_dump_counts", lambda a: churn.dump_counts(a, LONG))
unchanged("q17_session_counts", lambda a: churn.session_counts(a, DAY))
unchanged("q19_flag_counts", churn.flag_counts)
unchanged("q20_churn_buckets", lambda a: churn.churn_buckets(a, DAY, 6 * 3600))


# --- best observers, choices, what the log lacks


@question("""SELECT router_ip, sysname, collector_id, up, down, view_lost, stale FROM (SELECT *, row_number() OVER (PARTITION BY router_ip ORDER BY CASE WHEN stale > 0 THEN 1 WHEN up + down > 0 THEN 2 ELSE 0 END DESC, up + down + view_lost + stale DESC, collector_id DESC) AS place
  FROM rs JOIN rp USING (collector_id, router_ip, session_id)) WHERE place = 1""", SESSIONS, ROUTERS)
def c4_best_routers(a):
    return peers.best_routers(a).select("router_ip", "sysname", "collector_id", "up", "down", "view_lost", "stale")


@question(f"SELECT router_ip, max(downs) AS downs FROM (SELECT router_ip, collector_id, count(*) FILTER (WHERE kind = 'down') AS downs FROM peer_events WHERE {window_sql(DAY)} GROUP BY ALL) GROUP BY 1")
def c4_best_down_counts(a):
    return peers.best_counts(a.scan("peer_events", *DAY.bounds()), ["router_ip"], F.count_if(F.col("kind") == "down"), "downs")


CHOSEN = """chosen AS (SELECT * FROM route_vpn WHERE regexp_full_match(rib, 'in_.*') AND family IN ('vpn4', 'vpn6') AND rd IN ('65000:1', '65000:2', '65000:5'))"""


@question("SELECT count(DISTINCT (family, rd, prefix, router_ip)) AS routes, count(DISTINCT rd) FILTER (WHERE rd <> '') AS vrfs, count(DISTINCT router_ip) AS routers, CAST(count(*) FILTER (WHERE family <> 'lu4' AND len(route_targets) = 0) AS BIGINT) AS no_route_target, (SELECT count(DISTINCT t) FROM (SELECT unnest(route_targets) AS t FROM chosen)) AS targets FROM chosen", CHOSEN)
def f15_vpn_choices(a):
    return dashboards.vpn_routes_header(a, ribs=["in_.*"], families=["vpn4", "vpn6"], rds=["65000:1", "65000:2", "65000:5"])


DELIVERED = "delivered AS (" + " UNION ".join(f"SELECT '{s}' AS stream, stream_seq FROM {t}" for t, s in (("route_unicast", "routes"), ("route_vpn", "routes"), ("route_evpn", "routes"), ("ls_nodes", "ls"), ("ls_links", "ls"), ("ls_prefixes", "ls"), ("peer_events", "peer"), ("eor_events", "routes"), ("stats_events", "stats"))) + ")"
GAPS = "gaps AS (SELECT stream, after, before, before - after - 1 AS missing FROM (SELECT stream, lag(stream_seq) OVER (PARTITION BY stream ORDER BY stream_seq) AS after, stream_seq AS before FROM delivered) WHERE before - after > 1)"


@question("SELECT * FROM gaps", DELIVERED, GAPS)
def t11_gaps(a):
    return lag.gaps(a, stretch=500)


@question("SELECT stream, first, last, archived, last - first + 1 - archived AS missing, coalesce(gaps, 0) AS gaps, 0::BIGINT AS redelivered FROM (SELECT stream, min(stream_seq) AS first, max(stream_seq) AS last, count(*) AS archived FROM delivered GROUP BY 1) LEFT JOIN (SELECT stream, count(*) AS gaps FROM gaps GROUP BY 1) USING (stream)", DELIVERED, GAPS)
def t11_accounts(a):
    return lag.accounts(a)


QUERIES |= wire_queries.QUERIES
ORACLE_SQL |= wire_queries.ORACLE_SQL
