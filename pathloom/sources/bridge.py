"""A logical archive projected from general tables (orders, events, supplier, ...), for tests and benchmarks.

Each projection is a list of expressions that Spark and DuckDB both read, so an oracle can use the same one; `{arr}`
stands for the array constructor and `{map8}` for a counter map of one entry.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from pathloom.archive import Archive

AS_OF = datetime(2024, 1, 31, 0, 0, 30)
_RIB = "CASE {k} % 3 WHEN 0 THEN 'in_pre' WHEN 1 THEN 'in_post' ELSE 'loc_rib' END"


def _envelope(k: str, seq: str, ts: str, session: str, flags: str) -> dict[str, str]:
    return {
        "collector_id": f"'c' || CAST({seq} % 2 AS STRING)",
        "router_ip": f"'10.0.0.' || CAST({k} % 5 AS STRING)",
        "router_sysname": f"'r' || CAST({k} % 5 AS STRING)",
        "peer_ip": f"'10.1.0.' || CAST({k} % 20 AS STRING)",
        "rib": _RIB.format(k=k),
        "peer_asn": f"65000 + {k} % 20",
        "peer_bgp_id": f"'10.254.0.' || CAST({k} % 20 AS STRING)",
        "session_id": session,
        "seq": seq,
        "ts_router": ts,
        "ts_collector": ts,
        "parse_flags": flags,
        "stream_seq": seq,
    }


_DAY = "CAST(1 + floor((day(ts) - 1) / 8) AS BIGINT)"
_ORDER = "CAST(1 + floor(o_orderkey / 2) AS BIGINT) % 4 + 1"
_EVENT_FLAGS = "CASE WHEN event_id % 11 = 0 THEN {arr}('as4_path', 'treat_as_withdraw') WHEN event_id % 7 = 0 THEN {arr}('as4_path') ELSE {none} END"
_ORDER_FLAGS = "CASE WHEN substring(o_orderpriority, 1, 1) = '1' THEN {arr}('addpath_heuristic', 'as4_path') WHEN substring(o_orderpriority, 1, 1) = '2' THEN {arr}('attr_discard') ELSE {none} END"
_ATTRIBUTES = {
    "origin": "CAST(o_orderkey % 3 AS TINYINT)",
    "as_path": "{arr}(65000 + o_custkey % 20, 64500 + CAST(floor(o_orderkey / 3) AS BIGINT) % 7, 64500 + CAST(floor(o_orderkey / 3) AS BIGINT) % 7, 64600 + o_custkey % 11)",
    "next_hop": "'10.2.0.' || CAST(o_custkey % 200 AS STRING)",
    "med": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey % 100 END",
    "local_pref": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 100 + o_orderkey % 10 END",
    "communities": "{arr}(CAST(65000 AS BIGINT) * 65536 + o_orderkey % 5)",
    "ext_communities": "{arr}('rt:65000:' || CAST(o_custkey % 3 AS STRING))",
    "route_targets": "{arr}('65000:' || CAST(o_custkey % 3 AS STRING))",
    "large_communities": "{arr}('65000:1:' || CAST(o_orderkey % 4 AS STRING))",
}
_PREFIX = "'172.' || CAST(16 + CAST(floor(o_custkey / 20) AS BIGINT) % 8 AS STRING) || '.0.0/16'"
_GONE = "CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END"
_SUPPLIER = _envelope("s_suppkey", "s_suppkey", "TIMESTAMP '2024-01-30 00:00:00'", "CASE WHEN s_suppkey % 9 = 0 THEN CAST(3 AS BIGINT) ELSE CAST(4 AS BIGINT) END", "CASE WHEN s_suppkey % 8 = 0 THEN {arr}('ls_unknown_tlv') ELSE {none} END")
_NODE = {"protocol": "CAST(1 + s_nationkey % 2 AS TINYINT)", "identifier": "CAST(0 AS DECIMAL(20,0))"}
_ID = "'00000000' || lpad(CAST({n} AS STRING), 4, '0')"
_FAR = "(s_nationkey * 7 + 3) % 25"

#: table: (source, condition, projection)
BRIDGE: dict[str, tuple[str, str, dict[str, str]]] = {
    "peer_events": ("events", "true", _envelope("user_id", "event_id", "ts", _DAY, _EVENT_FLAGS) | {
        "kind": "CASE event_type WHEN 'error' THEN 'down' WHEN 'purchase' THEN 'view_lost' ELSE 'up' END",
        "local_ip": "'10.5.0.1'", "local_port": "CAST(179 AS INT)", "remote_port": "CAST(1024 + user_id AS INT)",
        "down_reason": "CASE WHEN event_type = 'error' THEN 1 + event_id % 6 ELSE 0 END",
        "hold_time": "CAST(90 + event_id % 3 * 30 AS INT)", "hold_time_seen": "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END",
        "mp_families": "{arr}('ipv4u', 'evpn')", "addpath_families": "{arr}('ipv4u')",
        "sys_descr": "CASE WHEN event_type = 'signup' THEN 'Router OS ' || CAST(event_id % 4 AS STRING) ELSE '' END",
    }),
    "eor_events": ("events", "event_type = 'signup' AND user_id % 4 < 3", _envelope("user_id", "event_id", "ts", _DAY, "{none}") | {"family": "CASE event_id % 4 WHEN 0 THEN 'ipv4u' WHEN 1 THEN 'vpn4' WHEN 2 THEN 'ls' ELSE 'evpn' END"}),
    "route_unicast": ("orders", "true", _envelope("o_custkey", "o_orderkey", "o_orderdate", _ORDER, _ORDER_FLAGS) | {"family": "'ipv4u'", "prefix": _PREFIX, "path_id": "o_orderkey % 2", "is_withdraw": _GONE} | _ATTRIBUTES),
    "route_vpn": ("orders", "true", _envelope("o_custkey", "o_orderkey", "o_orderdate", _ORDER, "{none}") | {"family": "'vpn4'", "rd": "'65000:' || CAST(o_custkey % 6 AS STRING)", "prefix": _PREFIX, "path_id": "CAST(0 AS BIGINT)", "is_withdraw": _GONE, "labels": "{arr}(CASE WHEN o_orderkey % 3 = 0 THEN CAST(524288 AS BIGINT) ELSE 16 + o_orderkey % 1000 END)"} | _ATTRIBUTES),
    "route_evpn": ("events", "true", _envelope("user_id", "event_id", "ts", _DAY, _EVENT_FLAGS) | {
        "route_type": "CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 3 ELSE 5 END", "rd": "'65000:' || CAST(user_id % 4 AS STRING)",
        "prefix": "CASE WHEN user_id % 3 = 2 THEN '10.9.' || CAST(user_id % 50 AS STRING) || '.0/24' ELSE '' END",
        "mac": "CASE WHEN user_id % 3 = 0 THEN 'aa:bb:cc:00:00:' || lpad(CAST(user_id % 90 AS STRING), 2, '0') ELSE '' END", "ip": "''", "gateway_ip": "''",
        "ethernet_tag": "CAST(CASE WHEN user_id % 3 = 1 THEN user_id % 7 ELSE 0 END AS BIGINT)", "esi": "''", "labels": "{arr}(event_id % 500)", "path_id": "CAST(0 AS BIGINT)",
        "is_withdraw": "CASE WHEN event_type IN ('error', 'purchase') THEN 1 ELSE 0 END",
    } | {k: v.replace("o_orderkey", "event_id").replace("o_custkey", "user_id") for k, v in _ATTRIBUTES.items()}),
    "stats_events": ("events", "event_type = 'click'", _envelope("user_id", "event_id", "ts", _DAY, "{none}") | {"counters": "{map8}(CAST(event_id % 700 AS DECIMAL(20,0)))"}),
    "ls_nodes": ("supplier", "true", _SUPPLIER | _NODE | {
        "asn": "CAST(65000 AS BIGINT)", "bgpls_id": "CAST(0 AS BIGINT)", "area": "CAST(s_nationkey % 2 AS BIGINT)", "router_id": _ID.format(n="s_nationkey"), "router_id_v4": "CASE WHEN s_nationkey % 4 = 0 THEN '' ELSE '10.255.0.' || CAST(s_nationkey AS STRING) END",
        "is_withdraw": "CASE WHEN s_suppkey % 6 = 0 THEN 1 ELSE 0 END", "name": "CASE WHEN s_nationkey % 3 = 0 THEN '' ELSE 'node' || CAST(s_nationkey AS STRING) END", "srgb_base": "CAST(16000 AS BIGINT)", "srgb_size": "CAST(8000 AS BIGINT)",
    }),
    "ls_links": ("supplier", "true", _SUPPLIER | _NODE | {
        "local_asn": "CAST(65000 AS BIGINT)", "local_bgpls_id": "CAST(0 AS BIGINT)", "local_area": "CAST(s_nationkey % 2 AS BIGINT)", "local_router_id": _ID.format(n="s_nationkey"),
        "remote_asn": "CAST(65000 AS BIGINT)", "remote_bgpls_id": "CAST(0 AS BIGINT)", "remote_area": f"CAST({_FAR} % 2 AS BIGINT)", "remote_router_id": _ID.format(n=_FAR),
        "local_ifaddr": "'10.3.0.' || CAST(s_suppkey % 50 AS STRING)", "remote_ifaddr": "'10.3.1.' || CAST(s_suppkey % 50 AS STRING)", "link_local_id": "CAST(s_suppkey % 2 AS BIGINT)", "link_remote_id": "CAST(0 AS BIGINT)",
        "is_withdraw": "CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END", "igp_metric": "CAST(10 + s_suppkey % 5 AS BIGINT)", "max_bandwidth": "CAST(1000 AS FLOAT)",
    }),
    "ls_prefixes": ("supplier", "true", _SUPPLIER | _NODE | {
        "asn": "CAST(65000 AS BIGINT)", "bgpls_id": "CAST(0 AS BIGINT)", "area": "CAST(s_nationkey % 2 AS BIGINT)", "router_id": _ID.format(n="s_nationkey"), "prefix": "'10.4.' || CAST(s_suppkey % 40 AS STRING) || '.0'", "prefix_len": "CAST(24 AS INT)",
        "is_withdraw": "CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END", "prefix_sid": "CAST(s_suppkey % 40 AS BIGINT)", "has_prefix_sid": "CAST(1 AS INT)", "prefix_metric": "CAST(s_suppkey % 9 AS BIGINT)",
    }),
    "collector_beats": ("region", "r_regionkey < 2", {"collector_id": "'c' || CAST(r_regionkey AS STRING)", "started_at": "CAST(1 AS BIGINT)", "beat_at": "TIMESTAMP '2024-01-30 23:50:00'", "inserted_at": "CASE WHEN r_regionkey = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE TIMESTAMP '2024-01-30 23:50:00' END"}),
    "asnames": ("nation", "true", {"asn": "CAST(65000 + n_nationkey AS BIGINT)", "name": "n_name", "country": "'C' || CAST(n_regionkey AS STRING)"}),
}


def bridge(spark: SparkSession, sf_dir: str) -> Archive:
    def project(name: str) -> DataFrame:
        source, condition, columns = BRIDGE[name]
        own = {"arr": "array", "none": "cast(array() as array<string>)"}
        shown = [e.replace("{map8}(", "map(CAST(8 AS BIGINT), ").format(**own) + f" AS {c}" for c, e in columns.items()]
        return spark.read.parquet(f"{sf_dir}/{source}.parquet").where(condition).selectExpr(*shown)

    return Archive({name: project(name) for name in BRIDGE}, AS_OF)


def oracle_ctes() -> str:
    """The same tables as CTEs for DuckDB."""

    def cte(name: str) -> str:
        source, condition, columns = BRIDGE[name]
        shown = ", ".join(e.replace("{map8}(CAST(event_id % 700 AS DECIMAL(20,0)))", "event_id % 700").format(arr="list_value", none="CAST([] AS VARCHAR[])") + f" AS {c}" for c, e in columns.items())
        return f"{name} AS (SELECT {shown} FROM {source} WHERE {condition})"

    return ",\n".join(map(cte, BRIDGE))
