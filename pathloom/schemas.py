"""Table schemas, identities and enumerations: the one place that defines them."""

from __future__ import annotations

ENVELOPE = "collector_id string, router_ip string, router_sysname string, peer_ip string, rib string, peer_asn long, peer_bgp_id string, session_id long, seq long, ts_router timestamp, ts_collector timestamp, parse_flags array<string>, stream_seq long"
ATTRIBUTES = "origin byte, as_path array<long>, next_hop string, med long, local_pref long, communities array<long>, ext_communities array<string>, route_targets array<string>, large_communities array<string>"
NODE = "protocol byte, identifier decimal(20,0), asn long, bgpls_id long, area long, router_id string"

_TABLES = {
    "route_unicast": f"family string, prefix string, path_id long, is_withdraw int, {ATTRIBUTES}",
    "route_vpn": f"family string, rd string, prefix string, path_id long, is_withdraw int, labels array<long>, {ATTRIBUTES}",
    "route_evpn": f"route_type int, rd string, prefix string, mac string, ip string, gateway_ip string, ethernet_tag long, esi string, labels array<long>, path_id long, is_withdraw int, {ATTRIBUTES}",
    "ls_events": "family string, raw_reach binary, raw_unreach binary, end_of_rib byte",
    "ls_nodes": f"{NODE}, router_id_v4 string, is_withdraw int, name string, srgb_base long, srgb_size long, srlb_base long, srlb_size long, sr_algorithms array<int>, unknown_tlvs map<int,binary>",
    "ls_links": "protocol byte, identifier decimal(20,0), local_asn long, local_bgpls_id long, local_area long, local_router_id string, remote_asn long, remote_bgpls_id long, remote_area long, remote_router_id string, local_ifaddr string, remote_ifaddr string, link_local_id long, link_remote_id long, is_withdraw int, adj_sids array<long>, adj_flags array<int>, adj_weights array<int>, te_metric long, igp_metric long, admin_group long, max_bandwidth float, unknown_tlvs map<int,binary>",
    "ls_prefixes": f"{NODE}, prefix string, prefix_len int, is_withdraw int, prefix_sid long, prefix_sid_flags int, has_prefix_sid int, prefix_metric long, prefix_attr_flags int, ospf_route_type int, unknown_tlvs map<int,binary>",
    "peer_events": "kind string, local_ip string, local_port int, remote_port int, down_reason long, cap_four_byte_as byte, hold_time int, hold_time_seen int, mp_families array<string>, addpath_families array<string>, sys_descr string",
    "eor_events": "family string",
    "stats_events": "counters map<long,decimal(20,0)>",
}
DDL = {name: f"{ENVELOPE}, {more}" for name, more in _TABLES.items()} | {
    "collector_beats": "collector_id string, started_at long, beat_at timestamp, inserted_at timestamp",
    "asnames": "asn long, name string, country string",
}
SCHEMA_VERSION = 2

OBSERVER = ["collector_id", "router_ip", "peer_ip", "rib"]
NODE_KEY = ["protocol", "identifier", "asn", "bgpls_id", "area", "router_id"]
#: What makes two observations the same object, table by table.
IDENTITY = {
    "route_unicast": [*OBSERVER, "family", "prefix", "path_id"],
    "route_vpn": [*OBSERVER, "family", "rd", "prefix", "path_id"],
    "route_evpn": [*OBSERVER, "route_type", "rd", "prefix", "mac", "ip", "ethernet_tag", "esi", "path_id"],
    "ls_nodes": [*OBSERVER, *NODE_KEY],
    "ls_links": [*OBSERVER, "protocol", "identifier", *(f"{side}_{c}" for side in ("local", "remote") for c in NODE_KEY[2:]), "local_ifaddr", "remote_ifaddr", "link_local_id", "link_remote_id"],
    "ls_prefixes": [*OBSERVER, *NODE_KEY, "prefix", "prefix_len"],
    "peer_events": OBSERVER,
    "eor_events": [*OBSERVER, "family"],
}
ROUTES = ("route_unicast", "route_vpn", "route_evpn")


def stream_of(table: str) -> str:
    """The log's stream whose messages leave rows in a table: End-of-RIB markers come with the routes."""
    return "routes" if table in (*ROUTES, "eor_events") else "ls" if table.startswith("ls_") else "stats" if table == "stats_events" else "peer"


FLAGGED = (*ROUTES, "ls_events", "ls_nodes", "ls_links", "ls_prefixes", "peer_events", "eor_events", "stats_events")

#: Numeric order of the ribs, link-state protocols, peer-down reasons.
RIBS = {"in_pre": 0, "in_post": 1, "out_pre": 2, "out_post": 3, "loc_rib": 4}
PROTOCOLS = {1: "isis-l1", 2: "isis-l2", 3: "ospfv2", 4: "direct", 5: "static", 6: "ospfv3", 7: "bgp"}
FAMILIES = ("ipv4u", "ipv6u", "lu4", "vpn4", "vpn6", "evpn", "ls")
NO_LABEL = 524288
EVPN_TYPES = range(1, 12)
SERVED = ("up", "stale")
