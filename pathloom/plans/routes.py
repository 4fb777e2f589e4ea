"""Current routes, route history, and walks of a RIB."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pathloom.archive import Archive
from pathloom.functions.communities import BadFilter
from pathloom.functions.names import origin_asn, rib_order, vpn_label
from pathloom.operators.dumps import dump_state, markers
from pathloom.operators.latest import latest
from pathloom.operators.session import PAIR, current, peer_state, served
from pathloom.plans.filters import RouteFilter, Window, all_of, one_text
from pathloom.schemas import IDENTITY

ATTRIBUTES = ["origin", "as_path", "next_hop", "med", "local_pref", "communities", "ext_communities", "route_targets", "large_communities"]
EXTRA = {"route_unicast": [], "route_vpn": ["labels"], "route_evpn": ["labels", "gateway_ip"]}
#: Keyset order of a walk: numeric rib first, then what names a route within a peer.
WALK = {"route_unicast": ["family", "prefix", "path_id"], "route_vpn": ["rd", "family", "prefix", "path_id"], "route_evpn": ["route_type", "rd", "prefix", "mac", "ip", "ethernet_tag", "esi", "path_id"]}
PAGE, MOST = 1000, 10_000


class SessionChanged(RuntimeError):
    """The walk's session is no longer the current one."""


def live_routes(archive: Archive, table: str, filters: RouteFilter, semi_join: bool = True, only: DataFrame | None = None, columns: list[str] | None = None) -> DataFrame:
    """The newest observation of each route of the current sessions of served peers, unless it is a withdrawal.

    Attribute conditions hold of the newest observation, so they come after the aggregation; with `semi_join` they
    first pick, from raw observations, the keys that can match at all, which spares the aggregation the others.
    `only`: a page's keys, a bounded number, to which rows are held first. `columns`: the attributes wanted."""
    key = IDENTITY[table]
    rows = archive.newest(table, *(one_text(a) for a in (filters.router_ip, filters.peer_ip)))
    if (narrow := all_of(filters.narrow())) is not None:
        rows = rows.where(narrow)
    if only is not None:
        rows = rows.join(F.broadcast(only), all_of([rows[k].eqNullSafe(only[k]) for k in key]), "left_semi")
    wide = all_of(filters.wide())
    columns = ["is_withdraw", *(ATTRIBUTES + EXTRA[table] if columns is None else columns)]
    if table in archive.current:  # a row is the newest of its key already
        rows = rows.where("is_withdraw = 0") if wide is None else rows.where(F.col("is_withdraw") == 0).where(wide)
        return rows.join(served(archive), [*PAIR, "peer_ip", "session_id"], "left_semi").select(*key, "session_id", *columns)
    scoped = rows.join(served(archive), [*PAIR, "peer_ip", "session_id"], "left_semi")
    if wide is not None and semi_join:  # the candidates need no gate: the rows they pick have it
        scoped = scoped.join(rows.where(wide).select(*key).distinct(), key, "left_semi")
    newest = latest(scoped, [*key, "session_id"], columns).where("is_withdraw = 0")
    return newest if wide is None else newest.where(wide)


def decorated(archive: Archive, table: str, routes: DataFrame) -> DataFrame:
    """Routes with sysname, peer state and dump state; never drops a row."""
    if "family" not in routes.columns:
        routes = routes.withColumn("family", F.lit("evpn"))
    states = peer_state(archive).select(*PAIR, "peer_ip", "rib", "session_id", "state", F.col("router_sysname").alias("sysname"))
    marked = routes.join(states, [*PAIR, "peer_ip", "rib", "session_id"], "left").join(markers(archive), [*PAIR, "peer_ip", "rib", "session_id", "family"], "left")
    out = marked.withColumns({"dump_state": dump_state(), "origin_asn": origin_asn(), "sysname": F.coalesce("sysname", F.lit(""))}).drop("state", "marked", "is_withdraw")
    return out.withColumn("label", vpn_label()) if table == "route_vpn" else out


def current_routes(archive: Archive, filters: RouteFilter, table: str = "route_unicast", semi_join: bool = True) -> DataFrame:
    """What is routed now, by which peers, with dump state."""
    if table != "route_unicast" and not (filters.narrowed() or filters.wide()):
        raise BadFilter("VPN and EVPN routes need a narrowing condition")
    if table == "route_unicast" and filters.prefix is None and filters.covers is None and not filters.wide():
        filters = RouteFilter(**{**filters.__dict__, "prefix": ""})
    return decorated(archive, table, live_routes(archive, table, filters, semi_join))


def count_routes(archive: Archive, filters: RouteFilter, table: str = "route_unicast") -> DataFrame:
    return live_routes(archive, table, filters).agg(F.count(F.lit(1)).alias("total"))


def all_routes(archive: Archive, filters: RouteFilter) -> DataFrame:
    """Unicast, VPN and EVPN routes in one table, `kind` tells which."""
    parts = [decorated(archive, t, live_routes(archive, t, filters)).withColumn("kind", F.lit(t.removeprefix("route_"))) for t in IDENTITY if t.startswith("route_")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def route_history(archive: Archive, prefix: str, window: Window = Window(), table: str = "route_unicast") -> DataFrame:
    """Every distinct observation of a prefix, newest first; a redelivered one counts once."""
    rows = archive.scan(table, *window.bounds()).where(F.col("prefix") == prefix)
    columns = ["ts_collector", "ts_router", "seq", "stream_seq", "session_id", *IDENTITY[table], "next_hop", "as_path"]
    action = F.when(F.col("is_withdraw") == 1, "withdraw").otherwise("announce").alias("action")
    return rows.select(*columns, action).distinct().orderBy(F.desc("ts_collector"), F.desc("seq"), F.desc("stream_seq"))


@dataclass(frozen=True)
class Cursor:
    """Where a walk is: bound to its table, router, peer, collector and session."""

    table: str
    router_ip: str
    peer_ip: str
    collector_id: str
    session_id: int
    last: tuple | None = None

    def encode(self) -> str:
        return base64.urlsafe_b64encode(json.dumps(self.__dict__ | {"last": list(self.last) if self.last else None}).encode()).decode()

    @staticmethod
    def decode(text: str) -> Cursor:
        try:
            d = json.loads(base64.urlsafe_b64decode(text.encode()))
            last = d["last"]
            if last is not None and [type(x) for x in last] != [int, *(int if c in ("path_id", "route_type", "ethernet_tag") else str for c in WALK[d["table"]])]:
                raise BadFilter("cursor holds another key")
            return Cursor(d["table"], d["router_ip"], d["peer_ip"], d["collector_id"], int(d["session_id"]), None if last is None else tuple(last))
        except (ValueError, KeyError, TypeError) as e:
            raise BadFilter("not a cursor") from e


def start_walk(archive: Archive, router_ip: str, peer_ip: str, collector_id: str | None = None, table: str = "route_unicast") -> Cursor:
    """Pins the collector and session; refuses when several collectors see the router and none is named."""
    found = current(archive).where(F.col("router_ip") == router_ip)
    rows = (found if collector_id is None else found.where(F.col("collector_id") == collector_id)).select("collector_id", "session_id").limit(3).collect()
    if len(rows) != 1:
        raise BadFilter("no such session" if not rows else "several collectors see this router: name one")
    return Cursor(table, router_ip, peer_ip, rows[0]["collector_id"], rows[0]["session_id"])


def walk_page(archive: Archive, cursor: Cursor, limit: int = PAGE) -> tuple[DataFrame, Cursor | None]:
    """A page in keyset order and the cursor of the next one, if there is one (told by one row more). The page's keys are
    found first, from narrow columns only, and taken to the driver (MOST and one at most); attributes are then read for
    those keys alone, from the prefixes between the page's first and last."""
    limit = min(max(1, limit), MOST)
    filters = RouteFilter(collector_id=cursor.collector_id, router_ip=cursor.router_ip, peer_ip=cursor.peer_ip)
    key = IDENTITY[cursor.table]
    keyed = walk_order(live_routes(archive, cursor.table, filters, columns=[]).where(F.col("session_id") == cursor.session_id), cursor.table)
    if cursor.last is not None:
        keyed = keyed.where(F.col("_key") > F.struct(*(F.lit(v).cast(t) for v, t in zip(cursor.last, _types(keyed), strict=True))))
    rows = keyed.orderBy("_key").limit(limit + 1).select(*key, "_key").collect()
    keys = [tuple(r["_key"]) for r in rows]
    now = current(archive).where((F.col("collector_id") == cursor.collector_id) & (F.col("router_ip") == cursor.router_ip)).select("session_id").first()
    if now is None or now["session_id"] != cursor.session_id:
        raise SessionChanged("the session was superseded during the walk")
    more = Cursor(**{**cursor.__dict__, "last": keys[limit - 1]}) if len(keys) > limit else None
    kinds = {f.name: f.dataType for f in keyed.schema}
    spark, own = archive.tables[cursor.table].sparkSession, [r[:-1] for r in rows[:limit]]
    wanted = spark.createDataFrame(own, StructType([StructField(k, kinds[k]) for k in key]))
    prefixes = [r[key.index("prefix")] for r in own if r[key.index("prefix")] is not None]
    within = F.col("prefix").between(min(prefixes), max(prefixes)) | F.col("prefix").isNull() if prefixes else F.lit(True)
    page = live_routes(archive, cursor.table, filters, only=wanted).where(F.col("session_id") == cursor.session_id).where(within)
    return walk_order(decorated(archive, cursor.table, page), cursor.table).orderBy("_key").drop("_key"), more


def walk_order(routes: DataFrame, table: str) -> DataFrame:
    return routes.withColumn("_key", F.struct(rib_order(F.col("rib")).alias("rib"), *WALK[table]))


def _types(keyed: DataFrame) -> list[str]:
    return [f.dataType.simpleString() for f in keyed.schema["_key"].dataType.fields]
