"""The AS-path graph, and graph operations on edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.archive import Archive
from pathloom.functions.communities import BadFilter
from pathloom.operators.latest import order
from pathloom.operators.session import PAIR, served
from pathloom.plans.filters import RouteFilter, all_of
from pathloom.schemas import IDENTITY


def path_edges(path: Column) -> Column:
    """Distinct pairs of consecutive ASes; prepending gives none."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.struct(F.get(path, i - 1).alias("src"), F.get(path, i).alias("dst")))
    return F.when(F.size(path) > 1, F.array_distinct(F.filter(pairs, lambda e: e["src"] != e["dst"]))).otherwise(F.array().cast("array<struct<src:bigint,dst:bigint>>"))


def topology_routes(archive: Archive, filters: RouteFilter, table: str = "route_unicast") -> DataFrame:
    """Per route (observer included): its last advertised path, whether it is live, when first seen. Withdrawn routes
    stay in the graph. A scope is needed; without prefix the condition is left out."""
    if not (filters.narrowed() or filters.wide()):
        raise BadFilter("the graph needs a scope")
    key = IDENTITY[table]
    rows = archive[table]
    if (narrow := all_of(filters.narrow())) is not None:
        rows = rows.where(narrow)
    scoped = rows.join(served(archive), [*PAIR, "peer_ip", "session_id"], "left_semi")
    advertised = F.when(F.col("is_withdraw") == 0, order())
    carried = ["as_path", "communities", "ext_communities", "route_targets", "large_communities"]
    routes = scoped.groupBy(*key).agg(F.max_by(F.struct(*carried), advertised).alias("_a"), F.max_by("is_withdraw", order()).alias("withdrawn"), F.first("peer_asn").alias("peer_asn"), F.min("ts_collector").alias("first_seen"))
    out = routes.where("size(_a.as_path) > 0").select(*key, "_a.*", "peer_asn", (1 - F.col("withdrawn")).alias("live"), "first_seen")
    wide = all_of(filters.wide())
    return out if wide is None else out.where(wide)


def route_key(table: str) -> Column:
    """A route of the network: its identity without the collector."""
    return F.struct(*(k for k in IDENTITY[table] if k != "collector_id"))


def edges(routes: DataFrame, table: str = "route_unicast") -> DataFrame:
    each = routes.select(route_key(table).alias("route"), "live", "first_seen", F.explode(path_edges(F.col("as_path"))).alias("e"))
    # one row an edge and route first: distinct counts side by side would multiply the rows instead
    once = each.groupBy(F.col("e.src").alias("src"), F.col("e.dst").alias("dst"), "route").agg(F.max("live").alias("live"), F.min("first_seen").alias("first_seen"))
    return once.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("routes"), F.count_if(F.col("live") == 1).alias("live_routes"), F.min("first_seen").alias("first_seen"))


def nodes(routes: DataFrame, table: str = "route_unicast") -> DataFrame:
    """Roles over all routes: origin (last of a path), transit (elsewhere in one), peer (its observer's neighbour)."""
    last = F.try_element_at("as_path", F.lit(-1))
    each = routes.select(route_key(table).alias("route"), "first_seen", "peer_asn", last.alias("last"), F.explode(F.array_distinct("as_path")).alias("asn"))
    is_last = F.col("asn") == F.col("last")
    return each.groupBy("asn").agg(F.count_distinct("route").alias("routes"), F.max(is_last.cast("int")).alias("origin"), F.max((~is_last).cast("int")).alias("transit"), F.max((F.col("asn") == F.col("peer_asn")).cast("int")).alias("peer"), F.min("first_seen").alias("first_seen"))


def population(routes: DataFrame, table: str = "route_unicast") -> DataFrame:
    return routes.agg(F.count_distinct(route_key(table)).alias("routes"))


def trimmed(edges_: DataFrame, origins: DataFrame, depth: int, least_routes: int = 1) -> DataFrame:
    """Edges within `depth` hops upstream of the origins (asn), of at least so many routes. One join a hop."""
    strong = edges_.where(F.col("routes") >= least_routes)
    reached = origins.select(F.col("asn").alias("node")).distinct()
    for _ in range(depth - 1):
        more = strong.join(reached, strong["dst"] == reached["node"], "left_semi").select(F.col("src").alias("node"))
        reached = reached.unionByName(more).distinct()
    return strong.join(reached, strong["dst"] == reached["node"], "left_semi")
