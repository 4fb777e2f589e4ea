"""BGP link-state: nodes, links, prefixes and their graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.archive import Archive
from pathloom.functions.names import protocol, pseudonode
from pathloom.operators.dumps import dump_state, markers
from pathloom.operators.latest import latest, order
from pathloom.operators.session import PAIR, peer_state, served
from pathloom.plans.filters import LinkStateFilter, all_of
from pathloom.schemas import IDENTITY, NODE_KEY

VALUES = {
    "ls_nodes": ["is_withdraw", "name", "router_id_v4", "srgb_base", "srgb_size", "srlb_base", "srlb_size", "sr_algorithms"],
    "ls_links": ["is_withdraw", "igp_metric", "te_metric", "admin_group", "max_bandwidth", "adj_sids"],
    "ls_prefixes": ["is_withdraw", "prefix_sid", "prefix_sid_flags", "has_prefix_sid", "prefix_metric", "ospf_route_type"],
}


def node_key(prefix: str = "") -> Column:
    """One number for a node descriptor; the same expression in every table."""
    own = [F.col(c if c in ("protocol", "identifier") else prefix + c) for c in NODE_KEY]
    return F.xxhash64(*own)


def newest(archive: Archive, table: str, filters: LinkStateFilter) -> DataFrame:
    rows = archive.newest(table)
    if (c := all_of(filters.narrow(ends=table == "ls_links"))) is not None:
        rows = rows.where(c)
    scoped = rows.join(served(archive), [*PAIR, "peer_ip", "session_id"], "left_semi")
    out = latest(scoped, [*IDENTITY[table], "session_id"], [v for v in VALUES[table] if v in rows.columns])
    return out if (state := filters.of_state()) is None else out.where(state)


def decorated(archive: Archive, objects: DataFrame) -> DataFrame:
    keys = [*PAIR, "peer_ip", "rib", "session_id"]
    states = peer_state(archive).select(*keys, "state", F.col("router_sysname").alias("sysname"))
    marked = markers(archive).where("family = 'ls'").drop("family")
    return objects.join(states, keys, "left").join(marked, keys, "left").withColumns({"dump_state": dump_state(), "protocol_name": protocol(F.col("protocol"))}).drop("state", "marked")


def ls_nodes(archive: Archive, filters: LinkStateFilter = LinkStateFilter()) -> DataFrame:
    return decorated(archive, newest(archive, "ls_nodes", filters)).withColumns({"node_key": node_key(), "is_pseudonode": pseudonode()})


def ls_prefixes(archive: Archive, filters: LinkStateFilter = LinkStateFilter()) -> DataFrame:
    return decorated(archive, newest(archive, "ls_prefixes", filters)).withColumns({"node_key": node_key(), "cidr": F.concat_ws("/", "prefix", "prefix_len")})


def labels(archive: Archive) -> tuple[DataFrame, DataFrame]:
    """Per observer and node, and per node over the fleet: the newest name and v4 router id."""
    nodes = newest(archive, "ls_nodes", LinkStateFilter()).withColumn("node_key", node_key())
    rows = archive["ls_nodes"].where("is_withdraw = 0").withColumn("node_key", node_key())
    named = F.struct(F.coalesce("name", F.lit("")).alias("name"), F.coalesce("router_id_v4", F.lit("")).alias("v4"))
    own = nodes.groupBy(*PAIR, "peer_ip", "rib", "node_key").agg(F.max(named).alias("own"))
    fleet = rows.join(served(archive), [*PAIR, "peer_ip", "session_id"], "left_semi").groupBy("node_key").agg(F.max_by(named, F.struct((named["name"] != "").cast("int"), order())).alias("fleet"))
    return own, fleet


def ls_links(archive: Archive, filters: LinkStateFilter = LinkStateFilter()) -> DataFrame:
    """Links with a label for each end: the observer's name for it, its v4 id there, the fleet's, or the raw id."""
    links = decorated(archive, newest(archive, "ls_links", filters))
    own, fleet = labels(archive)
    for side in ("local", "remote"):
        key = f"{side}_node_key"
        links = links.withColumn(key, node_key(f"{side}_"))
        links = links.join(own.withColumnRenamed("node_key", key), [*PAIR, "peer_ip", "rib", key], "left").join(fleet.withColumnRenamed("node_key", key), key, "left")
        text = lambda c, f: F.when(F.col(f"{c}.{f}") != "", F.col(f"{c}.{f}"))
        label = F.coalesce(text("own", "name"), text("own", "v4"), text("fleet", "name"), text("fleet", "v4"), F.col(f"{side}_router_id"))
        source = F.when(F.coalesce(text("own", "name"), text("own", "v4")).isNotNull(), "observer").when(F.coalesce(text("fleet", "name"), text("fleet", "v4")).isNotNull(), "fleet").otherwise("identifier")
        links = links.withColumns({f"{side}_label": label, f"{side}_label_source": source}).drop("own", "fleet")
    return links


def page(objects: DataFrame, key: list[str], after: tuple | None, limit: int) -> DataFrame:
    """Rows of greater key, in its order, one more than asked to tell whether there is a next page."""
    rows = objects if after is None else objects.where(F.struct(*key) > F.struct(*(F.lit(v).cast(objects.schema[c].dataType) for c, v in zip(key, after, strict=True))))
    return rows.orderBy(*key).limit(limit + 1)


def adjacencies(links: DataFrame) -> DataFrame:
    """Distinct directed adjacencies: their metrics, member links, and whether only one side reports them."""
    both = links.groupBy(F.col("local_node_key").alias("src"), F.col("remote_node_key").alias("dst")).agg(F.array_sort(F.collect_set("igp_metric")).alias("metrics"), F.array_sort(F.collect_set("max_bandwidth")).alias("bandwidths"), F.count(F.lit(1)).alias("members"))
    back = both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back"))
    return both.join(back, ["src", "dst"], "left").withColumn("one_sided", F.col("back").isNull()).drop("back")


def within_nodes(adjacent: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adjacencies both of whose ends are known nodes."""
    keys = nodes.select("node_key").distinct()
    return adjacent.join(keys, adjacent["src"] == keys["node_key"], "left_semi").join(keys, adjacent["dst"] == keys["node_key"], "left_semi")


def graph_nodes(archive: Archive, filters: LinkStateFilter = LinkStateFilter()) -> DataFrame:
    """Nodes of the graph: advertised ones and ends of links that none advertises, each once, shown as its first
    collector has it, with the list of collectors."""
    nodes = ls_nodes(archive, filters).select("collector_id", "protocol", "router_id", "node_key", F.coalesce("name", F.lit("")).alias("name"), F.lit(1).alias("advertised"))
    links = newest(archive, "ls_links", filters)
    for side in ("local", "remote"):
        ends = links.select("collector_id", "protocol", F.col(f"{side}_router_id").alias("router_id"), node_key(f"{side}_").alias("node_key"), F.lit("").alias("name"), F.lit(0).alias("advertised"))
        nodes = nodes.unionByName(ends)
    first = F.min_by(F.struct("router_id", "name", "protocol"), F.struct(-F.col("advertised"), "collector_id", "name")).alias("_f")
    merged = nodes.groupBy("node_key").agg(first, F.max("advertised").alias("advertised"), F.array_join(F.array_sort(F.collect_set("collector_id")), ",").alias("collectors"))
    return merged.select("node_key", "_f.*", "advertised", "collectors").withColumn("is_pseudonode", pseudonode())
