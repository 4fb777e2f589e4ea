"""The rules that make answers right, on small fixtures that break each one's naive form."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathloom.archive import Archive
from pathloom.functions import addresses, communities
from pathloom.functions.communities import BadFilter
from pathloom.operators import session
from pathloom.operators.dumps import classified
from pathloom.plans import churn, peers, routes, topology
from pathloom.plans.filters import LinkStateFilter, RouteFilter, Window
from pathloom.schemas import DDL

T0 = datetime(2030, 1, 1)


def table(spark, name, rows):
    """Rows as dicts over defaults."""
    from pathloom.sources.generator import _fields

    fields = [f.split(" ", 1) for f in _fields(DDL[name])]
    base = {"collector_id": "c0", "router_ip": "10.0.0.1", "router_sysname": "r1", "peer_ip": "10.1.0.1", "rib": "in_pre", "peer_asn": 65001, "session_id": 100, "family": "ipv4u", "prefix": "192.0.2.0/24", "path_id": 0, "is_withdraw": 0, "parse_flags": [], "as_path": [65001, 64500], "communities": [], "kind": "up"}
    out = []
    for r in rows:
        r = base | {"stream_seq": r["seq"], "ts_collector": T0 + timedelta(seconds=r["seq"]), "ts_router": T0} | r if "seq" in r else base | r
        out.append(tuple(r.get(n) for n, _ in fields))
    return spark.createDataFrame(out, DDL[name])


def archive(spark, **tables):
    names = [n for n in DDL if n not in ("asnames", "ls_events")]
    beat = [{"collector_id": c, "started_at": 50, "inserted_at": T0} for c in ("c0", "c1")]
    made = {n: table(spark, n, tables.get(n, [])) for n in names if n != "collector_beats"}
    made["collector_beats"] = spark.createDataFrame([(b["collector_id"], b["started_at"], T0, b["inserted_at"]) for b in tables.get("collector_beats", beat)], DDL["collector_beats"])
    return Archive(made, T0 + timedelta(seconds=30))


UP = {"seq": 1, "kind": "up"}


def only(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_newest_is_by_sequence_and_gates_routes(spark):
    a = archive(spark, peer_events=[{"seq": 3, "kind": "up", "ts_collector": T0}, {"seq": 2, "kind": "down", "ts_collector": T0 + timedelta(hours=1)}], route_unicast=[{"seq": 5}])
    assert only(peers.peers(a), "state") == [("up",)]
    assert routes.current_routes(a, RouteFilter(prefix="192.0.2.0/24")).count() == 1
    down = archive(spark, peer_events=[{"seq": 3, "kind": "down"}, {"seq": 2, "kind": "up"}], route_unicast=[{"seq": 5}])
    assert routes.current_routes(down, RouteFilter(prefix="192.0.2.0/24")).count() == 0


def test_superseded_session_with_greater_seq_never_wins(spark):
    a = archive(spark, peer_events=[UP, {"seq": 900, "session_id": 90}], route_unicast=[{"seq": 2, "next_hop": "now"}, {"seq": 900, "session_id": 90, "next_hop": "old"}])
    assert only(routes.current_routes(a, RouteFilter(prefix="192.0.2.0/24")), "next_hop") == [("now",)]


def test_sessions_are_per_collector(spark):
    a = archive(spark, peer_events=[UP, {"seq": 1, "collector_id": "c1", "session_id": 70}], route_unicast=[{"seq": 2}, {"seq": 2, "collector_id": "c1", "session_id": 70}])
    assert routes.current_routes(a, RouteFilter(prefix="192.0.2.0/24")).count() == 2


def test_gate_does_not_depend_on_rib(spark):
    a = archive(spark, peer_events=[UP], route_unicast=[{"seq": 2, "rib": "in_post"}])
    assert only(routes.current_routes(a, RouteFilter(prefix="192.0.2.0/24")), "dump_state") == [("unknown",)]


def test_null_of_the_newest_row_wins(spark):
    a = archive(spark, peer_events=[UP], route_unicast=[{"seq": 2, "med": 7}, {"seq": 3, "med": None}])
    assert only(routes.current_routes(a, RouteFilter(prefix="192.0.2.0/24")), "med") == [(None,)]


def test_wide_filters_hold_of_the_newest_path(spark):
    a = archive(spark, peer_events=[UP], route_unicast=[{"seq": 2, "as_path": [1, 2]}, {"seq": 3, "as_path": [1, 3]}])
    for semi in (True, False):
        assert routes.current_routes(a, RouteFilter(origin_asn=2), semi_join=semi).count() == 0
        assert routes.current_routes(a, RouteFilter(origin_asn=3), semi_join=semi).count() == 1
    assert routes.current_routes(a, RouteFilter()).count() == 0  # the empty prefix


def test_redelivery_changes_no_answer(spark):
    rows = [{"seq": 2}, {"seq": 3, "is_withdraw": 1}, {"seq": 4}]
    once, twice = (archive(spark, peer_events=[UP] * n, route_unicast=rows * n) for n in (1, 2))
    window = Window(T0, T0 + timedelta(days=1))
    for ask in (lambda a: churn.churn_buckets(a, window, 60), lambda a: churn.dump_counts(a, window), lambda a: peers.peers(a).drop("mp_families", "addpath_families"), lambda a: churn.session_counts(a, window), lambda a: routes.route_history(a, "192.0.2.0/24")):
        assert sorted(map(str, ask(once).collect())) == sorted(map(str, ask(twice).collect()))


def test_liveness(spark):
    def state(beats):
        return only(peers.peers(archive(spark, peer_events=[UP], collector_beats=beats)), "state")

    assert state([{"collector_id": "c0", "started_at": 50, "inserted_at": T0}]) == [("up",)]
    assert state([{"collector_id": "c0", "started_at": 50, "inserted_at": T0 - timedelta(minutes=5)}]) == [("stale",)]
    assert state([{"collector_id": "c0", "started_at": 101, "inserted_at": T0}]) == [("view_lost",)]
    assert state([{"collector_id": "c0", "started_at": 100, "inserted_at": T0}]) == [("up",)]
    assert state([]) == [("stale",)]


def test_stale_pairs_and_target(spark):
    a = archive(spark, peer_events=[UP], collector_beats=[{"collector_id": "c0", "started_at": 50, "inserted_at": T0 - timedelta(minutes=5)}])
    assert only(session.stale_pairs(a), "collector_id", "router_ip") == [("c0", "10.0.0.1")]
    row = session.target_liveness(a, "c0").first()
    assert (row["has_beat"], row["live_sessions"], row["beat_fresh"]) == (1, 1, False)


def test_session_facts_come_from_the_row_that_had_them(spark):
    a = archive(spark, peer_events=[{"seq": 1, "hold_time": 90, "hold_time_seen": 1}, {"seq": 2, "kind": "down", "hold_time": 0, "hold_time_seen": 0}])
    assert only(peers.peers(a), "state", "hold_time", "hold_time_seen") == [("down", 90, 1)]


def test_dump_classification_and_best_observer(spark):
    rows = [{"seq": 1}, {"seq": 2}, {"seq": 3, "is_withdraw": 1}, {"seq": 1, "collector_id": "c1"}]
    a = archive(spark, peer_events=[UP], route_unicast=rows)
    got = churn.churn_buckets(a, Window(T0, T0 + timedelta(hours=1)), 3600).collect()
    assert [tuple(r)[1:] for r in got] == [(1, 1, 1)]


def test_topology_keeps_withdrawn_paths_and_drops_prepending(spark):
    a = archive(spark, peer_events=[UP], route_unicast=[{"seq": 2, "as_path": [65001, 65001, 64500, 64501]}, {"seq": 3, "is_withdraw": 1, "as_path": []}])
    graph = topology.topology_routes(a, RouteFilter(router_ip="10.0.0.1"))
    assert sorted(only(topology.edges(graph), "src", "dst", "routes", "live_routes")) == [(64500, 64501, 1, 0), (65001, 64500, 1, 0)]
    with pytest.raises(BadFilter):
        topology.topology_routes(a, RouteFilter())


def test_walk_visits_every_row_once_and_notices_a_new_session(spark):
    rows = [{"seq": n, "prefix": f"198.51.{n}.0/24", "rib": ("in_pre", "in_post", "loc_rib")[n % 3]} for n in range(2, 25)]
    a = archive(spark, peer_events=[UP], route_unicast=rows)
    cursor, seen = routes.start_walk(a, "10.0.0.1", "10.1.0.1"), []
    while cursor is not None:
        page, cursor = routes.walk_page(a, routes.Cursor.decode(cursor.encode()), 5)
        seen += only(page, "rib", "prefix")
    assert len(seen) == len(set(seen)) == 23
    assert [r for r, _ in seen] == sorted((r for r, _ in seen), key=["in_pre", "in_post", "loc_rib"].index)
    old = routes.start_walk(a, "10.0.0.1", "10.1.0.1")
    with pytest.raises(routes.SessionChanged):
        routes.walk_page(archive(spark, peer_events=[UP, {"seq": 1, "session_id": 200}], route_unicast=rows), old, 5)
    with pytest.raises(BadFilter):
        routes.Cursor.decode("nonsense")


@pytest.mark.parametrize("address", ["192.0.2.77", "2001:db8::5", "::ffff:192.0.2.77"])
def test_covers(spark, address):
    stored = ["192.0.2.0/24", "192.0.0.0/16", "192.0.0.0/8", "0.0.0.0/0", "192.0.3.0/24", "2001:db8::/32", "2001:db9::/32", "::/0", "::ffff:192.0.2.0/120", "bad/24", "192.0.2.0/x", "192.0.2.0/160", "192.0.2.0", "300.0.0.0/8", "2001:db8::/129", "", None]
    got = {r[0] for r in spark.createDataFrame([(s,) for s in stored], "p string").where(addresses.covers(F.col("p"), address)).collect()}
    assert got == ({"2001:db8::/32", "::/0"} if address.startswith("2001") else {"192.0.2.0/24", "192.0.0.0/16", "192.0.0.0/8", "0.0.0.0/0"})


def test_address_keys_sort_as_addresses(spark):
    texts = ["10.0.0.2", "10.0.0.10", "9.255.0.1", "2001:db8::1", "::1", "x", "1.2.3", "2001:db8:0:0:0:0:0:1", "::ffff:10.0.0.2", ":::", "1::2::3", "12345::"]
    keys = {r["a"]: r["k"] for r in spark.createDataFrame([(t,) for t in texts], "a string").withColumn("k", addresses.key(F.col("a"))).collect()}
    assert keys["9.255.0.1"] < keys["10.0.0.2"] < keys["10.0.0.10"] < keys["2001:db8::1"] and keys["::1"] < keys["9.255.0.1"]
    assert keys["2001:db8::1"] == keys["2001:db8:0:0:0:0:0:1"] and keys["::ffff:10.0.0.2"] == keys["10.0.0.2"]
    assert all(keys[t] is None for t in ("x", "1.2.3", ":::", "1::2::3", "12345::"))


def test_community_notation():
    assert communities.parse("65000:3") == [("communities", 65000 << 16 | 3), ("route_targets", "65000:3")]
    assert communities.parse("70000:3") == [("route_targets", "70000:3")]
    assert communities.parse("10.0.0.1:3") == [("route_targets", "10.0.0.1:3"), ("ext_communities", "rt:10.0.0.1:3")]
    assert communities.parse("1:2:3") == [("large_communities", "1:2:3"), ("ext_communities", "1:2:3")]
    assert communities.parse("rt:65101:1") == [("ext_communities", "rt:65101:1"), ("route_targets", "65101:1")]
    for bad in ("", "x", "1:", "rt:65101", "a:b"):
        with pytest.raises(BadFilter):
            communities.parse(bad)


def test_filters_are_checked():
    for bad in ({"prefix": "a", "covers": "10.0.0.1"}, {"covers": "fe80::1%eth0"}, {"covers": "x"}, {"rib": "x"}, {"family": "x"}, {"route_type": 12}):
        with pytest.raises(BadFilter):
            RouteFilter(**bad)
    with pytest.raises(BadFilter):
        LinkStateFilter(state="x")


def test_windows_reach_the_scan_below_deduplication(spark, tmp_path):
    rows = [{"seq": k, "prefix": f"10.{k % 3}.0.0/16", "is_withdraw": k % 2} for k in range(1, 30)]
    table(spark, "route_unicast", rows).union(table(spark, "route_unicast", rows)).write.parquet(f"{tmp_path}/r")
    a = archive(spark, route_unicast=rows)
    a.tables["route_unicast"] = spark.read.parquet(f"{tmp_path}/r")
    window = Window(T0 + timedelta(seconds=5), T0 + timedelta(seconds=20))
    found = classified(a, "route_unicast", *window.bounds())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ts_collector" in plan.split("PushedFilters: ")[1].split("\n")[0] and plan.count("Exchange hashpartitioning") == 1
    assert found.count() == 15 and found.where("is_dump").count() == len({r["prefix"] for r in rows if 5 <= r["seq"] < 20 and r["is_withdraw"] == 0 and r["seq"] == min(x["seq"] for x in rows if x["prefix"] == r["prefix"] and x["seq"] >= 5)})


def test_addresses_are_compared_not_their_texts(spark):
    a = archive(spark, peer_events=[UP, UP | {"router_ip": "2001:db8::1", "seq": 2}], route_unicast=[{"seq": 3}, {"seq": 4, "router_ip": "2001:db8::1", "prefix": "10.9.0.0/16"}])
    for text, prefix in (("::ffff:10.0.0.1", "192.0.2.0/24"), ("2001:0DB8:0:0::1", "10.9.0.0/16")):
        assert [r["prefix"] for r in routes.live_routes(a, "route_unicast", RouteFilter(router_ip=text)).collect()] == [prefix]
    with pytest.raises(BadFilter):
        RouteFilter(router_ip="nowhere").narrow()


def test_dumps_are_told_without_a_window_over_an_identity(spark, data_dir):
    """All rows of a busy identity would meet in one task; dealt by all that tells rows apart they don't."""
    from pathloom.operators.dumps import classified
    from pathloom.sources.bridge import bridge

    plan = classified(bridge(spark, data_dir), "route_unicast")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and any("RepartitionByExpression" in line and "stream_seq" in line for line in plan.splitlines())
