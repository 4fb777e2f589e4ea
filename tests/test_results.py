"""Totals and warnings, what reaches the scan, current tables in parts and buckets, gaps of the log."""

import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_semantics import T0, UP, archive, table

from pathloom.archive import open_archive
from pathloom.current import MOST_PARTS, CurrentTables, newest_state
from pathloom.functions.communities import BadFilter
from pathloom.plans import churn, dashboards, peers, results, routes
from pathloom.plans.filters import RouteFilter, Window, any_of
from pathloom.sources.generator import envelopes
from pathloom.streaming import ingest, lag


def routers(n):
    return [{"seq": s, "router_ip": f"10.0.0.{k}", "prefix": f"10.{s}.0.0/16"} for k in range(1, n + 1) for s in range(1, k + 2)]


def test_totals_count_what_the_limit_leaves_out(spark):
    a = archive(spark, peer_events=[UP], route_unicast=routers(12))
    found = churn.dump_counts(a, Window(T0))
    got = results.ask(found, results.order_of("dumps"), 3)
    assert [(r.router_ip, r.archived) for r in got.rows] == [("10.0.0.12", 13), ("10.0.0.11", 12), ("10.0.0.10", 11)] and got.total_matched == 12 and got.codes() == ["truncated"]
    page = results.with_total(found, results.order_of("dumps"), 3).collect()
    assert [(r.router_ip, r.total_matched) for r in page] == [("10.0.0.12", 12), ("10.0.0.11", 12), ("10.0.0.10", 12)]
    whole = results.ask(found, results.order_of("dumps"))
    assert (len(whole.rows), whole.total_matched, whole.codes()) == (12, 12, [])


def test_nothing_matched_is_zero(spark):
    a = archive(spark)
    for found, order in ((churn.dump_counts(a, Window(T0)), "dumps"), (churn.session_counts(a, Window(T0)), "sessions"), (churn.locrib_comparison(a), "locrib"), (churn.flag_counts(a), "flags")):
        got = results.ask(found, results.order_of(order), 5)
        assert (got.rows, got.total_matched, got.warnings) == ([], 0, [])


def test_ties_are_ordered_by_address(spark):
    rows = [{"seq": 1, "router_ip": ip} for ip in ("10.0.0.10", "10.0.0.9", "2001:db8::1", "9.0.0.1")]
    got = results.ask(churn.dump_counts(archive(spark, route_unicast=rows), Window(T0)), results.order_of("dumps"))
    assert [r.router_ip for r in got.rows] == ["9.0.0.1", "10.0.0.9", "10.0.0.10", "2001:db8::1"]


def test_warnings(spark):
    a = archive(spark, peer_events=[UP], route_unicast=[{"seq": 5}])
    got = results.ask(routes.current_routes(a, RouteFilter(prefix="192.0.2.0/24")), [F.col("prefix")], archive=a)
    assert got.codes() == ["session_dumping"]
    stale = archive(spark, peer_events=[UP], route_unicast=[{"seq": 5}], eor_events=[{"seq": 6}], collector_beats=[{"collector_id": "c0", "started_at": 50, "inserted_at": T0 - timedelta(minutes=5)}])
    assert results.ask(routes.current_routes(stale, RouteFilter(prefix="192.0.2.0/24")), [F.col("prefix")], archive=stale).codes() == ["collector_stale"]


def test_walks_give_cursors_and_say_that_pages_smear(spark):
    a = archive(spark, peer_events=[UP], route_unicast=[{"seq": n, "prefix": f"10.{n}.0.0/16"} for n in range(2, 9)], eor_events=[{"seq": 20}])
    first = results.ask_page(a, routes.start_walk(a, "10.0.0.1", "10.1.0.1"), 4)
    second = results.ask_page(a, routes.Cursor.decode(first.cursor), 4)
    assert (len(first.rows), first.codes(), len(second.rows), second.codes(), second.cursor) == (4, ["paginated_smear"], 3, ["paginated_smear"], None)
    whole = results.ask_page(a, routes.start_walk(a, "10.0.0.1", "10.1.0.1"))
    assert (len(whole.rows), whole.codes(), whole.totals("path_id")) == (7, ["paginated_smear"], {"path_id": 0})


def test_router_and_peer_reach_the_scan(spark, tmp_path):
    table(spark, "route_unicast", [{"seq": 1}]).write.parquet(f"{tmp_path}/r")
    scan = spark.read.parquet(f"{tmp_path}/r")
    for text in ("10.0.0.1", "::ffff:10.0.0.1"):
        for c in RouteFilter(router_ip=text, peer_ip="10.1.0.1").narrow():
            scan = scan.where(c)
    pushed = scan._jdf.queryExecution().executedPlan().toString().split("PushedFilters: ")[1].split("\n")[0]
    assert "EqualTo(router_ip,10.0.0.1)" in pushed and "EqualTo(peer_ip,10.1.0.1)" in pushed and scan.count() == 1


def test_choices(spark):
    rows = spark.createDataFrame([("in_pre",), ("in_post",), ("loc_rib",), ("x_in_pre",)], "rib string")
    some = lambda *c: sorted(r.rib for r in rows.where(any_of("rib", list(c))).collect())
    assert some("in_.*") == ["in_post", "in_pre"] and some("in_pre", "loc_rib") == ["in_pre", "loc_rib"] and some("in_(pre)", "x.*") == ["in_pre", "x_in_pre"] and any_of("rib", []) is None
    with pytest.raises(BadFilter):
        any_of("rib", ["in_("])
    a = archive(spark, route_vpn=[{"seq": 1, "rd": "1:1", "route_targets": ["1:1", "1:2"], "family": "vpn4"}, {"seq": 1, "rd": "1:1", "route_targets": ["1:1", "1:2"], "family": "vpn4"}, {"seq": 2, "rd": "", "route_targets": [], "family": "lu4"}, {"seq": 3, "rd": "1:2", "route_targets": [], "family": "vpn4"}])
    assert dashboards.vpn_routes_header(a).first().asDict() == {"routes": 3, "vrfs": 2, "routers": 1, "no_route_target": 1, "targets": 2}


def test_best_observer_by_rank(spark):
    events = [{"seq": n, "peer_ip": f"10.1.0.{n}", "collector_id": "c0"} for n in range(1, 4)] + [{"seq": 1, "collector_id": "c1", "peer_ip": "10.1.0.1"}]
    beats = [{"collector_id": "c0", "started_at": 50, "inserted_at": T0 - timedelta(minutes=5)}, {"collector_id": "c1", "started_at": 50, "inserted_at": T0}]
    a = archive(spark, peer_events=events, collector_beats=beats)
    best = peers.best_routers(a).first()
    assert (best.collector_id, best.up, best.stale) == ("c1", 1, 0)  # the silent one saw more
    assert peers.best_routers(archive(spark, peer_events=events)).first().collector_id == "c0"


def test_windows_without_scope_are_bounded(spark):
    a = archive(spark, peer_events=[UP])
    a.most_unscoped = timedelta(hours=24)
    assert peers.peer_events(a, Window(T0)).count() == 1
    with pytest.raises(BadFilter):
        peers.peer_events(a, Window(T0 - timedelta(days=2)))
    assert peers.peer_events(a, Window(T0 - timedelta(days=2)), router_ip="10.0.0.1").count() == 1


def test_current_tables_grow_by_parts_and_are_put_together(spark, tmp_path):
    rows = ingest.explode_rows(envelopes(spark, 60))["route_unicast"].cache()
    tables = CurrentTables(spark, f"{tmp_path}/a")
    for k in range(12):
        tables.upsert("route_unicast", rows.where(f"seq % 12 = {k}"))
        most = max(len(g) for g in tables.manifest("route_unicast", k + 1).values())
        assert most <= MOST_PARTS + 1
    assert sorted(map(str, tables.read("route_unicast").collect())) == sorted(map(str, newest_state(rows, "route_unicast").collect()))


def test_a_question_on_one_peer_reads_one_bucket(spark, tmp_path):
    ingest.create(spark, f"{tmp_path}")
    rows = ingest.explode_rows(envelopes(spark, 64, peers=40))["route_unicast"]
    tables = CurrentTables(spark, f"{tmp_path}")
    tables.replace("route_unicast", newest_state(rows, "route_unicast"))
    a = open_archive(spark, f"{tmp_path}", datetime(2024, 1, 1))
    one = a.newest("route_unicast", "10.0.0.1", "10.1.0.7")
    assert len(one.inputFiles()) == 1 < len(a.newest("route_unicast").inputFiles())
    assert one.where("peer_ip = '10.1.0.7'").count() == rows.where("peer_ip = '10.1.0.7'").select("prefix").distinct().count()
    assert a.newest("route_unicast", "10.9.9.9", "10.1.0.7").where("router_ip = '10.9.9.9'").count() == 0


def test_writers_don_t_lose_each_other_s_rows(spark, tmp_path):
    rows = ingest.explode_rows(envelopes(spark, 48))["route_unicast"].cache()
    rows.count()
    failed = []

    def feed(part):
        try:
            CurrentTables(spark, f"{tmp_path}/a").upsert("route_unicast", rows.where(f"seq % 3 = {part}"))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=feed, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    tables = CurrentTables(spark, f"{tmp_path}/a")
    assert not failed and tables.generation("route_unicast") == 3
    assert sorted(map(str, tables.read("route_unicast").collect())) == sorted(map(str, newest_state(rows, "route_unicast").collect()))


def test_gaps_and_redeliveries(spark):
    a = archive(spark, route_unicast=[{"seq": s, "prefix": f"10.{s}.0.0/16"} for s in (1, 2, 5, 9, 9, 1030)], peer_events=[UP])
    for stretch in (4, 1 << 20):
        got = sorted(tuple(r) for r in lag.gaps(a, stretch).collect())
        assert got == [("routes", 2, 5, 2), ("routes", 5, 9, 3), ("routes", 9, 1030, 1020)]
    rows = {r.stream: tuple(r)[1:] for r in lag.accounts(a).collect()}
    assert rows == {"routes": (1, 1030, 5, 1025, 3, 1), "peer": (1, 1, 1, 0, 0, 0)}


def test_progress_of_a_query(spark, tmp_path):
    seen = lag.Progress()
    spark.streams.addListener(seen)
    try:
        ingest.create(spark, f"{tmp_path}/a")
        envelopes(spark, 10).coalesce(1).write.parquet(f"{tmp_path}/in")
        ingest.run(spark.readStream.schema(ingest.ENVELOPE_DDL).parquet(f"{tmp_path}/in"), f"{tmp_path}/a", f"{tmp_path}/c", available_now=True).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(seen)
    assert sum(r["rows"] for r in seen.table(spark).collect()) == 10
