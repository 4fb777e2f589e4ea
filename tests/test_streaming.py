"""Ingest, current tables, clean-up, purge and retention."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathloom.archive import WrongSchema, open_archive
from pathloom.current import CurrentTables
from pathloom.sources.generator import envelopes
from pathloom.streaming import ingest, maintenance


def fed(spark, tmp_path, frames):
    source, path = f"{tmp_path}/in", f"{tmp_path}/archive"
    ingest.create(spark, path)
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(ingest.ENVELOPE_DDL).parquet(source)
        ingest.run(stream, path, f"{tmp_path}/checkpoint", available_now=True, dedup=None).awaitTermination()
    return path


def test_ingest_is_idempotent_and_order_free(spark, tmp_path):
    all_ = envelopes(spark, 60)
    path = fed(spark, tmp_path / "a", [all_.where("seq % 2 = 1"), all_.where("seq % 2 = 0"), all_])
    current = CurrentTables(spark, path).read("route_unicast")
    other = CurrentTables(spark, fed(spark, tmp_path / "b", [all_])).read("route_unicast")
    assert sorted(map(str, current.collect())) == sorted(map(str, other.collect()))
    history = spark.read.parquet(f"{path}/route_unicast")
    assert history.dropDuplicates(["peer_ip", "prefix", "seq"]).count() == 240 and history.count() == 480


def test_rows_of_an_envelope(spark):
    e = envelopes(spark, 10).withColumn("ts_router", F.when(F.col("seq") == 0, F.timestamp_seconds(F.lit(0))).otherwise(F.col("ts_router")))
    e = e.withColumn("router_ip", F.when(F.col("seq") == 1, "nowhere").otherwise(F.col("router_ip")))
    good, bad = ingest.valid(e)
    assert (good.count(), bad.count()) == (9, 1)
    rows = ingest.explode_rows(good)["route_unicast"].where("seq = 0").collect()
    assert len(rows) == 4 and all(r["parse_flags"] == ["zero_timestamp"] and r["ts_router"] == r["ts_collector"] for r in rows)
    assert rows[0]["route_targets"] == ["65000:1"] and len(rows[0]["as_path"]) == 3
    end = good.limit(1).withColumns({"announced": F.lit(None).cast("array<struct<prefix:string,path_id:bigint,rd:string,labels:array<bigint>>>"), "withdrawn": F.lit(None).cast("array<struct<prefix:string,path_id:bigint,rd:string,labels:array<bigint>>>")})
    assert ingest.explode_rows(end)["eor_events"].count() == 1


def test_clean_up_keeps_two_sessions(spark):
    rows = spark.createDataFrame([("c0", "r", s) for s in (1, 2, 3)] + [("c1", "r", 1)], "collector_id string, router_ip string, session_id long")
    left = maintenance.without_superseded(rows, maintenance.floors(rows))
    assert sorted(tuple(r) for r in left.collect()) == [("c0", "r", 2), ("c0", "r", 3), ("c1", "r", 1)]


def test_purge_leaves_later_sessions(spark):
    rows = spark.createDataFrame([("c0", "r", s) for s in (1, 2, 3)], "collector_id string, router_ip string, session_id long")
    plan = spark.createDataFrame([("c0", "r", 2)], "collector_id string, router_ip string, up_to long")
    assert [r["session_id"] for r in maintenance.purged(rows, plan).collect()] == [3]


def test_retention_drops_whole_months(spark, tmp_path):
    rows = spark.createDataFrame([("2023-01",), ("2023-12",)], "month string").withColumn("x", F.lit(1))
    rows.write.partitionBy("month").parquet(f"{tmp_path}/h/route_unicast")
    assert maintenance.expire(spark, f"{tmp_path}/h", "route_unicast", datetime(2024, 1, 1), 90) == ["2023-01"]
    assert spark.read.parquet(f"{tmp_path}/h/route_unicast").count() == 1


def test_other_schema_versions_are_refused(spark, tmp_path):
    spark.createDataFrame([(1,)], "version int").write.json(f"{tmp_path}/x/_schema_version")
    with pytest.raises(WrongSchema):
        open_archive(spark, f"{tmp_path}/x", datetime(2024, 1, 1) + timedelta(0))


@pytest.mark.parametrize(("options", "seqs"), [({}, set(range(20))), ({"dedup": "2 minutes"}, set(range(1, 20, 2)))])
def test_late_envelopes_are_kept_by_default(spark, tmp_path, options, seqs):
    source, path, all_ = f"{tmp_path}/in", f"{tmp_path}/archive", envelopes(spark, 20)
    ingest.create(spark, path)
    for f in (all_.where("seq % 2 = 1"), all_.where("seq % 2 = 0").withColumn("ts_collector", F.expr("ts_collector - interval 1 day"))):
        f.coalesce(1).write.mode("append").parquet(source)
        ingest.run(spark.readStream.schema(ingest.ENVELOPE_DDL).parquet(source), path, f"{tmp_path}/checkpoint", available_now=True, **options).awaitTermination()
    for rows in (spark.read.parquet(f"{path}/route_unicast"), CurrentTables(spark, path).read("route_unicast")):
        assert {r["seq"] for r in rows.select("seq").collect()} == seqs


def test_a_crash_before_the_manifest_leaves_the_generation_before(spark, tmp_path):
    rows = ingest.explode_rows(envelopes(spark, 20))["route_unicast"]
    tables = CurrentTables(spark, f"{tmp_path}/a")
    tables.upsert("route_unicast", rows.where("seq < 10"))
    before = sorted(map(str, tables.read("route_unicast").collect()))
    held = tables.read("route_unicast")
    (tmp_path / "a/route_unicast_current/manifest/2").mkdir()  # a manifest whose writer died
    rows.limit(3).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{tmp_path}/a/route_unicast_current/data/2")
    assert tables.generation("route_unicast") == 1 and sorted(map(str, tables.read("route_unicast").collect())) == before
    tables.upsert("route_unicast", rows)
    assert tables.generation("route_unicast") == 2 and tables.read("route_unicast").count() == rows.count()
    assert sorted(map(str, held.collect())) == before  # a reader of the generation before still finds it
    tables.vacuum("route_unicast", kept=1)
    assert tables.generations("route_unicast") == [2] and tables.read("route_unicast").count() == rows.count()


def test_an_opened_archive_reads_current_tables_and_prunes_months(spark, tmp_path):
    path = fed(spark, tmp_path, [envelopes(spark, 40)])
    a = open_archive(spark, path, datetime(2024, 1, 1))
    assert "route_unicast" in a.current and "month" not in a["route_unicast"].columns
    plan = a.distinct("route_unicast", datetime(2023, 12, 1), datetime(2024, 1, 2))._jdf.queryExecution().executedPlan().toString()
    assert "month" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0] and "ts_collector" in plan.split("PushedFilters: ")[1]
    maintenance.clean_up(spark, path)
    assert sorted(map(str, open_archive(spark, path, datetime(2024, 1, 1)).current["route_unicast"].collect())) == sorted(map(str, a.current["route_unicast"].collect()))


def test_every_payload_reaches_its_table_or_the_rejected(spark, tmp_path):
    e = envelopes(spark, 8)
    kind = F.when(F.col("seq") == 4, "ls").when(F.col("seq") == 5, "beat").when(F.col("seq") == 6, "gossip").otherwise("route")
    family = F.when(F.col("seq").isin(2, 3), "evpn").when(F.col("seq") == 7, F.lit(None)).otherwise("ipv4u")
    fields = {f.name: f.dataType for f in e.schema}
    evpn = F.from_json(F.lit('[{"route_type": 2, "rd": "65000:1", "prefix": "", "mac": "aa:bb:cc:00:00:01", "ip": "", "ethernet_tag": 0, "esi": "", "labels": [7], "path_id": 0}]'), fields["evpn_announced"])
    node = {"protocol": 2, "identifier": 0, "asn": 65000, "bgpls_id": 0, "area": 0, "router_id": "000000000001", "is_withdraw": 0, "name": "n1"}
    nodes = F.array(F.struct(*(F.lit(node.get(f.name)).cast(f.dataType).alias(f.name) for f in fields["ls_nodes"].elementType)))
    e = e.withColumns({"kind": kind, "family": family, "peer_ip": F.when(F.col("seq") == 3, "10.1.0.2").otherwise(F.col("peer_ip")), "started_at": F.lit(9).cast("long"), "evpn_announced": F.when(F.col("seq") == 2, evpn), "evpn_withdrawn": F.when(F.col("seq") == 3, evpn), "ls_nodes": F.when(F.col("seq") == 4, nodes)})
    e = e.withColumns({c: F.when(F.col("seq").isin(2, 3), F.lit(None)).otherwise(F.col(c)) for c in ("announced", "withdrawn")})
    path = fed(spark, tmp_path, [e])
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    assert sorted((r["seq"], r["is_withdraw"], r["mac"]) for r in read("route_evpn").collect()) == [(2, 0, "aa:bb:cc:00:00:01"), (3, 1, "aa:bb:cc:00:00:01")]
    assert [r["name"] for r in read("ls_nodes").collect()] == ["n1"] and [r["started_at"] for r in read("collector_beats").collect()] == [9]
    assert sorted(r["msg_id"] for r in read("_rejected").collect()) == ["m6", "m7"] and {r["seq"] for r in read("route_unicast").collect()} == {0, 1}
    current = CurrentTables(spark, path)
    assert [r["is_withdraw"] for r in current.read("route_evpn").collect()] == [1] and current.read("ls_nodes").count() == 1
    a = open_archive(spark, path, datetime(2024, 1, 1))
    assert set(a.current) == {"route_unicast", "route_evpn", "ls_nodes"} and a["collector_beats"].count() == 1
