"""Sessions: numbers within views, capabilities by direction, losses of views; windows and stream agree."""

import struct
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pathloom.archive import open_archive
from pathloom.functions import tokens
from pathloom.functions.platforms import platform
from pathloom.sources import sessions
from pathloom.streaming import ingest
from pathloom.streaming import sessions as stream
from pathloom.wire_queries import event_log

START = datetime(2024, 1, 5)
ROUTE = bytes([24, 192, 0, 2])


def peer(n=1, flags=0, kind=0, ts=1_700_000_000):
    return struct.pack("!BB8s12s4sI4sII", kind, flags, b"\0" * 8, b"\0" * 12, bytes([10, 1, 0, n]), 65000 + n, bytes([1, 1, 1, n]), ts, 5)


def bgp(data, kind):
    return b"\xff" * 16 + struct.pack("!HB", 19 + len(data), kind) + data


def cap(code, value):
    return bytes([code, len(value)]) + value


def opened(hold, *caps):
    own = b"".join(caps)
    return bgp(struct.pack("!BHH4sB", 4, 65001, hold, bytes(4), len(own) + 2 if own else 0) + (bytes([2, len(own)]) + own if own else b""), 1)


V4, FOUR = cap(1, struct.pack("!HBB", 1, 0, 1)), cap(65, struct.pack("!I", 65001))
ROUTER = opened(90, V4, FOUR, cap(69, struct.pack("!HBB", 1, 1, 1)))  # takes path ids
PEER = opened(180, V4, FOUR, cap(1, struct.pack("!HBB", 2, 0, 1)), cap(69, struct.pack("!HBB", 1, 1, 2)))  # sends them


def up(*opens, **own):
    return 3, peer(**own) + bytes(12) + bytes([10, 0, 0, 9]) + struct.pack("!HH", 179, 1024) + b"".join(opens)


def down(**own):
    return 2, peer(**own) + b"\x03why"


def update(nlri, four=True, **own):
    path = struct.pack("!BBI" if four else "!BBH", 2, 1, 65001)
    attrs = b"\x40\x01\x01\x00" + bytes([0x40, 2, len(path)]) + path + bytes([0x40, 3, 4, 10, 2, 0, 1])
    return 0, peer(**own) + bgp(struct.pack("!HH", 0, len(attrs)) + attrs + nlri, 2)


WITH_ID = struct.pack("!I", 7) + ROUTE
INIT = 4, struct.pack("!HH", 1, 22) + b"Cisco NX-OS version 9.3"[:22] + struct.pack("!HH", 2, 2) + b"r1"
STATS = 1, peer() + struct.pack("!I", 1) + struct.pack("!HHQ", 8, 8, 2**63 + 1)
LOG = [
    INIT, update(ROUTE, four=False, flags=32), up(ROUTER, PEER), update(WITH_ID), update(ROUTE, flags=16), update(WITH_ID, flags=64), STATS, down(), update(ROUTE, flags=64), up(b"junk"), update(ROUTE),
    up(ROUTER, PEER, n=2), up(ROUTER, PEER, n=2, flags=16), down(n=2, flags=16), (5, b"bye"), (0, peer(n=3)[:20]), (0, peer(n=4) + b"\xff" * 30), update(ROUTE, n=2, ts=0), up(ROUTER, PEER, n=3), (sessions.CLOSE, None),
]


def messages(spark, *logs):
    rows = [("c0", f"10.0.0.{s}", 100 + s, i, kind, body if body is None else bytearray(body), START + timedelta(seconds=i)) for s, log in enumerate(logs, 1) for i, (kind, body) in enumerate(log)]
    return spark.createDataFrame(rows, sessions.MESSAGES)


SHOWN = ["router_ip", "stream_seq", "kind", "peer_kind", "seq", "msg_id", "rib", "peer_ip", "family", "announced", "parse_flags", "hold_time", "hold_time_seen", "mp_families", "addpath_families", "down_reason", "local_ip", "router_sysname", "counters", "raw_body", "ts_router", "as_path_segments", "end_of_rib"]


def shown(df):
    return sorted(map(str, (tuple(r) for r in df.select(*SHOWN).collect())))


@pytest.fixture(scope="module")
def replayed(spark):
    return {(r.stream_seq, r.msg_id): r for r in sessions.replay(messages(spark, LOG)).collect()}


def at(replayed, n):
    return next(r for (k, _), r in replayed.items() if k == n)


def test_numbers_and_kinds(replayed):
    view = lambda p, rib: sorted((n, r.seq, r.kind) for (n, _), r in replayed.items() if (r.peer_ip, r.rib) == (p, rib) and r.kind != "raw")
    assert [s for _, s, _ in view("10.1.0.1", "in_pre")] == list(range(1, 9))
    assert [k for *_, k in view("10.1.0.1", "in_pre")] == ["route", "peer", "route", "stats", "peer", "peer", "route", "peer"]
    assert [s for _, s, _ in view("10.1.0.1", "in_post")] == [1, 2] and [s for _, s, _ in view("10.1.0.2", "out_pre")] == [1, 2]
    assert [(r.stream_seq, r.seq, bytes(r.raw_body) if r.raw_body else None) for r in sorted(replayed.values(), key=lambda r: r.stream_seq) if r.kind == "raw"] == [(14, 1, b"bye"), (15, 2, LOG[15][1]), (16, 3, LOG[16][1])]
    assert len({r.msg_id for r in replayed.values()}) == len(replayed) == 21


def test_capabilities_by_direction(replayed):
    assert at(replayed, 1).parse_flags == ["caps_missing", "addpath_heuristic"] and at(replayed, 1).as_path_segments == [[65001]]
    u = at(replayed, 2)
    assert (u.hold_time, u.hold_time_seen, u.mp_families, u.addpath_families, u.local_ip, u.peer_kind) == (90, 1, ["ipv4u"], ["ipv4u"], "10.0.0.9", "up")
    assert [tuple(p)[:2] for p in at(replayed, 3).announced] == [("192.0.2.0/24", 7)] and at(replayed, 3).parse_flags == []
    assert [tuple(p)[:2] for p in at(replayed, 4).announced] == [("192.0.2.0/24", 0)] and at(replayed, 4).rib == "out_pre" and at(replayed, 4).parse_flags == []
    assert [tuple(p)[:2] for p in at(replayed, 5).announced] == [("192.0.2.0/24", 7)]  # a view without a Peer Up borrows its peer's
    assert at(replayed, 6).counters == {8: 2**63 + 1} and at(replayed, 7).down_reason == 3
    assert "caps_missing" in at(replayed, 8).parse_flags and "caps_missing" in at(replayed, 10).parse_flags
    assert (at(replayed, 9).hold_time_seen, at(replayed, 9).mp_families) == (0, None)
    # another view of the peer went down, not this one: its path ids are known, and the bytes have none
    assert at(replayed, 17).parse_flags == ["addpath_heuristic"]


def test_a_close_loses_the_views_that_are_up(replayed):
    lost = sorted((r.msg_id, r.peer_ip, r.rib, r.seq) for r in replayed.values() if r.peer_kind == "view_lost")
    assert [x[1:] for x in lost] == [("10.1.0.1", "in_pre", 8), ("10.1.0.2", "in_pre", 3), ("10.1.0.3", "in_pre", 2)]
    assert all(r.ts_router == r.ts_collector == START + timedelta(seconds=19) and r.parse_flags == [] for r in replayed.values() if r.peer_kind == "view_lost")


def test_too_many_views_are_raw(spark, monkeypatch):
    monkeypatch.setattr(sessions, "MOST_VIEWS", 1)
    rows = sessions.replay(messages(spark, LOG)).where("kind <> 'raw'").select("peer_ip", "rib").distinct().collect()
    assert [tuple(r) for r in rows] == [("10.1.0.1", "in_pre")]


def test_settings(spark):
    own = sessions.Settings(disabled={"10.0.0.1": ["caps_missing"]}, identity={"10.0.0.1": ("cisco", "iosxr")})
    rows = {r.stream_seq: r for r in sessions.replay(messages(spark, LOG[:4]), own).collect()}
    assert rows[1].parse_flags == ["addpath_heuristic", "version_unparsed"] and rows[3].parse_flags == ["version_unparsed"]


def test_platforms(spark):
    texts = ["Cisco NX-OS(tm) Software, version 9.3(5)\nmore 1", "IOS XR, Version 7.02.1x", "FRRouting 8.4_git", "Nexus9000 chassis", "other 1.2", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(platform(F.col("t")).alias("p")).collect()
    assert [tuple(r.p) for r in got] == [("cisco", "nxos", "9.3.5"), ("cisco", "iosxr", "7.2.1"), ("frr", "frr", "8.4"), ("cisco", "nxos", None), ("", "", None), ("", "", None)]
    own = spark.createDataFrame([("7.5.2",), ("Version 6.1 x",), ("nothing",)], "t string").select(platform(F.col("t"), F.lit("cisco"), F.lit("iosxr")).alias("p")).collect()
    assert [r.p.version for r in own] == ["7.5.2", "6.1", None]


def test_tokens(spark):
    fnv = 2166136261
    for byte in bytes.fromhex("00000000000fd001"):
        fnv = (fnv ^ byte) * 16777619 % 2**32
    rows = spark.createDataFrame([("10.0.0.1",), ("::ffff:10.0.0.1",), ("2001:db8::1",), ("x",)], "a string").select(tokens.address_token(F.col("a")).alias("t")).select("t", tokens.token_address(F.col("t")).alias("back")).collect()
    assert [tuple(r) for r in rows] == [("0a000001", "10.0.0.1"), ("0a000001", "10.0.0.1"), ("20010db8000000000000000000000001", "2001:db8::1"), ("invalid", None)]
    named = spark.createDataFrame([("0A000001", "out_post", "0" * 16), ("0A000001", "in_pre", "00000000000FD001"), ("0A000001", "loc_rib", "0" * 16)], "d string, rib string, rd string")
    peer_ = tokens.peer_token(F.col("d"), F.col("rib"), F.col("rd"))
    assert [r[0] for r in named.select(tokens.view_token(peer_, F.col("rib"))).collect()] == ["0a000001-doutpost", f"0a000001-r{fnv:08x}", "locrib"]


def streamed(spark, tmp_path, parts, **options):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        rows = sessions.envelopes(stream.in_context(spark.readStream.schema(sessions.MESSAGES).parquet(f"{tmp_path}/in"), **options))
        q = rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out")


def test_the_stream_says_what_the_windows_say(spark, tmp_path):
    log = messages(spark, LOG, LOG[2:12] + LOG[:2], LOG[:8])
    got = streamed(spark, tmp_path, [log.where("n < 5"), log.where("n between 5 and 12"), log.where("n > 12")])
    assert shown(got) == shown(sessions.replay(log))


def test_a_capture_becomes_an_archive(spark, tmp_path):
    path = f"{tmp_path}/archive"
    ingest.create(spark, path)
    sessions.replay(messages(spark, LOG)).coalesce(1).write.parquet(f"{tmp_path}/in")
    ingest.run(spark.readStream.schema(ingest.ENVELOPE_DDL).parquet(f"{tmp_path}/in"), path, f"{tmp_path}/checkpoint", available_now=True).awaitTermination()
    a = open_archive(spark, path, START + timedelta(days=1))
    assert sorted((r.rib, r.prefix, r.path_id) for r in a["route_unicast"].where("peer_ip = '10.1.0.1' and seq = 3 or rib = 'out_pre'").collect()) == [("in_pre", "192.0.2.0/24", 7), ("out_pre", "192.0.2.0/24", 0)]
    assert a["peer_events"].where("kind = 'view_lost'").count() == 3 and a["stats_events"].count() == 1
    assert spark.read.parquet(f"{path}/_rejected").where("kind = 'raw'").count() == 3


def test_slices_of_a_session_change_nothing(spark, data_dir, monkeypatch):
    """A session's messages are walked in slices; how long these are is no matter."""
    found = []
    for bits in (4, 40):
        monkeypatch.setattr(sessions, "SLICE_BITS", bits)
        rows = sessions.in_context(event_log(spark, data_dir)).select(*sessions.SESSION, "n", "view", "type", "seq", "raw_seq", "tracked", "lost", "sysname", "caps")
        found.append(sorted(map(str, rows.collect())))
    assert len(found[0]) > 1000 and found[0] == found[1]
