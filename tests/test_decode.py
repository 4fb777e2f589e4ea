"""UPDATEs of all families, built from the layouts of the RFCs, and length-prefixed lists against a plain walk."""

import ipaddress
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pathloom.functions import addresses
from pathloom.sources import items as it
from pathloom.sources import update

CAPS = {"known": True, "four_byte": True, "mp": ["ipv4u", "ipv6u", "vpn4", "evpn", "ls"], "add_path": []}
UNSURE = {"known": False, "four_byte": None, "mp": [], "add_path": []}


def attr(code, value, flags=0x40):
    return struct.pack("!BBB", flags, code, len(value)) + value if len(value) < 256 else struct.pack("!BBH", flags | 16, code, len(value)) + value


def body(attrs=b"", nlri=b"", gone=b""):
    return struct.pack("!H", len(gone)) + gone + struct.pack("!H", len(attrs)) + attrs + nlri


def tlv(code, value):
    return struct.pack("!HH", code, len(value)) + value


PATH = struct.pack("!BBII", 2, 2, 65001, 64500)
GOOD = attr(1, b"\0") + attr(2, PATH)
HOP4, HOP6 = bytes([10, 2, 0, 1]), ipaddress.ip_address("2001:db8::1").packed


def reach(afi, safi, hop, nlri):
    return attr(14, struct.pack("!HBB", afi, safi, len(hop)) + hop + b"\0" + nlri, 0x80)


def unreach(afi, safi, nlri=b""):
    return attr(15, struct.pack("!HB", afi, safi) + nlri, 0x80)


@pytest.fixture(scope="module")
def decode(spark):
    def run(*bodies, caps=CAPS):
        rows = spark.createDataFrame([(i, bytearray(b), caps) for i, b in enumerate(bodies)], f"n int, data binary, caps {update.CAPS}")
        return update.decode(rows).orderBy("n").collect()

    return run


LAYOUTS = {"prefixes": it.PREFIXES, "attributes": it.ATTRIBUTES, "segments": it.SEGMENTS, "wide segments": it.WIDE_SEGMENTS, "routes": it.ROUTES, "short": it.SHORT, "tlvs": it.TLVS}


def walked(b, layout, path):
    out, at = [], 0
    while at < len(b):
        number, flags, head, wide = 0, 0, layout.head, layout.size_bytes
        if path:
            if at + 4 >= len(b):
                return None
            number, at = int.from_bytes(b[at : at + 4], "big"), at + 4
        if layout.wide_flag:
            flags = b[at]
            head, wide = (head + 1, 2) if flags & layout.wide_flag else (head, wide)
        if at + head > len(b):
            return None
        size = int.from_bytes(b[at + layout.size_at : at + layout.size_at + wide], "big")
        code = size if layout.code_at is None else int.from_bytes(b[at + layout.code_at : at + layout.code_at + layout.code_bytes], "big")
        end = at + head + int(layout.scale(size))
        if end > len(b):
            return None
        out.append((code, flags, size, number, bytes(b[at + head : end])))
        at = end
    return out


@pytest.mark.parametrize("name", LAYOUTS)
def test_lists_equal_a_walk(name):
    rng, layout = random.Random(name), LAYOUTS[name]
    for _ in range(150):
        rows = [None if rng.random() < 0.1 else bytes(rng.choice([0, 0, 1, 2, 3, 16, 24, 32, rng.randrange(256)]) for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 8))]
        path = np.array([layout.paths and rng.random() < 0.5 for _ in rows], bool)
        items, bad = it.walk(pa.array(rows, pa.binary()), layout, path)
        found = [None if r else [] for r in bad.tolist()]
        for k, *x, v in zip(items.row.tolist(), items.code.tolist(), items.flags.tolist(), items.size.tolist(), items.path_id.tolist(), items.values(), strict=True):
            found[k].append((*x, v))
        assert found == [[] if b is None else walked(b, layout, p) for b, p in zip(rows, path, strict=True)]


def test_canonical_addresses(spark):
    rng = random.Random(2)
    own = [ipaddress.IPv6Address(bytes(rng.choice([0, 0, 0, rng.randrange(256)]) for _ in range(16))) for _ in range(300)]
    texts = [a.exploded for a in own] + ["2001:DB8::1", "::ffff:10.0.0.1", "10.0.0.1", "no", "", "::", "1::", "::1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", addresses.canonical(F.col("t")).alias("c")).collect()
    for r in rows:
        try:
            ip = ipaddress.ip_address(r.t)
            want = str(getattr(ip, "ipv4_mapped", None) or ip)
        except ValueError:
            want = r.t
        assert r.c == want


def test_prefixes_are_masked_and_framing_is_guessed(decode):
    plain, ids = bytes([24, 192, 0, 2, 9, 10, 255]), struct.pack("!I", 7) + bytes([24, 192, 0, 2]) + struct.pack("!I", 0) + bytes([16, 10, 1])
    known = decode(body(GOOD + attr(3, HOP4), plain), body(gone=plain), body(GOOD, bytes([33, 1, 2, 3, 4, 5])))
    assert [tuple(p) for p in known[0].announced] == [("192.0.2.0/24", 0), ("10.128.0.0/9", 0)] and known[0].flags == [] and known[0].next_hop == "10.2.0.1"
    assert [p.prefix for p in known[1].withdrawn] == ["192.0.2.0/24", "10.128.0.0/9"] and [r.ok for r in known] == [True, True, False]
    guessed = decode(body(GOOD, plain), body(GOOD, ids), body(GOOD), caps=UNSURE)
    assert [p.path_id for p in guessed[0].announced] == [0, 0] and guessed[0].flags == ["addpath_heuristic"]
    assert [tuple(p) for p in guessed[1].announced] == [("192.0.2.0/24", 7), ("10.1.0.0/16", 0)] and guessed[1].flags == ["addpath_heuristic"]
    assert guessed[2].flags == []
    wrong = decode(body(GOOD, bytes([8, 10])), body(GOOD, ids), caps=CAPS | {"add_path": ["ipv4u"]})
    assert [p.prefix for p in wrong[0].announced] == ["10.0.0.0/8"] and wrong[0].flags == ["addpath_heuristic"]
    assert [p.path_id for p in wrong[1].announced] == [7, 0] and wrong[1].flags == []


def test_vpn_and_labelled_routes(decode):
    rd0, rd1, rd2 = struct.pack("!HHI", 0, 65000, 7), struct.pack("!H4sH", 1, HOP4, 9), struct.pack("!HIH", 2, 4200000000, 1)
    stack = bytes([0, 1, 0x10, 0, 2, 0x21])  # labels 17 and 34, the second is the last
    one = bytes([48 + 64 + 24]) + stack + rd0 + bytes([192, 0, 2])
    two = bytes([24 + 64 + 9]) + b"\x80\0\0" + rd1 + bytes([10, 255])
    six = bytes([24 + 64 + 32]) + bytes([0, 1, 1]) + rd2 + bytes([0x20, 1, 0xD, 0xB8])
    lu = bytes([24 + 16]) + bytes([0, 1, 1]) + bytes([10, 1])
    hop = bytes(8) + HOP4
    rows = decode(body(GOOD + reach(1, 128, hop, one)), body(unreach(1, 128, two)), body(GOOD + reach(2, 128, bytes(8) + HOP6, six)), body(GOOD + reach(1, 4, HOP4, lu)), body(GOOD + reach(1, 128, hop, bytes([30]) + b"\0\0\1\0")), body(GOOD + reach(1, 128, HOP4, one)), body(GOOD + reach(1, 128, hop, bytes([24 + 64]) + b"\0\0\1" + b"\0\3" + bytes(6))))
    assert tuple(rows[0].vpn_announced[0]) == ("192.0.2.0/24", 0, "65000:7", [17, 34]) and rows[0].next_hop == "10.2.0.1" and rows[0].family == "vpn4"
    assert tuple(rows[1].vpn_withdrawn[0]) == ("10.128.0.0/9", 0, "10.2.0.1:9", [524288])
    assert tuple(rows[2].vpn_announced[0]) == ("2001:db8::/32", 0, "4200000000:1", [16]) and rows[2].next_hop == "2001:db8::1" and rows[2].family == "vpn6"
    assert tuple(rows[3].vpn_announced[0]) == ("10.1.0.0/16", 0, "", [16]) and rows[3].family == "lu4"
    assert rows[4].vpn_announced == [] and rows[4].flags == ["nlri_untyped"] and rows[4].raw_reach is not None and rows[4].ok
    assert len(rows[5].vpn_announced) == 1 and rows[5].flags == ["nlri_untyped"] and rows[5].raw_reach is not None  # a next hop without its distinguisher
    assert rows[6].flags == ["nlri_untyped"] and all(r.raw_reach is None for r in rows[:4])


def test_evpn_routes(decode):
    rd, esi = struct.pack("!HHI", 0, 65000, 7), bytes(range(10))
    mac = bytes.fromhex("aabbcc000102")
    two = rd + esi + struct.pack("!I", 5) + b"\x30" + mac + b"\x20" + HOP4 + bytes([0, 0, 100, 0, 0, 200])
    bare = rd + esi + struct.pack("!I", 0) + b"\x30" + mac + b"\0" + bytes([0, 39, 16])
    three = rd + struct.pack("!I", 9) + b"\x20" + HOP4
    five = rd + esi + struct.pack("!I", 0) + bytes([20]) + bytes([10, 1, 255, 0]) + HOP4 + bytes([0, 0, 7])
    five6 = rd + esi + struct.pack("!I", 0) + bytes([32]) + ipaddress.ip_address("2001:db8::").packed + bytes(16) + bytes([0, 0, 8])
    route = lambda kind, v: bytes([kind, len(v)]) + v
    rows = decode(body(GOOD + reach(25, 70, HOP4, b"".join([route(2, two), route(2, bare), route(3, three), route(5, five), route(5, five6)]))), body(GOOD + reach(25, 70, HOP4, route(3, three) + route(4, b"abc"))), body(unreach(25, 70, route(2, two[:-1]))), body(unreach(25, 70, struct.pack("!I", 77) + route(3, three))), caps=CAPS)
    found = [r.asDict() for r in rows[0].evpn_announced]
    assert [f["route_type"] for f in found] == [2, 2, 3, 5, 5] and rows[0].flags == [] and rows[0].raw_reach is None
    assert (found[0]["mac"], found[0]["ip"], found[0]["labels"], found[0]["ethernet_tag"], found[0]["esi"], found[0]["rd"]) == ("aa:bb:cc:00:01:02", "10.2.0.1", [100, 200], 5, esi.hex(), "65000:7")
    assert (found[1]["ip"], found[1]["labels"]) == ("", [10000]) and found[2]["ethernet_tag"] == 9 and found[2]["ip"] == ""
    assert (found[3]["prefix"], found[3]["gateway_ip"], found[3]["labels"]) == ("10.1.240.0/20", "10.2.0.1", [7]) and (found[4]["prefix"], found[4]["gateway_ip"]) == ("2001:db8::/32", "::")
    assert [r.route_type for r in rows[1].evpn_announced] == [3, 4] and rows[1].flags == ["nlri_untyped"] and rows[1].raw_reach is not None
    assert rows[2].evpn_withdrawn == [] and rows[2].flags == ["nlri_untyped"] and rows[2].raw_unreach is not None
    assert rows[3].flags == ["nlri_untyped"]
    ids = decode(body(unreach(25, 70, struct.pack("!I", 77) + route(3, three))), caps=CAPS | {"add_path": ["evpn"]})
    assert [(r.route_type, r.path_id) for r in ids[0].evpn_withdrawn] == [(3, 77)] and ids[0].flags == []


def end(code, asn=65000, router=b"\0\0\0\0\0\1", more=b""):
    return tlv(code, tlv(512, struct.pack("!I", asn)) + tlv(513, bytes(4)) + tlv(514, struct.pack("!I", 3)) + tlv(515, router) + more)


def ls_object(kind, *parts, protocol=2, ident=2**64 - 1):
    return tlv(kind, struct.pack("!BQ", protocol, ident) + b"".join(parts))


def test_link_state(decode):
    node = ls_object(1, end(256, more=tlv(599, b"q")), tlv(300, b"zz"), tlv(300, b"last"))
    link = ls_object(2, end(256), end(257, 65009, b"\0\0\0\0\0\2"), tlv(259, HOP4), tlv(260, bytes([10, 2, 0, 2])), tlv(258, struct.pack("!II", 5, 6)))
    pfx = ls_object(3, end(256), tlv(264, b"\2"), tlv(265, bytes([20, 10, 1, 240])))
    pfx6 = ls_object(4, end(256), tlv(265, bytes([32, 0x20, 1, 0xD, 0xB8])))
    sr = lambda code: tlv(code, b"\0\0" + b"\0\x1f\x40" + tlv(1161, b"\0\x3e\x80"))
    attributes = attr(29, tlv(1026, b"r\xff1") + tlv(1028, HOP4) + sr(1034) + sr(1036) + tlv(1035, b"\0\1") + tlv(1088, struct.pack("!I", 9)) + tlv(1089, struct.pack("!f", 1.25e9)) + tlv(1092, struct.pack("!I", 11)) + tlv(1095, b"\0\0\x0a") + tlv(1099, b"\x70\1\0\0\0\x05\xdc") + tlv(1099, b"\x30\2\0\0" + struct.pack("!I", 70000)) + tlv(1155, struct.pack("!I", 4)) + tlv(1158, b"\x40\0\0\0" + struct.pack("!I", 88)) + tlv(1170, b"\x20") + tlv(258, struct.pack("!II", 50, 60)) + tlv(300, b"attr") + tlv(4000, b"x"), 0xC0)
    rows = decode(
        body(GOOD + reach(16388, 71, HOP4, node + link + pfx + pfx6) + attributes), body(unreach(16388, 71, link)), body(GOOD + reach(16388, 71, HOP4, pfx + tlv(9, b"new"))),
        body(GOOD + reach(16388, 71, HOP4, ls_object(1, tlv(256, tlv(512, b"abc"))))), body(unreach(16388, 71)), body(GOOD + reach(16388, 71, HOP4, node) + attr(29, tlv(1088, b"abc"), 0xC0)), body(attr(1, b"\7") + reach(16388, 71, HOP4, node)),
        body(GOOD + reach(16388, 71, HOP4, ls_object(3, end(256)))),
    )
    r = rows[0]
    assert r.family == "ls" and r.raw_reach is None and r.flags == ["ls_tlv_unknown"]
    n = r.ls_nodes[0]
    assert (n.protocol, int(n.identifier), n.asn, n.area, n.router_id, n.is_withdraw) == (2, 2**64 - 1, 65000, 3, "000000000001", 0)
    assert (n.name, n.router_id_v4, n.srgb_base, n.srgb_size, n.srlb_base, n.sr_algorithms) == ("r�1", "10.2.0.1", 16000, 8000, 16000, [0, 1])
    assert {k: bytes(v) for k, v in n.unknown_tlvs.items()} == {300: b"last", 4000: b"x", 599: b"q"}
    own = r.ls_links[0]
    assert (own.remote_asn, own.remote_router_id, own.local_ifaddr, own.remote_ifaddr, own.link_local_id, own.link_remote_id) == (65009, "000000000002", "10.2.0.1", "10.2.0.2", 5, 6)
    assert (own.adj_sids, own.adj_flags, own.adj_weights, own.te_metric, own.igp_metric, own.admin_group, own.max_bandwidth) == ([1500, 70000], [0x70, 0x30], [1, 2], 11, 10, 9, 1.25e9)
    p, q = r.ls_prefixes
    assert (p.prefix, p.prefix_len, p.ospf_route_type, p.prefix_sid, p.prefix_sid_flags, p.has_prefix_sid, p.prefix_metric, p.prefix_attr_flags) == ("10.1.240.0", 20, 2, 88, 0x40, 1, 4, 0x20)
    assert (q.prefix, q.prefix_len, q.ospf_route_type) == ("2001:db8::", 32, 0)
    assert [x.is_withdraw for x in rows[1].ls_links] == [1] and rows[1].ls_links[0].igp_metric == 0
    assert len(rows[2].ls_prefixes) == 1 and rows[2].flags == ["ls_nlri_undecoded"] and rows[2].raw_reach is not None
    assert rows[3].ls_nodes == [] and rows[3].flags == ["nlri_untyped"] and rows[3].raw_reach is not None
    assert rows[4].end_of_rib and rows[4].family == "ls"
    assert rows[5].ls_nodes[0].name == "" and set(rows[5].flags) == {"attr_discarded", "ls_tlv_unknown"}
    assert rows[6].ls_nodes[0].is_withdraw == 1 and "treat_as_withdraw" in rows[6].flags
    assert rows[7].ls_prefixes == [] and rows[7].flags == ["nlri_untyped"]


def test_attributes_and_errors(decode):
    ext = [bytes([0, 2]) + struct.pack("!HI", 65000, 7), bytes([1, 3]) + HOP4 + struct.pack("!H", 5), bytes([2, 2]) + struct.pack("!IH", 4200000000, 3), bytes([6, 3]) + bytes.fromhex("aabbcc000102"), bytes([6, 0, 1, 0]) + struct.pack("!I", 4), bytes([6, 0, 0, 0]) + struct.pack("!I", 5), bytes([3, 12, 0, 0, 0, 0, 0, 8]), bytes([3, 12, 0, 0, 0, 0, 0, 1]), bytes([0x43, 9]) + b"abcdef"]
    all_ = GOOD + attr(3, HOP4) + attr(4, struct.pack("!I", 7)) + attr(5, struct.pack("!I", 200)) + attr(8, struct.pack("!II", 65000 << 16 | 1, 9)) + attr(16, b"".join(ext)) + attr(32, struct.pack("!III", 1, 2, 3)) + attr(200, b"x" * 300)
    nlri = bytes([8, 10])
    rows = decode(
        body(all_, nlri), body(attr(1, b"\3") + attr(2, PATH), nlri), body(attr(1, b"\0") + attr(2, b"\x09\1\0\0\0\1"), nlri), body(GOOD + attr(5, b"abc"), nlri), body(GOOD + attr(8, b""), nlri), body(), body(unreach(2, 1)), body(GOOD + reach(1, 1, HOP4, nlri)),
        body(GOOD + reach(1, 1, HOP4, nlri) + reach(1, 1, HOP4, nlri)), body(GOOD + reach(99, 9, HOP4, b"raw")), b"\0", body(attrs=b"\x40\1"), body(GOOD + reach(2, 1, HOP6, bytes([32, 0x20, 1, 0xD, 0xB8])), nlri), body(GOOD + attr(7, b"abc"), nlri),
    )
    r = rows[0]
    assert r.ext_communities == ["rt:65000:7", "soo:10.2.0.1:5", "rt:4200000000:3", "router-mac:aa:bb:cc:00:01:02", "mac-mobility:sticky,seq=4", "mac-mobility:seq=5", "encap:vxlan", "encap:1", "67:9:0x616263646566"]
    assert (r.as_path, r.med, r.local_pref, r.communities, r.large_communities, r.flags) == ([65001, 64500], 7, 200, [65000 << 16 | 1, 9], ["1:2:3"], [])
    for k in (1, 2, 4):
        assert rows[k].announced == [] and [p.prefix for p in rows[k].withdrawn] == ["10.0.0.0/8"] and rows[k].flags == ["treat_as_withdraw"]
    assert rows[3].flags == ["attr_discarded"] and len(rows[3].announced) == 1 and rows[3].local_pref is None and rows[13].flags == ["attr_discarded"]
    assert [x.end_of_rib for x in rows[:9]] == [False] * 5 + [True, True, False, False] and rows[6].family == "ipv6u"
    assert [p.prefix for p in rows[7].announced] == ["10.0.0.0/8"] and rows[7].next_hop == "10.2.0.1" and rows[8].flags == ["treat_as_withdraw"]
    assert rows[9].family == "x99-9" and rows[9].flags == ["unknown_family"] and rows[9].raw_reach is not None and rows[9].ok
    assert [rows[10].ok, rows[11].ok] == [False, False]
    assert [p.prefix for p in rows[12].announced] == ["2001:db8::/32", "10.0.0.0/8"] and rows[12].family == "ipv6u" and rows[12].next_hop == "2001:db8::1"


def test_old_as_paths(decode):
    old = attr(1, b"\0") + attr(2, struct.pack("!BBHH", 2, 2, 65001, 64500) + struct.pack("!BBH", 1, 1, 7))
    assert decode(body(old, bytes([8, 10])), caps=CAPS | {"four_byte": False})[0].as_path == [65001, 64500, 7]


def test_bytes_are_read_by_one_function(spark):
    """A chain of functions holds a Python process each per task; rows beyond one slice of a batch are read the same."""
    body = bytes.fromhex("0000" + "0004" + "40010100" + "180A0001")
    rows = spark.range(update.ROWS_AT_ONCE + 10).withColumn("data", F.when(F.col("id") % 3 == 0, F.lit(body))).repartition(1)
    found = update.decode(rows.withColumn("caps", F.expr("named_struct('known', true, 'four_byte', true, 'mp', array('ipv4u'), 'add_path', array())").cast(update.CAPS)))
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = found.groupBy(F.col("id") % 3 == 0, "ok", F.get("announced.prefix", 0), F.size("ls_nodes")).count().collect()
    assert {tuple(r) for r in got} == {(True, True, "10.0.1.0/24", 0, (update.ROWS_AT_ONCE + 12) // 3), (False, False, None, 0, (update.ROWS_AT_ONCE + 10) - (update.ROWS_AT_ONCE + 12) // 3)}
