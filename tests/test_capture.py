"""Decoding of synthetic messages built from the RFC layouts."""

import struct

from pathloom.sources import capture


def bmp(kind, body):
    return struct.pack("!BIB", 3, 6 + len(body), kind) + body


def peer(flags=0, kind=0, asn=65001):
    return struct.pack("!BB8s12s4sI4sII", kind, flags, b"\0" * 8, b"\0" * 12, bytes([10, 1, 0, 1]), asn, bytes([1, 1, 1, 1]), 1_700_000_000, 5)


def bgp(data, kind=2):
    return b"\xff" * 16 + struct.pack("!HB", 19 + len(data), kind) + data


def attr(code, value, flags=0x40):
    return struct.pack("!BBB", flags, code, len(value)) + value


def update(withdrawn=b"", attrs=b"", nlri=b""):
    return bgp(struct.pack("!H", len(withdrawn)) + withdrawn + struct.pack("!H", len(attrs)) + attrs + nlri)


PATH = attr(2, struct.pack("!BBII", 2, 2, 65001, 64500))
GOOD = attr(1, b"\0") + PATH + attr(3, bytes([10, 2, 0, 1])) + attr(4, struct.pack("!I", 7)) + attr(8, struct.pack("!II", 65000 << 16 | 1, 9))


def decoded(spark, *bodies, tail=b""):
    content = b"".join(bodies) + tail
    return capture.messages(spark.createDataFrame([("f", bytearray(content))], "path string, content binary"))


def test_updates(spark):
    found = decoded(
        spark,
        bmp(0, peer() + update(attrs=GOOD, nlri=bytes([24, 192, 0, 2, 8, 10]))),
        bmp(0, peer(0x40) + update(withdrawn=bytes([24, 192, 0, 2]))),
        bmp(0, peer() + update()),
        bmp(0, peer(kind=3) + update(attrs=attr(1, b"\0") + attr(2, b"\x09\x01\0") + attr(3, bytes(4)), nlri=bytes([8, 10]))),
        bmp(0, peer() + update(attrs=attr(1, b"\0") + PATH + attr(14, struct.pack("!HBB", 2, 1, 16) + bytes.fromhex("20010db8000000000000000000000001") + b"\0" + bytes([32, 0x20, 1, 0xD, 0xB8])))),
        bmp(0, peer() + update(attrs=attr(15, struct.pack("!HB", 2, 1)))),
        bmp(0, peer() + update(nlri=bytes([33, 1, 2, 3, 4, 5]))),
        tail=b"\x03\0\0",
    )
    rows = capture.updates(found).orderBy("seq").collect()
    first = rows[0]
    assert [tuple(p) for p in first["announced"]] == [("192.0.2.0/24", 0), ("10.0.0.0/8", 0)]
    assert (first["as_path"], first["next_hop"], first["med"], first["local_pref"], first["communities"]) == ([65001, 64500], "10.2.0.1", 7, None, [65000 << 16 | 1, 9])
    assert (first["peer_ip"], first["peer_asn"], first["rib"], first["parse_flags"]) == ("10.1.0.1", 65001, "in_pre", [])
    assert rows[1]["rib"] == "in_post" and [p["prefix"] for p in rows[1]["withdrawn"]] == ["192.0.2.0/24"]
    assert [r["end_of_rib"] for r in rows] == [False, False, True, False, False, True, False]
    assert rows[3]["rib"] == "loc_rib" and rows[3]["parse_flags"] == ["treat_as_withdraw"] and [p["prefix"] for p in rows[3]["withdrawn"]] == ["10.0.0.0/8"] and rows[3]["announced"] == []
    assert [p["prefix"] for p in rows[4]["announced"]] == ["2001:db8::/32"] and rows[4]["next_hop"] == "2001:db8::1"
    assert rows[6]["parse_flags"] == ["undecodable"]


def test_other_messages(spark):
    opened = bgp(struct.pack("!BHH4sB", 4, 65001, 90, bytes(4), 0), 1)
    other = bgp(struct.pack("!BHH4sB", 4, 65001, 180, bytes(4), 0), 1)
    found = decoded(
        spark,
        bmp(4, struct.pack("!HH", 1, 3) + b"abc" + struct.pack("!HH", 2, 2) + b"r1"),
        bmp(3, peer() + bytes(12) + bytes([10, 0, 0, 9]) + struct.pack("!HH", 179, 1024) + opened + other),
        bmp(2, peer() + b"\x03"),
        bmp(1, peer() + struct.pack("!I", 2) + struct.pack("!HHQ", 8, 8, 2**63 + 1) + struct.pack("!HHH", 9, 2, 1)),
    )
    assert [tuple(r)[2:] for r in capture.initiations(found).collect()] == [("abc", "r1")]
    up, down = capture.peer_messages(found).orderBy("seq").collect()
    assert (up["kind"], up["local_ip"], up["local_port"], up["remote_port"], up["hold_time"]) == ("up", "10.0.0.9", 179, 1024, 90)
    assert (down["kind"], down["down_reason"]) == ("down", 3)
    assert capture.statistics(found).first()["counters"] == {8: 2**63 + 1}
