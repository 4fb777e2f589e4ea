"""Questions about decoding: messages are made of the general tables' rows, byte by byte, and read back; the SQL says
what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.sources import sessions
from pathloom.sources.capture import PEER_DOWN, PEER_UP, ROUTE_MONITORING
from pathloom.sources.update import CAPS, decode
from pathloom.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def question(sql: str) -> Callable[[Callable], Callable]:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


# --- bytes, as hex digits


def n(value: Column | int, size: int) -> Column:
    return F.lpad(F.hex((F.lit(value) if isinstance(value, int) else value).cast("long")), 2 * size, "0")


def b(digits: str) -> Column:
    return F.lit(digits)


def sized(parts: list[Column], size: int, more: int = 0) -> Column:
    """Parts behind their length (and `more`)."""
    return F.concat(n(F.length(F.concat(*parts)) / 2 + more, size), *parts)


def attribute(code: int, *parts: Column) -> Column:
    return F.concat(b("50"), n(code, 1), sized(list(parts), 2))


def tlv(code: int, *parts: Column) -> Column:
    return F.concat(n(code, 2), sized(list(parts), 2))


def update_body(attributes: list[Column], announced: Column | None = None, withdrawn: Column | None = None) -> Column:
    return F.concat(sized([withdrawn if withdrawn is not None else b("")], 2), sized(attributes or [b("")], 2), announced if announced is not None else b(""))


def bgp(kind: int, body: Column) -> Column:
    return F.concat(b("F" * 32), n(F.length(body) / 2 + 19, 2), n(kind, 1), body)


def peer_header(peer: Column, post: Column) -> Column:
    """Peer 10.1.0.x of AS 65000 + x, before or after policy."""
    return F.concat(b("00"), F.when(post, "40").otherwise("00"), b("0" * 16), b("0" * 24 + "0A0100"), n(peer, 1), n(65000 + peer, 4), b("01010100"), n(1_700_000_000, 4), n(5, 4))


NEGOTIATED = "named_struct('known', true, 'four_byte', true, 'mp', array('ipv4u', 'vpn4', 'evpn', 'ls'), 'add_path', array('vpn4'))"


def read_back(rows: DataFrame, data: Column) -> DataFrame:
    return decode(rows.withColumns({"data": F.unhex(data), "caps": F.expr(NEGOTIATED).cast(CAPS)}))


def path_of(*asns: Column) -> Column:
    return F.concat(attribute(1, b("00")), attribute(2, b("02"), n(len(asns), 1), *(n(a, 4) for a in asns)))


def vpn_entry(rd: Column, octet: Column, label: Column, path_id: Column) -> Column:
    """172.x.0.0/16 with a route distinguisher of type 0 and one label."""
    return F.concat(n(path_id, 4), n(24 + 64 + 16, 1), n(label * 16 + 1, 3), b("0000"), n(65000, 2), n(rd, 4), b("AC"), n(octet, 1))


@question("""SELECT o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS gone, '65000:' || (o_custkey % 6)::VARCHAR AS rd, '172.' || (16 + o_custkey % 8)::VARCHAR || '.0.0/16' AS prefix, (o_orderkey % 2)::BIGINT AS path_id, (16 + o_orderkey % 1000)::VARCHAR AS labels,
  CASE WHEN o_orderstatus = 'F' THEN '' ELSE '65000 ' || (64600 + o_custkey % 11)::VARCHAR END AS path, CASE WHEN o_orderstatus = 'F' THEN '' ELSE '10.2.0.' || (o_custkey % 200)::VARCHAR END AS next_hop, CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'rt:65000:' || (o_custkey % 3)::VARCHAR || ',color:0x000000000007' END AS ext FROM orders""")
def d7_vpn_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VPN routes with path ids, labels and extended communities, announced and withdrawn."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    entry = vpn_entry(cust % 6, 16 + cust % 8, 16 + key % 1000, key % 2)
    reach = attribute(14, b("0001800C"), b("0" * 16 + "0A0200"), n(cust % 200, 1), b("00"), entry)
    ext = attribute(16, b("0002"), n(65000, 2), n(cust % 3, 4), b("030B000000000007"))
    gone = F.col("o_orderstatus") == "F"
    found = read_back(o, F.when(gone, update_body([attribute(15, b("000180"), entry)])).otherwise(update_body([path_of(F.lit(65000), 64600 + cust % 11), ext, reach])))
    rows = found.select("o_orderkey", "as_path", "next_hop", "ext_communities", F.explode(F.concat(F.transform("vpn_announced", lambda r: F.struct(F.lit(0).alias("gone"), r.alias("r"))), F.transform("vpn_withdrawn", lambda r: F.struct(F.lit(1).alias("gone"), r.alias("r"))))).alias("x"))
    return rows.select(F.col("o_orderkey").alias("k"), "x.gone", "x.r.rd", "x.r.prefix", "x.r.path_id", F.array_join("x.r.labels", " ").alias("labels"), F.array_join("as_path", " ").alias("path"), "next_hop", F.array_join("ext_communities", ",").alias("ext"))


@question("""SELECT event_id AS k, CASE user_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 4 END AS route_type, CASE WHEN user_id % 4 = 3 THEN '' ELSE '65000:' || (user_id % 7)::VARCHAR END AS rd,
  CASE WHEN user_id % 4 = 0 THEN 'aa:bb:cc:00:00:' || lpad(lower(to_hex(user_id % 256))::VARCHAR, 2, '0') ELSE '' END AS mac, CASE WHEN user_id % 4 = 0 THEN '10.7.0.' || (event_id % 256)::VARCHAR ELSE '' END AS ip, CASE WHEN user_id % 4 = 2 THEN '10.9.' || (user_id % 256)::VARCHAR || '.0/24' ELSE '' END AS prefix,
  CASE WHEN user_id % 4 = 2 THEN '10.2.0.1' ELSE '' END AS gateway_ip, CASE WHEN user_id % 4 = 3 THEN 0 ELSE event_id % 4096 END::BIGINT AS ethernet_tag, CASE user_id % 4 WHEN 0 THEN (event_id % 500)::VARCHAR || ' ' || (event_id % 600)::VARCHAR WHEN 2 THEN (event_id % 500)::VARCHAR ELSE '' END AS labels, user_id % 4 = 3 AS untyped FROM events""")
def d8_evpn_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVPN routes of types 2, 3 and 5, and others, which are kept as bytes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    key, user = F.col("event_id"), F.col("user_id")
    rd = F.concat(b("0000"), n(65000, 2), n(user % 7, 4))
    tag, esi = n(key % 4096, 4), b("0" * 20)
    two = F.concat(b("02"), sized([rd, esi, tag, b("30AABBCC0000"), n(user % 256, 1), b("200A0700"), n(key % 256, 1), n(key % 500, 3), n(key % 600, 3)], 1))
    three = F.concat(b("03"), sized([rd, tag, b("200A020001")], 1))
    five = F.concat(b("05"), sized([rd, esi, tag, b("180A09"), n(user % 256, 1), b("FF0A020001"), n(key % 500, 3)], 1))
    entry = F.when(user % 4 == 0, two).when(user % 4 == 1, three).when(user % 4 == 2, five).otherwise(F.concat(b("04"), sized([rd], 1)))
    found = read_back(e, update_body([path_of(F.lit(65000)), attribute(14, b("001946040A02000100"), entry)]))
    rows = found.select("event_id", F.explode("evpn_announced").alias("r"), (F.array_contains("flags", "nlri_untyped") & F.col("raw_reach").isNotNull()).alias("untyped"))
    return rows.select(F.col("event_id").alias("k"), *(f"r.{c}" for c in ("route_type", "rd", "mac", "ip", "prefix", "gateway_ip", "ethernet_tag")), F.array_join("r.labels", " ").alias("labels"), "untyped")


def node_descriptor(code: int, node: Column) -> Column:
    return tlv(code, tlv(512, n(65000, 4)), tlv(513, n(0, 4)), tlv(514, n(node % 2, 4)), tlv(515, b("00000000"), n(node, 2)))


@question("""SELECT s_suppkey AS k, '00000000' || lpad(lower(to_hex(s_nationkey))::VARCHAR, 4, '0') AS local_router_id, '00000000' || lpad(lower(to_hex((s_nationkey * 7 + 3) % 25))::VARCHAR, 4, '0') AS remote_router_id, '10.3.0.' || (s_suppkey % 50)::VARCHAR AS local_ifaddr, (s_suppkey % 2)::BIGINT AS link_local_id, CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS is_withdraw,
  CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 10 + s_suppkey % 5 END::BIGINT AS igp_metric, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE (1000 + s_suppkey % 9)::VARCHAR END AS adj_sids, CASE WHEN s_suppkey % 7 = 0 THEN '' WHEN s_suppkey % 3 = 0 THEN '2222' ELSE '1111' END AS tlv_999, s_suppkey % 3 = 0 OR s_suppkey % 7 <> 0 AS unknown FROM supplier""")
def d9_link_state_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with descriptors and attributes; an unknown TLV of the link wins over the message's."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey")
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    own = F.when(key % 3 == 0, tlv(999, b("2222"))).otherwise("")
    link = tlv(2, b("02"), n(0, 8), node_descriptor(256, nation), node_descriptor(257, (nation * 7 + 3) % 25), tlv(259, b("0A0300"), n(key % 50, 1)), tlv(258, n(key % 2, 4), n(0, 4)), own)
    attributes = attribute(29, tlv(1095, n(10 + key % 5, 3)), tlv(1099, b("70010000"), n(1000 + key % 9, 3)), tlv(999, b("1111")))
    found = read_back(s, F.when(key % 7 == 0, update_body([attribute(15, b("400447"), link)])).otherwise(update_body([path_of(F.lit(65000)), attributes, attribute(14, b("400447040A02000100"), link)])))
    rows = found.select("s_suppkey", F.explode("ls_links").alias("l"), F.array_contains("flags", "ls_tlv_unknown").alias("unknown"))
    tlv_999 = F.when(F.col("l.is_withdraw") == 0, F.hex(F.element_at("l.unknown_tlvs", F.lit(999)))).otherwise("").alias("tlv_999")
    return rows.select(F.col("s_suppkey").alias("k"), "l.local_router_id", "l.remote_router_id", "l.local_ifaddr", "l.link_local_id", "l.is_withdraw", "l.igp_metric", F.array_join("l.adj_sids", " ").alias("adj_sids"), tlv_999, "unknown")


def capability(code: int, digits: str) -> str:
    return f"{code:02X}{len(digits) // 2:02X}{digits}"


def opened(hold: int, *capabilities: str) -> str:
    own = "".join(capabilities)
    body = f"04FDE8{hold:04X}00000000{len(own) // 2 + 2:02X}02{len(own) // 2:02X}{own}"
    return "F" * 32 + f"{len(body) // 2 + 19:04X}01{body}"


#: OPENs of a router that takes path ids of IPv4 and a peer that sends them.
ROUTER = opened(90, capability(1, "00010001"), capability(65, "0000FDE8"), capability(69, "00010101"))
PEER = opened(180, capability(1, "00010001"), capability(65, "0000FDE9"), capability(69, "00010102"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of messages: events of a user are those of its peer, before policy or after it; sign-ups are Peer Ups, errors
    Peer Downs, others announce a prefix. A session is a router's week, and closes."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    key, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    up, down = kind == "signup", kind == "error"
    head = peer_header(user % 50, user % 3 == 0)
    # path ids as long as the peer's OPENs last, which the log itself must tell
    route = F.concat(n(key % 4, 4), b("180A"), n(user % 250, 1), n(key % 250, 1))
    update = bgp(2, update_body([path_of(65000 + user % 50, 64600 + key % 11), attribute(3, b("0A020001"))], route))
    body = F.when(up, F.concat(head, b("0" * 24 + "0A00000900B30400" + ROUTER + PEER))).when(down, F.concat(head, n(1 + key % 6, 1))).otherwise(F.concat(head, update))
    shown = {"collector_id": F.lit("c0"), "router_ip": F.concat(F.lit("10.0.0."), (user % 5).cast("string")), "session_id": F.floor(F.day("ts") / 8).cast("long"), "n": key, "type": F.when(up, PEER_UP).when(down, PEER_DOWN).otherwise(ROUTE_MONITORING), "body": F.unhex(body), "ts_collector": F.col("ts")}
    rows = e.select(*(c.alias(name) for name, c in shown.items()))
    ends = rows.groupBy(*sessions.SESSION).agg(F.lit(1 << 40).alias("n"), F.lit(sessions.CLOSE).alias("type"), F.lit(None).cast("binary").alias("body"), F.max("ts_collector").alias("ts_collector"))
    return rows.unionByName(ends)


LOG_SQL = """WITH log AS (SELECT event_id AS n, 'r' || (user_id % 5)::VARCHAR AS r, (day(ts)::BIGINT // 8) AS session_id, user_id % 50 AS p, CASE WHEN user_id % 3 = 0 THEN 'in_post' ELSE 'in_pre' END AS rib, user_id, CASE event_type WHEN 'signup' THEN 'up' WHEN 'error' THEN 'down' ELSE 'route' END AS what FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY r, session_id, p, rib ORDER BY n) AS seq,
  coalesce(last_value(CASE what WHEN 'up' THEN 1 WHEN 'down' THEN 0 END IGNORE NULLS) OVER (PARTITION BY r, session_id, p, rib ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS own, coalesce(last_value(CASE what WHEN 'up' THEN 1 WHEN 'down' THEN 0 END IGNORE NULLS) OVER (PARTITION BY r, session_id, p ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS shared FROM log)"""


@question(LOG_SQL + """ SELECT r, session_id, n, p, rib, what, seq, CASE WHEN what = 'route' THEN own = 0 AND shared = 0 ELSE false END AS caps_missing, CASE WHEN what = 'up' THEN 90 ELSE 0 END AS hold FROM placed
  UNION ALL SELECT r, session_id, 1099511627776, p, rib, 'view_lost', max(seq) + 1, false, 0 FROM placed GROUP BY r, session_id, p, rib HAVING arg_max(what, n) FILTER (WHERE what <> 'route') = 'up'""")
def d13_session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers within views, known capabilities, and the views that closes lose."""
    e = sessions.replay(event_log(spark, sf_dir))
    return e.select(
        F.concat(F.lit("r"), F.substring_index("router_ip", ".", -1)).alias("r"), "session_id", F.col("stream_seq").alias("n"), F.substring_index("peer_ip", ".", -1).cast("long").alias("p"), "rib", F.coalesce("peer_kind", "kind").alias("what"), "seq", F.array_contains("parse_flags", "caps_missing").alias("caps_missing"), F.col("hold_time").alias("hold")
    )


@question(LOG_SQL + """, routes AS (SELECT *, '10.' || (user_id % 250)::VARCHAR || '.' || (n % 250)::VARCHAR || '.0/24' AS prefix FROM placed WHERE what = 'route')
  SELECT r, session_id, n, p, rib, prefix, n % 4 AS path_id, own = 0 AND shared = 0 AS guessed, (65000 + p)::VARCHAR || ' ' || (64600 + n % 11)::VARCHAR AS path FROM routes""")
def d6_routes_of_the_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's rows in the archive's table: path ids by the OPENs, or told from the bytes without them."""
    rows = ingest.explode_rows(sessions.replay(event_log(spark, sf_dir)).where("kind = 'route'"))["route_unicast"]
    return rows.select(
        F.concat(F.lit("r"), F.substring_index("router_ip", ".", -1)).alias("r"), "session_id", F.col("stream_seq").alias("n"), F.substring_index("peer_ip", ".", -1).cast("long").alias("p"), "rib", "prefix", "path_id", F.array_contains("parse_flags", "addpath_heuristic").alias("guessed"), F.array_join("as_path", " ").alias("path")
    )
