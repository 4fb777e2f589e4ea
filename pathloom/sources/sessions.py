"""BMP messages in the context of their session: number within the peer's view, what the peer's OPENs settled, flags,
and the loss of views when the session closes.

A session is (collector_id, router_ip, session_id); its messages are ordered by `n`. A view is one RIB of one peer. This
is the form for a log at rest: windows by slices of a session, and by session, peer and view over sums of the slices.
`streaming.sessions` keeps the same state for a stream.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from pathloom.functions.platforms import platform
from pathloom.functions.tokens import address_token, peer_token, view_token
from pathloom.sources.capture import BGP_HEAD, INITIATION, PEER_DOWN, PEER_HEAD, PEER_UP, ROUTE_MONITORING, STATISTICS, address, number, peer_columns, piece, tlvs
from pathloom.sources.nlri import Malformed, family_name
from pathloom.sources.update import decode

SESSION = ["collector_id", "router_ip", "session_id"]
MESSAGES = "collector_id string, router_ip string, session_id long, n long, type int, body binary, ts_collector timestamp"
#: A record of the log that says the transport ended.
CLOSE = -1
#: A session's messages are walked in slices of so many numbers (as a power of two), each by one task.
SLICE_BITS = 16
#: Views that a session keeps at most; messages of others are kept raw.
MOST_VIEWS = 10_000
UP_HEAD = PEER_HEAD + 20
#: OPEN's capabilities, and the bits of add-path.
CAPABILITIES, MULTIPROTOCOL, FOUR_BYTE_AS, ADD_PATH, RECEIVE, SEND = 2, 1, 65, 69, 1, 2


@dataclass(frozen=True)
class Settings:
    """Per router address: flags not to raise, and the vendor and system it is, whatever it says."""

    disabled: dict[str, list[str]] = field(default_factory=dict)
    identity: dict[str, tuple[str, str]] = field(default_factory=dict)


def of_router(values: dict, kind: str) -> Column:
    if not values:
        return F.lit(None).cast(kind)
    return F.element_at(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v))), F.col("router_ip")).cast(kind)


# --- OPENs


@dataclass
class Open:
    hold: int
    four_byte: bool
    mp: set[str]
    receives: set[str]
    sends: set[str]


def pairs(b: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(b):
        if at + 2 > len(b) or at + 2 + b[at + 1] > len(b):
            raise Malformed("parameter")
        out.append((b[at], b[at + 2 : at + 2 + b[at + 1]]))
        at += 2 + b[at + 1]
    return out


def read_open(m: bytes) -> Open:
    """An OPEN's hold time and capabilities. One that names no family has IPv4 unicast."""
    if len(m) < BGP_HEAD + 10 or m[18] != 1 or m[28] == 255 or len(m) < 29 + m[28]:
        raise Malformed("OPEN")
    out, named = Open(int.from_bytes(m[22:24], "big"), False, set(), set(), set()), False
    for kind, v in pairs(m[29 : 29 + m[28]]):
        for code, c in pairs(v) if kind == CAPABILITIES else ():
            if code == MULTIPROTOCOL:
                named = True
                if len(c) == 4:
                    out.mp.add(family_name(int.from_bytes(c[:2], "big"), c[3]))
            elif code == FOUR_BYTE_AS and len(c) == 4:
                out.four_byte = True
            elif code == ADD_PATH:
                for k in range(0, len(c) - 3, 4):
                    family = family_name(*struct.unpack_from("!HB", c, k))
                    out.receives |= {family} if c[k + 3] & RECEIVE else set()
                    out.sends |= {family} if c[k + 3] & SEND else set()
    if not named:
        out.mp.add("ipv4u")
    return out


def two_messages(b: bytes) -> tuple[bytes, bytes]:
    """The OPENs at a Peer Up's end, by the lengths in their headers."""
    parts = []
    for _ in range(2):
        size = int.from_bytes(b[16:18], "big")
        if len(b) < BGP_HEAD or not BGP_HEAD <= size <= len(b):
            raise Malformed("OPEN's length")
        parts.append(b[:size])
        b = b[size:]
    return parts[0], parts[1]


OPENS = pa.struct([("open_ok", pa.bool_()), ("open_four", pa.bool_()), ("open_hold", pa.int32()), ("open_mp", pa.list_(pa.string())), ("open_in", pa.list_(pa.string())), ("open_out", pa.list_(pa.string()))])


def settled(tail: bytes) -> dict:
    """What the router's OPEN and its peer's settle. A family has path ids if who receives its routes takes them and who
    sends them sends them, so routes to the router (`open_in`) and from it (`open_out`) may differ."""
    try:
        router, peer = map(read_open, two_messages(tail))
    except Malformed:
        return {"open_ok": False}
    order = lambda families: sorted(families)
    return {
        "open_ok": True, "open_four": router.four_byte and peer.four_byte, "open_hold": min(router.hold, peer.hold), "open_mp": order(router.mp & peer.mp),
        "open_in": order(router.receives & peer.sends), "open_out": order(peer.receives & router.sends),
    }


def opens(tail: Column) -> Column:
    @F.arrow_udf(from_arrow_type(OPENS))
    def parse(column: pa.Array) -> pa.Array:
        return pa.array([None if b is None else settled(b) for b in column.to_pylist()], OPENS)

    return parse(tail)


# --- headers


def headed(messages: DataFrame) -> DataFrame:
    """Messages with the peer's header, `peer` and `view` (None without a header), what a Peer Up settles, an
    Initiation's texts, and whether the message is well-framed."""
    body, kind = F.col("body"), F.col("type")
    has = kind.isin(ROUTE_MONITORING, STATISTICS, PEER_DOWN, PEER_UP) & (F.length(body) >= PEER_HEAD)
    m = messages.withColumns({c: F.when(has, x) for c, x in peer_columns(body).items()})
    told = tlvs(F.when(kind == INITIATION, body))
    m = m.withColumns({"told": told, "counted": tlvs(F.when(has & (kind == STATISTICS) & (F.length(body) >= PEER_HEAD + 4), piece(body, PEER_HEAD + 4))), "o": opens(F.when(has & (kind == PEER_UP) & (F.length(body) >= UP_HEAD), piece(body, UP_HEAD)))})
    text = lambda code: F.get(F.filter("told", lambda t: t["code"] == code), 0)["value"]
    said = lambda code: F.when(F.col("told").isNotNull() & (kind == INITIATION), F.coalesce(F.make_valid_utf8(text(code).cast("string")), F.lit("")))
    fits = (number(body, PEER_HEAD + 16, 2) == F.length(body) - PEER_HEAD) & (F.length(body) >= PEER_HEAD + BGP_HEAD)
    framed = has & F.when(kind == ROUTE_MONITORING, fits).when(kind == PEER_UP, F.length(body) >= UP_HEAD).when(kind == STATISTICS, F.col("counted").isNotNull() & (F.length(body) >= PEER_HEAD + 4)).otherwise(F.lit(True))
    digits = F.when(number(body, 1, 1).bitwiseAND(F.lit(128)) != 0, F.hex(piece(body, 10, 16))).otherwise(F.hex(piece(body, 22, 4)))
    peer = peer_token(digits, F.col("rib"), F.col("distinguisher"))
    m = m.withColumns({"peer": F.when(has, peer), "told_descr": said(1), "told_name": said(2), "framed": F.coalesce(framed, F.lit(False)), **{f.name: F.col(f"o.{f.name}") for f in OPENS}})
    return m.withColumn("view", F.when(has, view_token(F.col("peer"), F.col("rib")))).drop("told", "counted", "o")


HEADER = ["peer", "view", "peer_ip", "rib", "peer_asn", "peer_bgp_id", "ts_router", "four_byte", "distinguisher"]


def outward(rib: Column) -> Column:
    return rib.startswith("out")


def in_context(messages: DataFrame) -> DataFrame:
    """Headed messages with sysname, sys_descr, `seq` within the view, `caps`, `tracked`; and a row of kind `lost` for
    each view that was up when its session closed. Messages that aren't framed or whose view isn't tracked count among
    the session's raw ones."""
    slice_ = [*SESSION, "slice"]
    m = headed(messages).withColumn("slice", F.shiftright("n", SLICE_BITS))
    both = F.struct(F.lit(True).alias("known"), F.col("open_four").alias("four_byte"), F.col("open_mp").alias("mp"), F.col("open_in").alias("inward"), F.col("open_out").alias("outward"))
    none = F.lit(None).cast("array<string>")
    lost = F.struct(F.lit(False).alias("known"), F.lit(None).cast("boolean").alias("four_byte"), none.alias("mp"), none.alias("inward"), none.alias("outward"))
    up, down = F.col("framed") & (F.col("type") == PEER_UP), F.col("framed") & (F.col("type") == PEER_DOWN)
    m = m.withColumns({"event": F.when(up & F.col("open_ok"), both).when(down, lost), "counted": ~F.col("type").isin(INITIATION, CLOSE)})
    m = m.withColumn("start", F.lit(None)).unionByName(starts(m.repartition(*slice_)), allowMissingColumns=True).repartition(*slice_)
    of_view, of_peer, whole = (Window.partitionBy(*slice_, *c).orderBy("n").rowsBetween(Window.unboundedPreceding, 0) for c in (["view"], ["peer"], []))
    m = m.withColumn("tracked", F.coalesce(F.col("framed") & F.first("start.listed", ignorenulls=True).over(of_view), F.lit(False)))
    event, last = F.when(F.col("tracked"), F.col("event")), lambda given, own: F.last(F.coalesce(F.col(f"start.{given}"), own), ignorenulls=True)
    m = m.withColumns({"seq": F.first("start.seq", ignorenulls=True).over(of_view) + F.count_if("tracked").over(of_view), "own": last("own", event).over(of_view), "shared": last("shared", event).over(of_peer)})
    raw = F.first("start.raw", ignorenulls=True).over(whole) + F.count_if(F.col("counted") & ~F.col("tracked")).over(whole)
    m = m.withColumns({"sysname": F.coalesce(last("name", F.col("told_name")).over(whole), F.lit("")), "sys_descr": F.coalesce(last("descr", F.col("told_descr")).over(whole), F.lit("")), "raw_seq": raw})
    m = m.where(F.col("start").isNull())
    used = F.when(F.coalesce(F.col("own.known"), F.lit(False)), F.col("own")).when(F.coalesce(F.col("shared.known"), F.lit(False)), F.col("shared"))
    m = m.withColumn("caps", caps_of(used))
    rows = m.drop("own", "shared", "event", "counted", "start", "slice", "told_name", "told_descr").withColumn("lost", F.lit(False))
    return rows.unionByName(lost_views(rows))


def starts(m: DataFrame) -> DataFrame:
    """For each slice of a session and each view in it a row before its messages, whose `start` says how things stand
    there: whether the view is one of those that are tracked, and numbers, events and texts so far. A slice is summed up
    by one row a view, and only those meet in a session's windows, never its messages."""
    n = F.col("n")
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("n", c))).alias(c)
    s = m.groupBy(*SESSION, "slice", "peer", "view").agg(
        F.min(F.when(F.col("framed"), n)).alias("first"), F.count_if("framed").alias("good"), F.count_if("counted").alias("all"), newest("event"), newest("told_name"), newest("told_descr")
    )
    s = s.withColumn("first", F.min("first").over(Window.partitionBy(*SESSION, "view")))
    rank = F.dense_rank().over(Window.partitionBy(*SESSION).orderBy(F.col("first").asc_nulls_last()))
    s = s.withColumn("listed", F.col("first").isNotNull() & (rank <= MOST_VIEWS))
    earlier = lambda *c: Window.partitionBy(*SESSION, *c).orderBy("slice").rangeBetween(Window.unboundedPreceding, -1)
    event, zero = F.when(F.col("listed"), F.col("event")), F.lit(0).cast("long")
    stand = {
        "listed": F.col("listed"), "seq": F.coalesce(F.sum(F.when(F.col("listed"), F.col("good"))).over(earlier("view")), zero), "own": F.max(event).over(earlier("view"))["event"], "shared": F.max(event).over(earlier("peer"))["event"],
        "raw": F.coalesce(F.sum(F.col("all") - F.when(F.col("listed"), F.col("good")).otherwise(0)).over(earlier()), zero), "name": F.max("told_name").over(earlier())["told_name"], "descr": F.max("told_descr").over(earlier())["told_descr"],
    }
    s = s.withColumns({f"_{name}": c for name, c in stand.items()})
    return s.select(*SESSION, "slice", "peer", "view", (F.shiftleft("slice", SLICE_BITS) - 1).alias("n"), F.struct(*(F.col(f"_{name}").alias(name) for name in stand)).alias("start"))


def caps_of(used: Column) -> Column:
    known = used.isNotNull()
    return F.struct(known.alias("known"), F.when(known, used["four_byte"]).otherwise(F.col("four_byte")).alias("four_byte"), used["mp"].alias("mp"), F.when(outward(F.col("rib")), used["outward"]).otherwise(used["inward"]).alias("add_path"))


def lost_views(rows: DataFrame) -> DataFrame:
    """For each closed session a row per view whose last word was that it is up."""
    closed = rows.where(F.col("type") == CLOSE).groupBy(*SESSION).agg(F.min("n").alias("closed_n"), F.min_by("ts_collector", "n").alias("closed_at"), F.min_by("sysname", "n").alias("last_name"), F.min_by("sys_descr", "n").alias("last_descr"))
    said = F.col("type").isin(PEER_UP, PEER_DOWN)
    views = rows.where("tracked").groupBy(*SESSION, "view").agg(
        F.max_by("type", F.when(said, F.col("n"))).alias("last_type"), F.max("seq").alias("last_seq"), F.max_by(F.struct(*(c for c in HEADER if c not in ("view", "ts_router"))), F.when(F.col("type") == PEER_UP, F.col("n"))).alias("h")
    )
    over = views.where(F.col("last_type") == PEER_UP).join(closed, SESSION)
    shown = {c: F.col(f"h.{c}") for c in HEADER if c not in ("view", "ts_router")} | {
        "n": F.col("closed_n"), "type": F.lit(CLOSE), "ts_collector": F.col("closed_at"), "ts_router": F.col("closed_at"), "seq": F.col("last_seq") + 1, "sysname": F.col("last_name"), "sys_descr": F.col("last_descr"), "lost": F.lit(True), "tracked": F.lit(True), "framed": F.lit(True), "raw_seq": F.lit(0).cast("long")
    }
    kinds = dict(rows.dtypes)
    return over.select(*SESSION, "view", *((shown[c] if c in shown else F.lit(None)).cast(kinds[c]).alias(c) for c in rows.columns if c not in (*SESSION, "view")))


# --- envelopes


def envelopes(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Envelopes of messages in context, as ingest takes them. Initiations and closes make none of their own; messages
    that can't be read are of kind `raw`, numbered within the session, and keep their bytes."""
    from pathloom.streaming.ingest import ENVELOPE_DDL

    kind, body = F.col("type"), F.col("body")
    whole = F.col("tracked") & (kind == ROUTE_MONITORING)
    m = rows.where(~(kind.isin(INITIATION, CLOSE) & ~F.col("lost"))).withColumn("caps_known", F.col("caps.known"))
    d = decode(m.withColumn("data", F.when(whole & (number(body, PEER_HEAD + 18, 1) == 2), piece(body, PEER_HEAD + BGP_HEAD))))
    found = platform(F.col("sys_descr"), of_router({k: F.lit(v[0]) for k, v in settings.identity.items()}, "string"), of_router({k: F.lit(v[1]) for k, v in settings.identity.items()}, "string"))
    d = d.withColumn("platform", found)
    usable = F.col("tracked") & (~whole | F.col("ok"))
    shown = F.when(~usable, "raw").when(whole, F.when(F.col("family").isin("ls"), "ls").otherwise("route")).when(kind == STATISTICS, "stats").otherwise("peer")
    missing = whole & ~F.coalesce(F.col("caps_known"), F.lit(False))
    off = F.coalesce(of_router({k: F.array(*map(F.lit, v)) for k, v in settings.disabled.items()}, "array<string>"), F.array().cast("array<string>"))
    raised = F.concat(
        F.when(missing, F.array(F.lit("caps_missing"))).otherwise(F.array().cast("array<string>")), F.when(whole & F.col("ok"), F.col("flags")).otherwise(F.array().cast("array<string>")),
        F.when((F.col("platform.vendor") != "") & F.col("platform.version").isNull(), F.array(F.lit("version_unparsed"))).otherwise(F.array().cast("array<string>")),
    )
    up = kind == PEER_UP
    nlri = lambda side: F.when(F.col("family").isin("lu4", "vpn4", "vpn6"), F.col(f"vpn_{side}")).otherwise(F.transform(side, lambda p: F.struct(p["prefix"].alias("prefix"), p["path_id"].alias("path_id"), F.lit("").alias("rd"), F.array().cast("array<bigint>").alias("labels"))))
    columns = {
        "router_sysname": F.col("sysname"), "seq": F.when(usable, F.col("seq")).otherwise(F.col("raw_seq")), "ts_router": F.col("ts_router"), "parse_flags": F.array_except(raised, off), "stream_seq": F.col("n"),
        "msg_id": F.concat_ws("/", address_token(F.col("router_ip")), F.when(usable, F.col("view")).otherwise("raw"), F.col("session_id").cast("string"), F.when(usable, F.col("seq")).otherwise(F.col("raw_seq")).cast("string")), "kind": shown, "announced": nlri("announced"), "withdrawn": nlri("withdrawn"),
        "as_path_segments": F.array("as_path"), "evpn_announced": F.col("evpn_announced"), "evpn_withdrawn": F.col("evpn_withdrawn"), "peer_kind": F.when(F.col("lost"), "view_lost").when(up, "up").when(kind == PEER_DOWN, "down"),
        "down_reason": F.when(kind == PEER_DOWN, F.coalesce(number(body, PEER_HEAD, 1), F.lit(0))).otherwise(F.lit(0)), "hold_time": F.when(up & F.col("open_ok"), F.col("open_hold")).otherwise(0), "hold_time_seen": F.coalesce((up & F.col("open_ok")).cast("int"), F.lit(0)),
        "mp_families": F.when(up, F.col("open_mp")), "addpath_families": F.when(up, F.when(outward(F.col("rib")), F.col("open_out")).otherwise(F.col("open_in"))), "counters": counters(F.when(usable & (kind == STATISTICS), piece(body, PEER_HEAD + 4))),
        "started_at": F.lit(None), "raw_body": F.when(~usable, body), "end_of_rib": F.when(whole & usable, F.col("end_of_rib")), "local_port": F.when(up, number(body, PEER_HEAD + 16, 2)), "remote_port": F.when(up, number(body, PEER_HEAD + 18, 2)), "cap_four_byte_as": F.when(up & F.col("open_ok"), F.col("open_four")),
        "local_ip": F.when(up, address(body, PEER_HEAD, number(body, 1, 1).bitwiseAND(F.lit(128)) != 0)),
    }
    return d.select(*((columns[f.name] if f.name in columns else F.col(f.name)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(ENVELOPE_DDL)))


def counters(data: Column) -> Column:
    """Counters of four or eight bytes by type, the last of a type; others are skipped."""
    own = F.filter(tlvs(data), lambda t: F.length(t["value"]).isin(4, 8))
    one = lambda t: F.create_map(t["code"].cast("long"), F.conv(F.hex(t["value"]), 16, 10).cast("decimal(20,0)"))
    return F.aggregate(own, F.create_map().cast("map<bigint,decimal(20,0)>"), lambda found, t: F.map_concat(F.map_filter(found, lambda k, _: k != t["code"]), one(t)))


def replay(messages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Envelopes of a log at rest."""
    return envelopes(in_context(messages), settings)


def of_capture(files: DataFrame, collector_id: str, router_ip: str, session_id: int, ts_collector: Column) -> DataFrame:
    """Capture messages as a session's, closed behind the last one."""
    rows = files.select(F.lit(collector_id).alias("collector_id"), F.lit(router_ip).alias("router_ip"), F.lit(session_id).cast("long").alias("session_id"), F.col("seq").alias("n"), "type", "body", ts_collector.alias("ts_collector"))
    end = rows.groupBy(*SESSION).agg((F.max("n") + 1).alias("n"), F.lit(CLOSE).alias("type"), F.lit(None).cast("binary").alias("body"), F.max("ts_collector").alias("ts_collector"))
    return rows.unionByName(end)
