"""BGP UPDATEs to typed rows: attributes, routes of every family, link-state objects, and what went wrong.

The rules of RFC 7606: an attribute that says what a route is and doesn't parse turns the message's announcements into
withdrawals; another one is discarded. Lists whose own lengths don't add up make the message unusable (`ok` is false).
A family without a decoder, or a list that doesn't parse, keeps the attribute's bytes.

Bytes are parsed by one Arrow function, a batch of messages at a time; what the pieces mean together are expressions.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, LongType, StructField, StructType

from pathloom.schemas import DDL, ENVELOPE
from pathloom.sources import nlri
from pathloom.sources.items import ATTRIBUTES, SEGMENTS, WIDE_SEGMENTS, Items, column_bytes, listed, number_at, walk
from pathloom.sources.nlri import EVPN, PREFIX, VPN

#: What a peer's OPENs settled: whether they are known, four-byte ASes, families, families with path ids.
CAPS = "struct<known:boolean,four_byte:boolean,mp:array<string>,add_path:array<string>>"
ORIGIN, AS_PATH, NEXT_HOP, MED, LOCAL_PREF, ATOMIC, AGGREGATOR, COMMUNITIES = range(1, 9)
REACH, UNREACH, EXTENDED, LINK_STATE, LARGE = 14, 15, 16, 29, 32
#: Messages that are parsed at once.
ROWS_AT_ONCE = 2048
#: Attributes whose bytes other decoders take.
BYTES = {"path": AS_PATH, "communities": COMMUNITIES, "reach": REACH, "unreach": UNREACH, "extended": EXTENDED, "link_state": LINK_STATE, "large": LARGE}

#: Names of extended communities by type (several types share the first ones) and subtype.
COMMUNITY_NAMES = {
    (0, 2): "rt", (0, 3): "soo", (0, 5): "ospf-domain-id", (1, 2): "rt", (1, 3): "soo", (1, 5): "ospf-domain-id", (2, 2): "rt", (2, 3): "soo", (2, 5): "ospf-domain-id",
    (3, 11): "color", (3, 12): "encap", (6, 0): "mac-mobility", (6, 1): "esi-label", (6, 2): "es-import-rt", (6, 3): "router-mac", (6, 13): "default-gw", (64, 4): "link-bw",
    (128, 0): "ospf-route-type", (128, 1): "ospf-router-id", (128, 6): "flowspec-traffic-rate", (128, 7): "flowspec-traffic-action", (128, 8): "flowspec-redirect", (128, 9): "flowspec-traffic-marking",
}
VXLAN = 8


def flags_of(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def made(columns: dict[str, pa.Array], missing: np.ndarray | None = None) -> pa.Array:
    return pa.StructArray.from_arrays(list(columns.values()), names=list(columns), mask=None if missing is None else pa.array(missing))


def kind_of(**kinds: pa.DataType) -> StructType:
    return from_arrow_type(pa.struct(list(kinds.items())))


# --- sections and attributes

SECTIONS = kind_of(gone=pa.binary(), attributes=pa.binary(), announced=pa.binary())


def sections(column: pa.Array) -> pa.Array:
    """Withdrawn routes, attributes and announced routes of an UPDATE's body; null if its lengths don't add up."""
    out = []
    for b in column.to_pylist():
        gone = int.from_bytes(b[:2], "big") if b is not None and len(b) >= 4 else 1 << 20
        more = int.from_bytes(b[gone + 2 : gone + 4], "big") if gone < 1 << 20 else 0
        after = gone + 4 + more
        out.append((b[2 : gone + 2], b[gone + 4 : after], b[after:]) if b is not None and gone + 4 <= len(b) and after <= len(b) else None)
    return made({n: pa.array([o and o[k] for o in out], pa.binary()) for k, n in enumerate(("gone", "attributes", "announced"))}, np.array([o is None for o in out], bool))


def picked(items: Items, rows: int, code: int, first: bool = False) -> np.ndarray:
    """For each row the place of its last (or first) attribute of a type, or -1."""
    at, own = np.full(rows, -1), np.flatnonzero(items.code == code)
    own = own[::-1] if first else own
    at[items.row[own]] = own
    return at


PARTS = kind_of(
    origin=pa.int32(), next_hop=pa.string(), med=pa.int64(), local_pref=pa.int64(), wrong=pa.bool_(), discarded=pa.bool_(), last_mp=pa.int32(), only_unreach=pa.bool_(), none=pa.bool_(), **dict.fromkeys(BYTES, pa.binary())
)


def attributes(column: pa.Array) -> pa.Array:
    """The attributes by name, and whether one that decides on routes is wrong or another one is discarded; null if the
    list is malformed."""
    n = len(column)
    items, bad = walk(column, ATTRIBUTES)
    whole = items.data.tobytes()

    def bytes_at(at: np.ndarray) -> list[bytes | None]:
        return [None if k < 0 else whole[a : a + size] for k, a, size in zip(at.tolist(), items.start[at].tolist() if len(items.start) else [0] * n, items.length[at].tolist() if len(items.length) else [0] * n, strict=True)]

    own = {c: bytes_at(picked(items, n, c, c in (REACH, UNREACH))) for c in (ORIGIN, NEXT_HOP, MED, LOCAL_PREF, ATOMIC, AGGREGATOR, *BYTES.values())}
    sized = lambda v, *sizes: v is None or len(v) in sizes
    numbers = lambda c: [int.from_bytes(v, "big") if v is not None and len(v) == 4 else None for v in own[c]]
    twice = np.zeros(n, bool)
    for c in (REACH, UNREACH):
        twice |= np.bincount(items.row[items.code == c], minlength=n) > 1
    wrong = [not (sized(o, 1) and (o is None or o[0] <= 2) and sized(h, 4) and sized(m, 4)) for o, h, m in zip(own[ORIGIN], own[NEXT_HOP], own[MED], strict=True)]
    discarded = [not (sized(p, 4) and sized(a, 0) and sized(g, 6, 8)) for p, a, g in zip(own[LOCAL_PREF], own[ATOMIC], own[AGGREGATOR], strict=True)]
    mp = items.where(((items.code == REACH) & (items.length >= 5)) | ((items.code == UNREACH) & (items.length >= 3)))
    last_mp = np.zeros(n, np.int32)
    last_mp[mp.row] = mp.code
    count, unreach = np.bincount(items.row, minlength=n), items.where(items.code == UNREACH)
    size = np.zeros(n, np.int64)
    size[unreach.row] = unreach.length
    only = (count > 0) & (count == np.bincount(unreach.row, minlength=n)) & (size == 3)
    out = {
        "origin": pa.array([o[0] if o is not None and len(o) == 1 and o[0] <= 2 else None for o in own[ORIGIN]], pa.int32()), "next_hop": pa.array([nlri.v4(h) if h is not None and len(h) == 4 else None for h in own[NEXT_HOP]], pa.string()),
        "med": pa.array(numbers(MED), pa.int64()), "local_pref": pa.array(numbers(LOCAL_PREF), pa.int64()), "wrong": pa.array(np.array(wrong, bool) | twice), "discarded": pa.array(discarded, pa.bool_()),
        "last_mp": pa.array(last_mp), "only_unreach": pa.array(only), "none": pa.array(count == 0), **{name: pa.array(own[c], pa.binary()) for name, c in BYTES.items()},
    }
    return made(out, bad | column.is_null().to_numpy(zero_copy_only=False))


def as_path(column: pa.Array, wide: pa.Array) -> pa.Array:
    """All segments' ASes in one list; null if malformed or absent."""
    wide, missing = flags_of(wide), column.is_null().to_numpy(zero_copy_only=False)
    parts = []
    for layout, size, own in ((SEGMENTS, 2, ~wide), (WIDE_SEGMENTS, 4, wide)):
        items, bad = walk(pa.array([v if mine else None for v, mine in zip(column.to_pylist(), own.tolist(), strict=True)], pa.binary()), layout)
        items, bad = nlri.spoiled(items, bad, (items.code >= 1) & (items.code <= 4))
        step = np.arange(items.size.sum()) - np.repeat(np.cumsum(items.size) - items.size, items.size)
        parts.append(listed(len(column), np.repeat(items.row, items.size), bad | missing, pa.array(number_at(items.data, np.repeat(items.start, items.size) + size * step, size))))
    return pa.concat_arrays(parts).take(pa.array(np.arange(len(column)) + len(column) * wide))


def extended_community(b: bytes) -> str:
    """Eight bytes as `name:value`, or `type:subtype:value` without a name."""
    kind, sub = b[0], b[1]
    form = kind & 0x3F
    if (kind, sub) == (6, 3):
        value = nlri.mac(b[2:8])
    elif (kind, sub) == (6, 0):
        value = ("sticky," if b[2] & 1 else "") + f"seq={int.from_bytes(b[4:8], 'big')}"
    elif (kind, sub) == (3, 12):
        tunnel = int.from_bytes(b[6:8], "big")
        value = "vxlan" if tunnel == VXLAN else str(tunnel)
    elif form == 1:
        value = f"{nlri.v4(b[2:6])}:{int.from_bytes(b[6:8], 'big')}"
    elif form in (0, 2):
        value = "{}:{}".format(*struct.unpack("!HI" if form == 0 else "!IH", b[2:8]))
    else:
        value = "0x" + b[2:8].hex()
    return f"{COMMUNITY_NAMES.get((kind, sub), f'{kind}:{sub}')}:{value}"


COMMUNITY_LISTS = kind_of(plain=pa.list_(pa.int64()), extended=pa.list_(pa.string()), large=pa.list_(pa.string()), wrong=pa.bool_())


def communities(p: pa.Array, e: pa.Array, g: pa.Array) -> pa.Array:
    """The three kinds of communities, and whether one of the lists is no whole number of them."""

    def cut(v: bytes | None, size: int) -> list[bytes] | None:
        if v is None:
            return []
        return [v[k : k + size] for k in range(0, len(v), size)] if v and len(v) % size == 0 else None
    lists = [[cut(v, size) for v in column.to_pylist()] for column, size in ((p, 4), (e, 8), (g, 12))]
    wrong = [any(x is None for x in row) for row in zip(*lists, strict=True)]
    return made({
        "plain": pa.array([[int.from_bytes(b, "big") for b in x or ()] for x in lists[0]], pa.list_(pa.int64())), "extended": pa.array([[extended_community(b) for b in x or ()] for x in lists[1]], pa.list_(pa.string())),
        "large": pa.array([["{}:{}:{}".format(*struct.unpack("!III", b)) for b in x or ()] for x in lists[2]], pa.list_(pa.string())), "wrong": pa.array(wrong, pa.bool_()),
    })


# --- routes

GUESSED = kind_of(found=pa.list_(PREFIX), guessed=pa.bool_())


def prefixes_by_guess(column: pa.Array, known: pa.Array, paths: pa.Array) -> pa.Array:
    """IPv4 prefixes of a peer whose add-path setting may be unknown, and whether it was guessed from the bytes. Known
    path ids that don't fit are taken as none; with nothing known the framing that parses wins, and if both do, two
    entries of no length, which a list without path ids hardly has, speak for path ids. `found` is null if neither
    parses."""
    known, paths, n = flags_of(known), flags_of(paths), len(column)
    plain, no_plain, zeros = nlri.prefixes(column, 32, np.zeros(n, bool))
    with_ids, no_ids, _ = nlri.prefixes(column, 32, np.ones(n, bool))
    _, offsets = column_bytes(column)
    empty = np.diff(offsets) == 0
    guess = ~known & ~empty
    ids = np.where(known, paths & ~no_ids, guess & ~no_ids & (no_plain | (zeros >= 2)))
    return made({"found": pa.concat_arrays([plain, with_ids]).take(pa.array(np.arange(n) + n * ids)), "guessed": pa.array(guess | (known & paths & no_ids & ~no_plain & ~empty))})


MP = kind_of(
    family=pa.string(), hop=pa.string(), wrong=pa.bool_(), untyped=pa.bool_(), unknown_family=pa.bool_(), keep=pa.bool_(), plain=pa.list_(PREFIX), vpn=pa.list_(VPN), evpn=pa.list_(EVPN), ls=pa.binary()
)
DECODERS = {
    "ipv4u": ("plain", lambda c, p: nlri.prefixes(c, 32, p)[:2]), "ipv6u": ("plain", lambda c, p: nlri.prefixes(c, 128, p)[:2]), "lu4": ("vpn", lambda c, p: nlri.labelled(c, 32, False, p)),
    "vpn4": ("vpn", lambda c, p: nlri.labelled(c, 32, True, p)), "vpn6": ("vpn", lambda c, p: nlri.labelled(c, 128, True, p)), "evpn": ("evpn", nlri.evpn),
}


def mp(column: pa.Array, add_path: pa.Array, reach: bool) -> pa.Array:
    """An MP_REACH or MP_UNREACH by family: its lists, next hop, whether it is an error (`wrong`), whether some of it has
    no type or family here, and whether its bytes are to be kept."""
    n, values, negotiated = len(column), column.to_pylist(), add_path.to_pylist()
    out = {"family": [None] * n, "hop": [None] * n, "ls": [None] * n} | {k: np.zeros(n, bool) for k in ("wrong", "untyped", "unknown_family", "keep")}
    rows: dict[str, list[int]] = {}
    lists: dict[int, bytes] = {}
    for k, v in enumerate(values):
        if v is None:
            continue
        if len(v) < (5 if reach else 3):
            out["wrong"][k] = True
            continue
        family = out["family"][k] = nlri.family_name(*struct.unpack_from("!HB", v))
        at = 5 + v[3] if reach else 3
        out["unknown_family"][k] = family not in nlri.FAMILY_CODES
        if at > len(v):
            out["wrong"][k] = True
            out["keep"][k] = family != "ipv4u"
            out["untyped"][k] = family in nlri.FAMILY_CODES and family != "ipv4u"
            continue
        out["keep"][k] = out["unknown_family"][k]
        if reach and not out["unknown_family"][k]:
            hop = out["hop"][k] = nlri.next_hop(family, v[4 : at - 1])
            if hop is None:
                out["wrong" if family == "ipv4u" else "untyped"][k] = True
        if family == "ls":
            out["ls"][k] = v[at:]
        elif not out["unknown_family"][k]:
            rows.setdefault(family, []).append(k)
            lists[k] = v[at:]
    found = {}
    for name, kind in (("plain", PREFIX), ("vpn", VPN), ("evpn", EVPN)):
        place, parts, after = np.full(n, -1), [pa.array([[]], pa.list_(kind))], 1
        for family, own in rows.items():
            if DECODERS[family][0] != name:
                continue
            part, bad = DECODERS[family][1](pa.array([lists[k] for k in own], pa.binary()), np.array([family in (negotiated[k] or ()) for k in own], bool))
            own = np.array(own)
            out["wrong" if family == "ipv4u" else "untyped"][own[bad]] = True
            place[own[~bad]] = after + np.flatnonzero(~bad)
            parts.append(part.cast(pa.list_(kind)))
            after += len(part)
            if name == "evpn":
                other = ~np.isin(pc.struct_field(pc.list_flatten(part), "route_type").to_numpy(), (2, 3, 5))
                out["untyped"][own[pc.list_parent_indices(part).to_numpy()[other]]] = True
        found[name] = pa.concat_arrays(parts).take(pa.array(np.maximum(place, 0)))
    out["keep"] |= out["untyped"] & np.array([f != "ipv4u" for f in out["family"]], bool)
    kinds = {"family": pa.string(), "hop": pa.string(), "ls": pa.binary()}
    columns = {k: pa.array(v, kinds.get(k, pa.bool_())) for k, v in out.items()} | found
    return made({f.name: columns[f.name] for f in MP.fields})


#: Rows of link-state objects without the message's header.
OBJECTS = {what: DDL[f"ls_{what}"].removeprefix(ENVELOPE + ", ") for what in ("nodes", "links", "prefixes")}
KINDS = {nlri.LS_NODE: "nodes", nlri.LS_LINK: "links", nlri.LS_PREFIX: "prefixes", nlri.LS_PREFIX_V6: "prefixes"}


@cache
def object_type() -> StructType:
    lists = ", ".join(f"{what}: array<struct<{ddl}>>" for what, ddl in OBJECTS.items())
    return StructType.fromDDL(f"{lists}, unknown: boolean, undecoded: boolean, reach_bad: boolean, unreach_bad: boolean, attribute_bad: boolean")


def link_state(kind: StructType, reach: pa.Array, unreach: pa.Array, attribute: pa.Array) -> pa.Array:
    """Rows of the nodes, links and prefixes of both lists, with the message's attribute: unknown TLVs of the object win
    over those of the attribute, and so do its link ids. Whether any TLV is unknown, any object of another type, any of
    the three malformed (a malformed list gives no rows)."""
    arrow = to_arrow_type(kind)
    fields = {what: [f.name for f in kind[what].dataType.elementType.fields] for what in OBJECTS}

    def objects(data: bytes | None, out: dict, gone: int, attribute: dict) -> tuple[bool, bool]:
        found, undecoded = [], False
        for code, v in nlri.tlvs(data or b""):
            if code in KINDS:
                found.append((KINDS[code], nlri.ls_object(code, v)))
            else:
                undecoded = True
        unknown = any(o["unknown_tlvs"] for _, o in found)
        for what, o in found:
            row = attribute | {k: v for k, v in o.items() if v is not None} | {"unknown_tlvs": attribute["unknown_tlvs"] | o["unknown_tlvs"], "is_withdraw": gone}
            row["unknown_tlvs"] = list(row["unknown_tlvs"].items())
            row |= {c: row[c] or 0 for c in ("link_local_id", "link_remote_id")}
            out[what].append({c: row[c] for c in fields[what]})
        return unknown, undecoded
    rows = []
    for r, u, a in zip(reach.to_pylist(), unreach.to_pylist(), attribute.to_pylist(), strict=True):
        row: dict = {"nodes": [], "links": [], "prefixes": [], "unknown": False, "undecoded": False, "reach_bad": False, "unreach_bad": False, "attribute_bad": False}
        try:
            own = nlri.ls_attributes(a or b"")
        except nlri.Malformed:
            own, row["attribute_bad"] = nlri.ls_attributes(b""), True
        row["unknown"] = bool(own["unknown_tlvs"])
        for data, gone in ((u, 1), (r, 0)):
            part: dict = {"nodes": [], "links": [], "prefixes": []}
            try:
                unknown, undecoded = objects(data, part, gone, own)
                row |= {"unknown": row["unknown"] or unknown, "undecoded": row["undecoded"] or undecoded} | {w: row[w] + part[w] for w in part}
            except nlri.Malformed:
                row["unreach_bad" if gone else "reach_bad"] = True
        rows.append(row)
    return pa.array(rows, arrow)


# --- a message


@cache
def message_type() -> StructType:
    """What the bytes of a message say, as `parsed` returns it."""
    kept = StructType([f for f in PARTS.fields if f.name in ("reach", "unreach") or f.name not in BYTES])
    kinds = {"bare": BooleanType(), "a": kept, "new4": GUESSED, "gone4": GUESSED, "path": ArrayType(LongType()), "path_wrong": BooleanType(), "c": COMMUNITY_LISTS, "r": MP, "u": MP, "o": object_type()}
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


def children(a: pa.StructArray) -> dict[str, pa.Array]:
    """The fields of structs, null where these are."""
    return dict(zip([f.name for f in a.type], a.flatten(), strict=True))


def where_any(parse: Callable[..., pa.Array], own: tuple[pa.Array, ...], *more: pa.Array) -> pa.Array:
    """What `parse` makes of the rows in which one of the columns is not null; one row of nulls stands for all others."""
    some = ~np.logical_and.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in own])
    place = np.where(some, np.cumsum(some) - 1, some.sum())
    at = pa.array(np.flatnonzero(some))
    return parse(*(pa.concat_arrays([c.take(at), pa.nulls(1, c.type)]) for c in (*own, *more))).take(pa.array(place))


def parsed_rows(data: pa.Array, known: pa.Array, has_paths: pa.Array, add_path: pa.Array, four: pa.Array, kind: StructType) -> pa.Array:
    cut = sections(data)
    s = children(cut)
    parts = attributes(s["attributes"])
    a = children(parts)
    r, u = (where_any(lambda c, p, reach=side == "reach": mp(c, p, reach), (a[side],), add_path) for side in ("reach", "unreach"))
    path = as_path(a["path"], four)
    bare = pc.and_(pc.equal(pc.binary_length(s["gone"]), 0), pc.equal(pc.binary_length(s["announced"]), 0))
    kept = [f.name for f in kind["a"].dataType]
    out = {
        "bare": bare, "a": made({c: a[c] for c in kept}, parts.is_null().to_numpy(zero_copy_only=False)), "new4": prefixes_by_guess(s["announced"], known, has_paths), "gone4": prefixes_by_guess(s["gone"], known, has_paths),
        "path": path, "path_wrong": pc.and_(a["path"].is_valid(), path.is_null()), "c": where_any(communities, (a["communities"], a["extended"], a["large"])), "r": r, "u": u, "o": where_any(partial(link_state, kind["o"].dataType), (children(r)["ls"], children(u)["ls"], a["link_state"])),
    }
    return made(out)


def parsed(data: Column, known: Column, has_paths: Column, add_path: Column, four: Column) -> Column:
    """All that is read from a message's bytes, by one function: each of a chain of them would hold a Python process per
    task. Few rows are taken at a time, as lists are Python objects on their way."""

    kind = message_type()

    @F.arrow_udf(kind)
    def parse(data: pa.Array, known: pa.Array, has_paths: pa.Array, add_path: pa.Array, four: pa.Array) -> pa.Array:
        columns = (data, known, has_paths, add_path, four)
        return pa.concat_arrays([parsed_rows(*(c.slice(k, ROWS_AT_ONCE) for c in columns), kind) for k in range(0, max(len(data), 1), ROWS_AT_ONCE)])

    return parse(data, known, has_paths, add_path, four)


def flag(condition: Column, name: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def decode(messages: DataFrame) -> DataFrame:
    """Messages with `data` (an UPDATE's body) and `caps`; the other columns pass through. Added are ok, family,
    announced, withdrawn, vpn_announced, vpn_withdrawn, evpn_announced, evpn_withdrawn, ls_nodes, ls_links, ls_prefixes
    (with is_withdraw), the attributes, raw_reach, raw_unreach, end_of_rib and flags.

    Null or short data give `ok` false and empty lists. Where capabilities are unknown, `caps.four_byte` (null: true)
    still says how an AS path is read."""
    passed = [c for c in messages.columns if c not in ("data", "caps")]
    has_paths = F.coalesce(F.array_contains("caps.add_path", "ipv4u"), F.lit(False))
    known = F.coalesce(F.col("caps.known") & (has_paths | (F.size("caps.mp") > 0)), F.lit(False))
    m = parsed(F.col("data"), known, has_paths, F.col("caps.add_path"), F.coalesce(F.col("caps.four_byte"), F.lit(True)))
    u = messages.withColumn("m", m).select(F.struct(*passed).alias("given"), "m.*")  # columns given may have these names
    true = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False))
    either = lambda *conditions: reduce(lambda x, y: x | y, map(true, conditions))
    ok = F.col("a").isNotNull() & F.col("new4.found").isNotNull() & F.col("gone4.found").isNotNull()
    broken = either("a.wrong", "path_wrong", "c.wrong", "r.wrong", "u.wrong")
    u = u.withColumns({"ok": true(ok), "broken": broken})
    none = F.array()
    listed_ = lambda kind: {"fresh": F.coalesce(f"r.{kind}", none), "lost": F.coalesce(f"u.{kind}", none)}
    shown: dict[str, Column] = {}
    for prefix, kind in (("", "plain"), ("vpn_", "vpn"), ("evpn_", "evpn")):
        ends = listed_(kind)
        if kind == "plain":
            ends = {"fresh": F.concat(ends["fresh"], F.coalesce("new4.found", none)), "lost": F.concat(F.coalesce("gone4.found", none), ends["lost"])}
        usable = F.col("ok")
        shown[f"{prefix}announced"] = F.when(usable & ~F.col("broken"), ends["fresh"]).otherwise(none)
        shown[f"{prefix}withdrawn"] = F.when(usable, F.when(F.col("broken"), F.concat(ends["lost"], ends["fresh"])).otherwise(ends["lost"])).otherwise(none)
    for what in OBJECTS:
        folded = F.transform(f"o.{what}", lambda x: x.withField("is_withdraw", F.lit(1)))
        shown[f"ls_{what}"] = F.when(F.col("ok") & F.col("broken"), folded).when(F.col("ok"), F.col(f"o.{what}")).otherwise(none)
    bare = true(F.col("bare") & F.col("a.none"))
    ended = true(F.col("a.only_unreach") & (F.size("new4.found") == 0) & (F.size("gone4.found") == 0) & ~F.col("broken"))
    family = F.coalesce(F.when(F.col("a.last_mp") == REACH, F.col("r.family")).when(F.col("a.last_mp") == UNREACH, F.col("u.family")), F.lit("ipv4u"))
    undecoded = true("o.undecoded")
    flags = F.concat(
        flag(either("new4.guessed", "gone4.guessed"), "addpath_heuristic"), flag(F.col("broken"), "treat_as_withdraw"), flag(either("a.discarded", "o.attribute_bad"), "attr_discarded"), flag(either("r.unknown_family", "u.unknown_family"), "unknown_family"),
        flag(either("r.untyped", "u.untyped", "o.reach_bad", "o.unreach_bad"), "nlri_untyped"), flag(undecoded, "ls_nlri_undecoded"), flag(F.col("o.unknown"), "ls_tlv_unknown"),
    )
    raw = lambda side, bad: F.when(either(f"{side}.keep", bad, undecoded & F.col(f"{side}.ls").isNotNull()), F.col(f"a.{'reach' if side == 'r' else 'unreach'}"))
    return u.select(
        *(F.col(f"given.{c}").alias(c) for c in passed), "ok", family.alias("family"), *(c.alias(n) for n, c in shown.items()), F.coalesce("a.origin", F.lit(0)).cast("byte").alias("origin"), F.coalesce("path", none).alias("as_path"), F.coalesce("r.hop", "a.next_hop", F.lit("")).alias("next_hop"),
        F.col("a.med").alias("med"), F.col("a.local_pref").alias("local_pref"), F.coalesce("c.plain", none).alias("communities"), F.coalesce("c.extended", none).alias("ext_communities"), F.coalesce("c.large", none).alias("large_communities"),
        raw("r", "o.reach_bad").alias("raw_reach"), raw("u", "o.unreach_bad").alias("raw_unreach"), (F.col("ok") & (bare | ended)).alias("end_of_rib"), F.when(F.col("ok"), flags).otherwise(F.array(F.lit("undecodable"))).alias("flags"),
    )
