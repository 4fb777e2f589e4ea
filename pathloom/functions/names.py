"""Names of codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.schemas import NO_LABEL, PROTOCOLS, RIBS

#: Peer-down reasons.
DOWN_REASONS = {1: "local_notification", 2: "local_no_notification", 3: "remote_notification", 4: "remote_no_notification", 5: "de_configured", 6: "local_vrf_or_tlv"}
#: EVPN route types.
EVPN_NAMES = {1: "ethernet-ad", 2: "mac-ip", 3: "imet", 4: "es", 5: "ip-prefix"}


def looked_up(code: Column, names: dict[int, str], other: str = "") -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(names.items())))
    return F.coalesce(F.try_element_at(table, code.cast("int")), F.lit(other))


def protocol(code: Column) -> Column:
    return looked_up(code, PROTOCOLS, "unknown")


def down_reason(kind: Column, code: Column) -> Column:
    return F.when(kind == "down", looked_up(code, DOWN_REASONS, "unknown")).otherwise("")


def rib_order(rib: Column) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(RIBS.items())))
    return F.try_element_at(table, rib)


def origin_asn(path: str = "as_path") -> Column:
    return F.coalesce(F.try_element_at(F.col(path), F.lit(-1)), F.lit(0))


def vpn_label(labels: str = "labels") -> Column:
    """The first label, unless there is none or it is the sentinel of a withdrawal."""
    first = F.get(F.col(labels), 0)
    return F.when(first != NO_LABEL, first)


def evpn_shown(kind: Column) -> Column:
    what = F.when(kind == 2, F.concat_ws(" ", "mac", F.when(F.col("ip") != "", F.col("ip")))).when(kind == 5, F.col("prefix")).when(kind == 3, F.concat(F.lit("tag "), F.col("ethernet_tag").cast("string"))).otherwise("")
    return F.concat_ws(" ", looked_up(kind, EVPN_NAMES, "type"), what)


def pseudonode() -> Column:
    """Whether a link-state router id is a pseudonode's, by protocol and length."""
    n = F.length("router_id")
    return (F.col("protocol").isin(1, 2) & (n == 14)) | (F.col("protocol").isin(3, 6) & (n == 16))
