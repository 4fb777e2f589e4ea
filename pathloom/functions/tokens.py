"""Names of routers, peers and views in message ids: hex digits of addresses, and where a view's routes travel."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions.addresses import dotted, key, let, v6_text

#: Suffix of each view of a peer.
VIEWS = {"in_pre": "", "in_post": "-dpost", "out_pre": "-dout", "out_post": "-doutpost", "loc_rib": ""}
FNV_START, FNV_PRIME = 2166136261, 16777619


def address_token(address: Column) -> Column:
    """8 hex digits of an IPv4 address (mapped or not), 32 of another; `invalid` for what is none."""

    def shown(digits: Column) -> Column:
        return F.when(digits.isNull(), "invalid").when(digits.startswith("0" * 20 + "ffff"), F.substring(digits, 25, 8)).otherwise(digits)

    return let(F.lower(F.hex(key(address))), shown)


def token_address(token: Column) -> Column:
    """The address of a token; null if it is none. What follows a dash is left out."""
    return let(F.substring_index(token, "-", 1), lambda t: F.when(t.rlike("^[0-9a-f]{8}$"), dotted(t)).when(t.rlike("^[0-9a-f]{32}$"), v6_text(t)))


def fnv32(digits: Column, size: int) -> Column:
    """FNV-1a of so many bytes, given as hex digits."""
    byte = lambda i: F.conv(F.substr(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(FNV_START).cast("long"), lambda h, i: h.bitwiseXOR(byte(i)) * FNV_PRIME % (1 << 32))


def peer_token(digits: Column, rib: Column, distinguisher: Column) -> Column:
    """A peer's name, of its address in hex digits and its distinguisher in 16; the Loc-RIB's is the router's own."""
    own = F.when(rib == "loc_rib", "locrib").otherwise(F.lower(digits))
    return F.when(distinguisher.rlike("[^0]"), F.concat(own, F.lit("-r"), F.lower(F.lpad(F.hex(fnv32(distinguisher, 8)), 8, "0")))).otherwise(own)


def view_token(peer: Column, rib: Column) -> Column:
    suffix = F.lit("")
    for name, text in VIEWS.items():
        suffix = F.when(rib == name, text).otherwise(suffix)
    return F.concat(peer, suffix)
