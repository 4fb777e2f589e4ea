"""Addresses and prefixes as 16-byte keys, in built-in functions."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def v4_number(text: Column) -> Column:
    """A dotted quad as a number; null if it isn't one."""
    parts = F.split(text, r"\.")
    good = text.rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + F.coalesce(p.try_cast("long"), F.lit(0)))
    return F.when(good & F.forall(parts, lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255), number)


def v6_hex(text: Column) -> Column:
    """An IPv6 address as 32 hex digits; null if it isn't one."""
    tail = F.regexp_extract(text, r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1)
    quad = v4_number(tail)
    plain = F.when(tail == "", text).otherwise(F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(tail)), F.lower(F.hex(F.shiftright(quad, 16))), F.lit(":"), F.lower(F.hex(quad.bitwiseAND(F.lit(65535))))))
    halves = F.split(plain, "::")
    groups = lambda half: F.filter(F.split(F.coalesce(half, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(halves, 0)), groups(F.get(halves, 1))
    missing = 8 - F.size(left) - F.size(right)
    short = F.size(halves) == 2
    all_ = F.concat(left, F.when(short & (missing > 0), F.array_repeat(F.lit("0"), missing)).otherwise(F.array().cast("array<string>")), right)
    good = plain.contains(":") & (F.size(halves) <= 2) & ~plain.rlike(":::") & F.when(short, missing >= 1).otherwise(missing == 0) & F.forall(all_, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")) & ~plain.rlike("(^:[^:])|([^:]:$)")
    return F.when(good, F.lower(F.array_join(F.transform(all_, lambda g: F.lpad(g, 4, "0")), "")))


def key(text: Column) -> Column:
    """16 bytes that sort and compare as the address does; a v4 address is its mapped v6 one."""
    v4 = v4_number(text)
    return F.unhex(F.when(v4.isNotNull(), F.concat(F.lit("0" * 20 + "ffff"), F.lower(F.lpad(F.hex(v4), 8, "0")))).otherwise(v6_hex(text)))


def family(text: Column) -> Column:
    return F.when(v4_number(text).isNotNull(), 4).when(v6_hex(text).isNotNull(), 6)


def bits(key_: Column) -> Column:
    """A key as a string of 128 binary digits: a prefix of it is a network."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.lpad(F.conv(F.hex(F.substring(key_, i, F.lit(1))), 16, 2), 8, "0")), "")


def covers(prefix: Column, address: str) -> Column:
    """Whether a stored prefix contains the address: families must match, malformed rows never do and never raise."""
    ip = ipaddress.ip_address(address)
    if isinstance(ip, ipaddress.IPv6Address) and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    net, length = F.substring_index(prefix, "/", 1), F.substring_index(prefix, "/", -1)
    right = v4_number(net).isNotNull() if ip.version == 4 else v6_hex(net).isNotNull()
    size = F.when(right & length.rlike("^[0-9]{1,3}$") & prefix.rlike("^[^/]+/[0-9]+$"), length.try_cast("int"))
    width = 32 if ip.version == 4 else 128
    own = format(int(ip), f"0{width}b")
    net_bits = F.lpad(F.conv(v4_number(net).cast("string"), 10, 2), 32, "0") if ip.version == 4 else bits(F.unhex(v6_hex(net)))
    return F.coalesce(size.between(0, width) & (F.substr(net_bits, F.lit(1), F.least(size, F.lit(width))) == F.substr(F.lit(own), F.lit(1), F.least(size, F.lit(width)))), F.lit(False))


def dotted(hex8: Column) -> Column:
    """Eight hex digits as a dotted quad."""
    return F.concat_ws(".", *(F.conv(F.substring(hex8, 1 + 2 * i, 2), 16, 10) for i in range(4)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def v6_text(digits: Column) -> Column:
    """32 hex digits as an IPv6 address in its canonical text: the longest run of zero groups as `::`, a mapped IPv4
    address with its dotted quad."""

    def groups(d: Column) -> Column:
        return F.lower(F.regexp_replace(F.regexp_replace(F.concat(F.lit(":"), d), "([0-9a-fA-F]{4})", "$1:"), ":0{1,3}(?=[0-9a-fA-F])", ":"))

    def shortened(text: Column) -> Column:
        out = text
        for n in range(2, 9):  # later ones, which are longer, are asked first
            run = ":0" * n + ":"
            at = F.instr(text, run)
            out = F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit("::"), F.substr(text, at + len(run)))).otherwise(out)
        return F.regexp_replace(F.regexp_replace(out, "^:(?!:)", ""), "(?<!:):$", "")

    return let(digits, lambda d: F.when(F.lower(d).startswith("0" * 20 + "ffff"), F.concat(F.lit("::ffff:"), dotted(F.substring(d, 25, 8)))).otherwise(let(groups(d), shortened)))


def canonical(text: Column) -> Column:
    """An address in its one text: a dotted quad also for mapped ones, IPv6 in canonical text; others unchanged. Stored
    so, addresses compare as texts, and a comparison reaches the scan."""

    def shown(digits: Column) -> Column:
        mapped = digits.startswith("0" * 20 + "ffff")
        return F.when(digits.isNull(), text).otherwise(F.when(mapped, dotted(F.substring(digits, 25, 8))).otherwise(v6_text(digits)))

    return F.when(text.contains(":"), let(v6_hex(text), shown)).otherwise(text)
