"""Filters of the questions, validated when built."""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, fields
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.functions import addresses, communities
from pathloom.functions.communities import BadFilter
from pathloom.functions.names import origin_asn
from pathloom.schemas import EVPN_TYPES, FAMILIES, PROTOCOLS, RIBS


def all_of(conditions: list[Column]) -> Column | None:
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def equals(filters: object, names: tuple[str, ...]) -> list[Column]:
    """Equality on each given value; none for those absent."""
    return [F.col(n) == F.lit(v) for n in names if (v := getattr(filters, n, None)) is not None]


def any_of(column: str, choices: list[str] | None) -> Column | None:
    """Whether a column is one of several choices, each a text or a pattern that it must match whole; None: all. Texts
    alone are compared as such, which reaches the scan."""
    if not choices:
        return None
    if not any(set(c) & set("\\^$|?*+()[]{}") for c in choices):
        return F.col(column).isin(*choices)
    try:
        for c in choices:
            re.compile(c)
    except re.error as e:
        raise BadFilter(f"{column} takes patterns: {choices!r}") from e
    return F.col(column).rlike("^(?:" + "|".join(choices) + ")$")


def one_text(address: str | None) -> str | None:
    """An address as tables write it."""
    if address is None:
        return None
    try:
        ip = ipaddress.ip_address(address)
    except ValueError as e:
        raise BadFilter(f"not an address: {address!r}") from e
    return str(getattr(ip, "ipv4_mapped", None) or ip)


def same_addresses(filters: object) -> list[Column]:
    """Router and peer by the address, however the filter writes it: tables hold its one text, which ingest sees to, so
    the comparison is one of texts and reaches the scan."""
    return [F.col(n) == F.lit(one_text(v)) for n in ("router_ip", "peer_ip") if (v := getattr(filters, n)) is not None]


@dataclass(frozen=True)
class RouteFilter:
    """None: no condition. `prefix` and `covers` exclude each other; without either and without a wide condition the
    empty prefix is meant, as for an unscoped lookup."""

    collector_id: str | None = None
    router_ip: str | None = None
    peer_ip: str | None = None
    rib: str | None = None
    family: str | None = None
    prefix: str | None = None
    covers: str | None = None
    rd: str | None = None
    route_type: int | None = None
    mac: str | None = None
    ip: str | None = None
    esi: str | None = None
    origin_asn: int | None = None
    through_asn: int | None = None
    community: str | None = None

    def __post_init__(self) -> None:
        if self.prefix is not None and self.covers is not None:
            raise BadFilter("prefix and covers exclude each other")
        if self.covers is not None:
            if "%" in self.covers:
                raise BadFilter("covers takes no zone")
            try:
                ipaddress.ip_address(self.covers)
            except ValueError as e:
                raise BadFilter(f"covers takes an address: {self.covers!r}") from e
        if self.rib is not None and self.rib not in RIBS:
            raise BadFilter(f"unknown rib {self.rib!r}")
        if self.family is not None and self.family not in FAMILIES:
            raise BadFilter(f"unknown family {self.family!r}")
        if self.route_type is not None and self.route_type not in EVPN_TYPES:
            raise BadFilter(f"unknown EVPN route type {self.route_type}")
        if self.community is not None:
            communities.parse(self.community)

    def narrow(self) -> list[Column]:
        """Conditions on what names a route: they may be applied to any observation."""
        own = equals(self, ("collector_id", "rib", "family", "prefix", "rd", "route_type", "mac", "ip", "esi")) + same_addresses(self)
        return own + ([addresses.covers(F.col("prefix"), self.covers)] if self.covers is not None else [])

    def wide(self) -> list[Column]:
        """Conditions on attributes: true of the newest observation only. On raw ones they pick a superset of keys."""
        own = [origin_asn() == self.origin_asn] if self.origin_asn is not None else []
        own += [F.array_contains("as_path", F.lit(self.through_asn).cast("long"))] if self.through_asn is not None else []
        return own + ([communities.carries(self.community)] if self.community is not None else [])

    def narrowed(self) -> bool:
        return any(getattr(self, f.name) is not None for f in fields(self) if f.name not in ("collector_id", "rib", "family"))


@dataclass(frozen=True)
class LinkStateFilter:
    collector_id: str | None = None
    router_ip: str | None = None
    peer_ip: str | None = None
    rib: str | None = None
    protocol: int | None = None
    asn: int | None = None
    area: int | None = None
    router_id: str | None = None
    state: str = "live"

    def __post_init__(self) -> None:
        if self.state not in ("live", "withdrawn", "any"):
            raise BadFilter(f"unknown state {self.state!r}")
        if self.protocol is not None and self.protocol not in PROTOCOLS:
            raise BadFilter(f"unknown protocol {self.protocol}")

    def narrow(self, ends: bool = False) -> list[Column]:
        """`ends`: of links, area, asn and router_id match either end. Area 0 is a value."""
        own = equals(self, ("collector_id", "rib", "protocol")) + same_addresses(self)
        for n in ("asn", "area", "router_id"):
            if (v := getattr(self, n)) is not None:
                own.append((F.col(f"local_{n}") == v) | (F.col(f"remote_{n}") == v) if ends else F.col(n) == v)
        return own

    def of_state(self) -> Column | None:
        return None if self.state == "any" else F.col("is_withdraw") == (1 if self.state == "withdrawn" else 0)


@dataclass(frozen=True)
class Window:
    """since <= ts_collector < until, absolute instants."""

    since: datetime | None = None
    until: datetime | None = None

    def conditions(self) -> list[Column]:
        own = [F.col("ts_collector") >= F.lit(self.since)] if self.since is not None else []
        return own + ([F.col("ts_collector") < F.lit(self.until)] if self.until is not None else [])

    def bounds(self) -> tuple[datetime | None, datetime | None]:
        return self.since, self.until

    def check_unscoped(self, as_of: datetime, most: timedelta | None) -> None:
        """Refuse a window that reaches further back than a read without a scope may."""
        if most is not None and (self.since is None or as_of - self.since > most):
            raise BadFilter(f"without a scope a window reaches back {most} at most")
