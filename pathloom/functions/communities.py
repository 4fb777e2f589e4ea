"""Community notation: which columns a text can be in, and how numbers are shown."""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class BadFilter(ValueError):
    """A filter that can't be answered."""


def is_address(text: str) -> bool:
    try:
        ipaddress.ip_address(text)
    except ValueError:
        return False
    return True


def parse(text: str) -> list[tuple[str, int | str]]:
    """(column, value) pairs to search, any of which may hold it."""
    parts = text.split(":")
    if len(parts) < 2 or not all(parts):
        raise BadFilter(f"not a community: {text!r}")
    numeric = all(p.isascii() and p.isdigit() for p in parts)
    if len(parts) == 2:
        if numeric:
            hi, lo = map(int, parts)
            targets: list[tuple[str, int | str]] = [("route_targets", text)]
            return [("communities", hi << 16 | lo), *targets] if max(hi, lo) <= 65535 else targets
        if is_address(parts[0]):
            return [("route_targets", text), ("ext_communities", f"rt:{text}")]
        raise BadFilter(f"not a community: {text!r}")
    if numeric:
        return [("large_communities", text), ("ext_communities", text)] if len(parts) == 3 else [("ext_communities", text)]
    more = [("route_targets", text[3:])] if parts[0] == "rt" else []
    return [("ext_communities", text), *more]


def carries(text: str) -> Column:
    """Whether a route's live attributes carry the community."""
    hits = [F.array_contains(column, F.lit(value).cast("long") if isinstance(value, int) else F.lit(value)) for column, value in parse(text)]
    return reduce(lambda a, b: a | b, hits)


def shown(numbers: str) -> Column:
    """32-bit communities as hi:lo texts."""
    return F.transform(numbers, lambda c: F.concat_ws(":", F.shiftright(c, 16), c.bitwiseAND(F.lit(65535))))
