"""What a router is, from the text it describes itself with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern of a platform's name, vendor and system, pattern of its version; the first that matches counts.
PLATFORMS = (
    ("NX-OS", "cisco", "nxos", "(?i)version ([0-9][0-9.()A-Za-z]*)"),
    ("Nexus[0-9]+", "cisco", "nxos", "(?i)version ([0-9][0-9.()A-Za-z]*)"),
    ("IOS[ -]?XR", "cisco", "iosxr", "Version ([0-9][0-9.]*)"),
    ("FRRouting", "frr", "frr", "FRRouting ([0-9][0-9.]*)"),
)


def dotted_version(text: Column) -> Column:
    """The first three numbers of a version, joined by dots; null without one."""
    numbers = F.slice(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), 1, 3)
    return F.when(F.size(numbers) > 0, F.array_join(F.transform(numbers, lambda n: F.coalesce(n.try_cast("long").cast("string"), n)), "."))


def platform(description: Column, vendor: Column | None = None, system: Column | None = None) -> Column:
    """Struct of vendor, os and version (null if none is found). A configured vendor and system outrank the text, of
    which then only the first line is searched for that system's version, or is the version."""
    out = F.struct(F.lit("").alias("vendor"), F.lit("").alias("os"), F.lit(None).cast("string").alias("version"))
    for name, v, o, version in reversed(PLATFORMS):
        line = F.regexp_extract(description, f"({name}[^\\r\\n]*)", 1)
        out = F.when(description.rlike(name), F.struct(F.lit(v).alias("vendor"), F.lit(o).alias("os"), dotted_version(F.regexp_extract(line, version, 1)).alias("version"))).otherwise(out)
    if vendor is None or system is None:
        return out
    first = F.regexp_extract(description, "^([^\\r\\n]*)", 1)
    found = F.when(first.rlike("^[0-9]+([.][0-9]+)*$"), dotted_version(first))
    for _, v, o, version in PLATFORMS:
        found = F.when((vendor == v) & (system == o) & first.rlike(version), dotted_version(F.regexp_extract(first, version, 1))).otherwise(found)
    return F.when(F.coalesce(vendor, F.lit("")) != "", F.struct(vendor.alias("vendor"), system.alias("os"), found.alias("version"))).otherwise(out)
