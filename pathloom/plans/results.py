"""A question's answer for a reader: a bounded page in a total order, how many rows matched, and what to be warned of."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from pathloom.archive import Archive
from pathloom.functions.addresses import key
from pathloom.operators.session import PAIR, stale_pairs
from pathloom.plans.routes import Cursor, walk_page

PAGE, MOST = 1000, 10_000



def order_of(report: str) -> list[Column]:
    router, peer = key(F.col("router_ip")), key(F.col("peer_ip"))
    return {"dumps": [F.desc("archived"), router], "sessions": [F.desc("sessions"), router], "locrib": [F.desc("archived"), router, peer], "flags": [F.desc("envelopes"), F.col("flag")]}[report]


def clamp(limit: int | None) -> int:
    return PAGE if not limit or limit < 1 else min(limit, MOST)


def with_total(found: DataFrame, order: list[Column], limit: int | None = None) -> DataFrame:
    """The first rows, each with how many there are before the limit. Both sides read one aggregation's shuffle."""
    total = found.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.orderBy(*order).limit(clamp(limit)).withColumn("total_matched", total)


@dataclass(frozen=True)
class Warned:
    code: str
    message: str


@dataclass
class Answer:
    """`rows` is a page, MOST rows at most. `cursor` is where the next one begins, if there is one."""

    rows: list[Row]
    total_matched: int
    warnings: list[Warned] = field(default_factory=list)
    cursor: str | None = None

    def totals(self, *columns: str) -> dict[str, int]:
        """Sums over the page's rows."""
        return {c: sum(r[c] or 0 for r in self.rows) for c in columns}

    def codes(self) -> list[str]:
        return [w.code for w in self.warnings]


def warnings_of(archive: Archive | None, rows: list[Row], total: int) -> list[Warned]:
    out = []
    names = set(rows[0].__fields__) if rows else set()
    if any(r["dump_state"] == "dumping" for r in rows if "dump_state" in names) or any("dumping" in (r["dump_states"] or {}).values() for r in rows if "dump_states" in names):
        out.append(Warned("session_dumping", "a session has not sent its whole table yet: rows may be missing"))
    if archive is not None and set(PAIR) <= names:
        seen = {(r["collector_id"], r["router_ip"]) for r in rows}
        stale = {tuple(r) for r in stale_pairs(archive).where(F.col("router_ip").isin(sorted({router for _, router in seen}))).collect()}  # pairs of the page's routers
        if seen & stale:
            out.append(Warned("collector_stale", f"a collector has been silent for more than {archive.stale_after.total_seconds():.0f} s: its rows are its last view"))
    if total > len(rows):
        out.append(Warned("truncated", f"{len(rows)} of {total} rows are shown"))
    return out


def ask_page(archive: Archive, cursor: Cursor, limit: int | None = None) -> Answer:
    """A page of a RIB walk, with the next one's cursor. Pages are read at different times, of which every page warns;
    how many rows there are in all is not known."""
    page, more = walk_page(archive, cursor, clamp(limit))
    rows = page.collect()
    smear = Warned("paginated_smear", "pages are read one after another: a route that changes between them may be seen twice or not at all")
    return Answer(rows, len(rows), [*warnings_of(archive, rows, len(rows)), smear], None if more is None else more.encode())


def ask(found: DataFrame, order: list[Column], limit: int | None = None, archive: Archive | None = None) -> Answer:
    """Run a question: one pass, in which rows are counted on their way into the page. 0 matched when nothing is there."""
    counted = Observation()
    rows = found.observe(counted, F.count(F.lit(1)).alias("n")).orderBy(*order).limit(clamp(limit)).collect()
    total = counted.get["n"]
    return Answer(rows, total, warnings_of(archive, rows, total))
