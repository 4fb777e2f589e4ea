"""Session state of a stream of BMP messages: what `sources.sessions` finds with windows, kept by key as messages come.

One key is one session. Kept are, per view, its last number, whether it is up and what its own OPENs settled; per peer
what any view's OPENs settled; and the router's texts. A close record, or a session that is silent for longer than the
transport's idle limit, loses the views that are up, in the order of their names. The state store must be one that keeps
maps (RocksDB).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from pathloom.sources.capture import INITIATION, PEER_DOWN, PEER_UP
from pathloom.sources.sessions import CLOSE, HEADER, MOST_VIEWS, SESSION, headed

#: What goes into the state's function, and what it adds.
IN = ["n", "type", "body", "ts_collector", *HEADER, "told_descr", "told_name", "framed", "open_ok", "open_four", "open_hold", "open_mp", "open_in", "open_out"]
ADDED = "sysname string, sys_descr string, seq long, raw_seq long, tracked boolean, lost boolean, known boolean, own_four boolean, own_mp array<string>, own_add_path array<string>"
_SETTLED = "known boolean, four boolean, mp array<string>, inward array<string>, outward array<string>"
_VIEW = f"seq long, up boolean, {_SETTLED}, peer string, peer_ip string, rib string, peer_asn long, peer_bgp_id string, four_byte boolean, distinguisher string"
_INFO = "sysname string, sys_descr string, raw_seq long, views long, last_n long"
NOTHING = (False, None, None, None, None)


class Sessions(StatefulProcessor):
    def __init__(self, columns: list[str], idle_ms: int | None):
        self.columns, self.idle_ms = columns, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.info = handle.getValueState("info", _INFO)
        self.views = handle.getMapState("views", "view string", _VIEW)
        self.peers = handle.getMapState("peers", "peer string", _SETTLED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("n", kind="stable")
        sysname, descr, raw, views, last = self.info.get() or ("", "", 0, 0, -1)
        out = []
        for r in batch.to_dict("records"):
            last = max(last, r["n"])
            if r["type"] == INITIATION and r["told_name"] is not None:
                sysname, descr = r["told_name"], r["told_descr"]
            if r["type"] == CLOSE:
                out.append(self.shown(key, r, sysname, descr, 0, raw, False, False, NOTHING))
                out += self.lose(key, r["n"], r["ts_collector"], sysname, descr)
                continue
            known = bool(r["framed"]) and self.views.containsKey((r["view"],))
            tracked = bool(r["framed"]) and (known or views < MOST_VIEWS)
            if not tracked:
                raw += r["type"] != INITIATION
                out.append(self.shown(key, r, sysname, descr, 0, raw, False, False, NOTHING))
                continue
            views += not known
            seq, up, *settled = self.views.getValue((r["view"],))[:7] if known else (0, False, *NOTHING)
            seq += 1
            if r["type"] == PEER_UP:
                up = True
                if r["open_ok"]:
                    settled = [True, r["open_four"], listed(r["open_mp"]), listed(r["open_in"]), listed(r["open_out"])]
                    self.peers.updateValue((r["peer"],), tuple(settled))
            elif r["type"] == PEER_DOWN:
                up, settled = False, list(NOTHING)
                if self.peers.containsKey((r["peer"],)):
                    self.peers.removeKey((r["peer"],))
            if not known or r["type"] in (PEER_UP, PEER_DOWN):
                head = tuple(r[c] for c in ("peer", "peer_ip", "rib", "peer_asn", "peer_bgp_id", "four_byte", "distinguisher"))
            else:
                head = tuple(self.views.getValue((r["view"],)))[7:]
            self.views.updateValue((r["view"],), (seq, up, *settled, *head))
            used = settled if settled[0] else self.peers.getValue((r["peer"],)) if self.peers.containsKey((r["peer"],)) else NOTHING
            out.append(self.shown(key, r, sysname, descr, seq, raw, True, False, used))
        self.info.update((sysname, descr, raw, views, last))
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame(out, columns=self.columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sysname, descr, _, _, last = self.info.get() or ("", "", 0, 0, -1)
        now = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
        yield pd.DataFrame(self.lose(key, last + 1, now, sysname, descr), columns=self.columns)

    def lose(self, key, n: int, at, sysname: str, descr: str) -> list[tuple]:
        """A row for each view that is up, which then is not."""
        out = []
        for (view,), v in sorted((tuple(k), tuple(v)) for k, v in self.views.iterator()):
            seq, up, *rest = v
            if up:
                self.views.updateValue((view,), (seq + 1, False, *rest))
                head = dict(zip(("peer", "peer_ip", "rib", "peer_asn", "peer_bgp_id", "four_byte", "distinguisher"), rest[5:], strict=True))
                row = dict.fromkeys(IN) | head | {"view": view, "n": n, "type": CLOSE, "ts_collector": at, "ts_router": at, "framed": True}
                out.append(self.shown(key, row, sysname, descr, seq + 1, 0, True, True, NOTHING))
        return out

    def shown(self, key, r: dict, sysname: str, descr: str, seq: int, raw: int, tracked: bool, lost: bool, used) -> tuple:
        known, four, mp, inward, outward = used
        own = {"known": bool(known), "own_four": four, "own_mp": listed(mp), "own_add_path": listed(outward if str(r["rib"]).startswith("out") else inward)}
        row = r | dict(zip(SESSION, key, strict=True)) | {"sysname": sysname, "sys_descr": descr, "seq": seq, "raw_seq": raw, "tracked": tracked, "lost": lost} | own
        return tuple(listed(row[c]) if c in ("open_mp", "open_in", "open_out") else row[c] for c in self.columns)


def listed(x) -> list | None:
    return None if x is None or isinstance(x, float) else list(x)


def in_context(messages: DataFrame, idle_seconds: int | None = None) -> DataFrame:
    """A stream's messages in context, with the columns of `sources.sessions.in_context`. With `idle_seconds` a session
    that is silent for so long loses its views."""
    m = headed(messages).select(*SESSION, *IN)
    out = StructType([*m.schema.fields, *StructType.fromDDL(ADDED).fields])
    rows = m.groupBy(*SESSION).transformWithStateInPandas(Sessions([f.name for f in out], None if idle_seconds is None else 1000 * idle_seconds), out, "Append", "None" if idle_seconds is None else "ProcessingTime")
    caps: Column = F.struct("known", F.when(F.col("known"), F.col("own_four")).otherwise(F.col("four_byte")).alias("four_byte"), F.col("own_mp").alias("mp"), F.col("own_add_path").alias("add_path"))
    return rows.withColumn("caps", caps).drop("known", "own_four", "own_mp", "own_add_path", "told_descr", "told_name")
