"""BMP captures to observations.

A capture is one session's messages end to end; a small generator finds their boundaries (each message's length tells
where the next begins, so that part is sequential), headers are expressions over fixed places, lists and UPDATEs are
parsed a batch at a time (`items`, `update`). Malformed input never raises: a message that doesn't parse is kept with a
flag. `sessions` puts messages in the context of their session.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from pathloom.functions.addresses import v6_text
from pathloom.sources.items import TLVS, listed, walk
from pathloom.sources.update import decode

VERSION, HEAD, PEER_HEAD, BGP_HEAD = 3, 6, 42, 19
MOST_BYTES = 1 << 20
ROUTE_MONITORING, STATISTICS, PEER_DOWN, PEER_UP, INITIATION = range(5)


def messages(files: DataFrame) -> DataFrame:
    """path, seq, type, body from rows of (path, content). A truncated tail still gives the messages before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                at, number_, rows = 0, 0, []
                while at + HEAD <= len(content):
                    size = int.from_bytes(content[at + 1 : at + 5], "big")
                    if content[at] != VERSION or not HEAD <= size <= MOST_BYTES or at + size > len(content):
                        break
                    rows.append((path, number_, content[at + 5], content[at + HEAD : at + size]))
                    at, number_ = at + size, number_ + 1
                    if len(rows) == 4096:
                        yield pd.DataFrame(rows, columns=["path", "seq", "type", "body"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "seq", "type", "body"])

    return files.select("path", "content").mapInPandas(run, "path string, seq long, type int, body binary")


def number(data: Column, at: Column | int, size: int) -> Column:
    """An unsigned big-endian number of up to seven bytes; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.length(data) >= at + size, F.conv(F.hex(F.substring(data, at + 1, F.lit(size))), 16, 10).try_cast("long"))


def piece(data: Column, at: Column | int, size: Column | int | None = None) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    size = F.greatest(F.length(data) - at, F.lit(0)) if size is None else F.lit(size) if isinstance(size, int) else size
    return F.substring(data, at + 1, size.cast("int"))


def v4(data: Column, at: int = 0) -> Column:
    return F.concat_ws(".", *(number(data, at + i, 1).cast("string") for i in range(4)))


def v6(data: Column) -> Column:
    return v6_text(F.hex(data))


def address(data: Column, at: int, is_v6: Column) -> Column:
    return F.when(is_v6, v6(piece(data, at, 16))).otherwise(v4(data, at + 12))


def peer_columns(body: Column) -> dict[str, Column]:
    kind, flags = number(body, 0, 1), number(body, 1, 1)
    bit = lambda mask: flags.bitwiseAND(F.lit(mask)) != 0
    direction, policy = F.when(bit(16), "out").otherwise("in"), F.when(bit(64), "post").otherwise("pre")
    micros = number(body, 34, 4) * 1_000_000 + number(body, 38, 4)
    return {
        "peer_ip": address(body, 10, bit(128)), "rib": F.when(kind == 3, "loc_rib").otherwise(F.concat_ws("_", direction, policy)), "peer_asn": number(body, 26, 4), "peer_bgp_id": v4(body, 30),
        "ts_router": F.timestamp_micros(micros), "four_byte": ~bit(32), "distinguisher": F.hex(piece(body, 2, 8)),
    }


def route_messages(found: DataFrame) -> DataFrame:
    """Route monitoring messages with the peer's columns and `data`, the UPDATE's body: null if the BGP header's length
    isn't that of the message or it is no UPDATE."""
    body = F.col("body")
    rows = found.where((F.col("type") == ROUTE_MONITORING) & (F.length("body") >= PEER_HEAD)).withColumns(peer_columns(body))
    fits = (number(body, PEER_HEAD + 16, 2) == F.length(body) - PEER_HEAD) & (number(body, PEER_HEAD + 18, 1) == 2)
    return rows.withColumn("data", F.when(fits, piece(body, PEER_HEAD + BGP_HEAD))).drop("body", "type")


def updates(found: DataFrame, add_path: Column | None = None) -> DataFrame:
    """A row per UPDATE without regard to its session: AS paths are read as the peer header says, path ids as told."""
    ids = F.when(F.lit(False) if add_path is None else add_path, F.array(F.lit("ipv4u"), F.lit("ipv6u"))).otherwise(F.array().cast("array<string>"))
    caps = F.struct(F.lit(True).alias("known"), F.col("four_byte").alias("four_byte"), F.array(F.lit("ipv4u")).alias("mp"), ids.alias("add_path"))
    return decode(route_messages(found).withColumn("caps", caps)).withColumnRenamed("flags", "parse_flags")


def peer_messages(found: DataFrame) -> DataFrame:
    """Peer Up and Peer Down: kind, reason, and of Peer Up the local address, ports and the smaller hold time."""
    body = F.col("body")
    rows = found.where(F.col("type").isin(PEER_UP, PEER_DOWN) & (F.length("body") >= PEER_HEAD)).withColumns(peer_columns(body))
    up, sent = F.col("type") == PEER_UP, PEER_HEAD + 20
    size = number(body, sent + 16, 2).cast("int")
    hold = F.least(number(body, sent + BGP_HEAD + 3, 2), number(body, F.lit(sent + BGP_HEAD + 3) + size, 2))
    return rows.select(
        "path", "seq", "peer_ip", "rib", "peer_asn", "peer_bgp_id", "ts_router", F.when(up, "up").otherwise("down").alias("kind"), F.when(~up, number(body, PEER_HEAD, 1)).otherwise(F.lit(0)).alias("down_reason"),
        F.when(up, v4(body, PEER_HEAD + 12)).alias("local_ip"), F.when(up, number(body, PEER_HEAD + 16, 2)).alias("local_port"), F.when(up, number(body, PEER_HEAD + 18, 2)).alias("remote_port"), F.when(up, hold).alias("hold_time"),
    )


TLV_LIST = ArrayType(StructType([StructField("code", IntegerType()), StructField("value", BinaryType())]))


def tlvs(data: Column) -> Column:
    """Codes and values; null if malformed."""

    @F.arrow_udf(TLV_LIST)
    def parse(column: pa.Array) -> pa.Array:
        items, bad = walk(column, TLVS)
        return listed(len(column), items.row, bad, pa.StructArray.from_arrays([pa.array(items.code, pa.int32()), pa.array(items.values(), pa.binary())], ["code", "value"]))

    return parse(data)


def initiations(found: DataFrame) -> DataFrame:
    text = lambda code: F.coalesce(F.get(F.filter("t", lambda x: x["code"] == code), 0)["value"].cast("string"), F.lit("")).alias({1: "sys_descr", 2: "router_sysname"}[code])
    return found.where(F.col("type") == INITIATION).withColumn("t", tlvs(F.col("body"))).select("path", "seq", text(1), text(2))


def statistics(found: DataFrame) -> DataFrame:
    """Counters of four or eight bytes; others are skipped."""
    body = F.col("body")
    rows = found.where(F.col("type") == STATISTICS).withColumns(peer_columns(body)).withColumn("t", F.filter(tlvs(piece(body, PEER_HEAD + 4)), lambda x: F.length(x["value"]).isin(4, 8)))
    entry = lambda x: F.struct(x["code"].cast("long"), F.conv(F.hex(x["value"]), 16, 10).cast("decimal(20,0)"))
    return rows.select("path", "seq", "peer_ip", "rib", "ts_router", F.map_from_entries(F.transform("t", entry)).alias("counters"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The messages of capture files; one file is one session and is read in order by one task."""
    return messages(spark.read.format("binaryFile").load(path))
