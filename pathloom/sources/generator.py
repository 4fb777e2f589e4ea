"""Deterministic envelopes, for tests and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.streaming.ingest import ENVELOPE_DDL


def envelopes(spark: SparkSession, n: int, prefixes: int = 4, peers: int = 8) -> DataFrame:
    """n route messages of so many prefixes each, every fifth a withdrawal, dealt over peers."""
    ids = spark.range(n).withColumn("p", F.col("id") % peers)
    nlri = F.transform(F.sequence(F.lit(0), F.lit(prefixes - 1)), lambda k: F.struct(F.concat_ws("", F.lit("10."), (F.col("id") % 200).cast("string"), F.lit("."), k.cast("string"), F.lit(".0/24")).alias("prefix"), F.lit(0).cast("long").alias("path_id"), F.lit(None).cast("string").alias("rd"), F.lit(None).cast("array<long>").alias("labels")))
    gone, none = F.col("id") % 5 == 4, F.array().cast("array<struct<prefix:string,path_id:bigint,rd:string,labels:array<bigint>>>")
    made = {
        "collector_id": F.lit("c0"), "router_ip": F.lit("10.0.0.1"), "router_sysname": F.lit("r1"), "peer_ip": F.concat(F.lit("10.1.0."), F.col("p").cast("string")), "rib": F.lit("in_pre"), "peer_asn": 65000 + F.col("p"),
        "session_id": F.lit(1).cast("long"), "seq": F.col("id"), "stream_seq": F.col("id"), "ts_router": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")), "ts_collector": F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")),
        "parse_flags": F.array().cast("array<string>"), "msg_id": F.concat(F.lit("m"), F.col("id").cast("string")), "kind": F.lit("route"), "family": F.lit("ipv4u"), "announced": F.when(gone, none).otherwise(nlri), "withdrawn": F.when(gone, nlri).otherwise(none),
        "as_path_segments": F.array(F.array(65000 + F.col("p"), F.lit(64500).cast("long"), 64600 + F.col("id") % 7)), "ext_communities": F.array(F.lit("rt:65000:1")),
    }
    fields = [f.split(" ", 1) for f in _fields(ENVELOPE_DDL)]
    return ids.select(*(made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields))


def _fields(ddl: str) -> list[str]:
    """The fields of a DDL text, split at commas outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">") + (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(ddl[at:i].strip())
            at = i + 1
    return [*out, ddl[at:].strip()]
