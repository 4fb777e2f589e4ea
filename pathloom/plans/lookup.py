"""AS names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.archive import Archive
from pathloom.functions.communities import BadFilter
from pathloom.schemas import DDL

MOST_ASNS = 512


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated dictionary (asn, name, country), rows that don't parse dropped."""
    return spark.read.schema(DDL["asnames"]).option("sep", "\t").option("mode", "DROPMALFORMED").csv(path)


def names_of(archive: Archive, asns: list[int]) -> DataFrame:
    """asn, name, country of each number asked for; empty texts where it is unlisted. `listed` tells them apart."""
    if len(set(asns)) > MOST_ASNS:
        raise BadFilter(f"at most {MOST_ASNS} numbers at once")
    asked = archive["asnames"].sparkSession.createDataFrame([(int(a),) for a in sorted(set(asns))], "asn long")
    known = archive["asnames"].join(F.broadcast(asked), "asn", "left_semi").withColumn("listed", F.lit(1))
    return asked.join(known, "asn", "left").select("asn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("name", "country")), F.coalesce("listed", F.lit(0)).alias("listed"))


def names_published(archive: Archive) -> DataFrame:
    """Whether there is a dataset at all: a missing one is not a missing name."""
    return archive["asnames"].agg((F.count(F.lit(1)) > 0).alias("published"), F.count(F.lit(1)).alias("names"))


def retention(archive: Archive) -> int:
    return archive.retention_days
