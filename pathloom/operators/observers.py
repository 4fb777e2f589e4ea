"""The best single observer: counts describe the network, so all measures of an entity come from one collector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def best_rows(per_collector: DataFrame, entity: list[str], total: str, measures: list[str]) -> DataFrame:
    """Per entity the measures of the collector with the most, ties to the greater name. Input: a row per (entity, collector)."""
    best = F.max_by(F.struct(*measures), F.struct(total, "collector_id")).alias("_b")
    return per_collector.groupBy(*entity).agg(best).select(*entity, "_b.*")


def best_over_window(rows: DataFrame, entity: list[str], total: str) -> DataFrame:
    """The rows of each entity's best collector, chosen once by its total over all of them (not bucket by bucket)."""
    summed = rows.withColumn("_w", F.sum(total).over(W.partitionBy(*entity, "collector_id")))
    rank = F.struct("_w", "collector_id")
    return summed.withColumn("_b", F.max(rank).over(W.partitionBy(*entity))).where(rank == F.col("_b")).drop("_w", "_b")
