"""Newest row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order() -> Column:
    """Newest is by sequence and log position, never by a clock."""
    return F.struct("seq", "stream_seq")


def latest(rows: DataFrame, keys: list[str], columns: list[str], by: Column | None = None) -> DataFrame:
    """The newest row's values, nulls included, as one aggregation state."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order() if by is None else by).alias("_v")).select(*keys, "_v.*")


def newest_if(column: str, condition: Column, default: object = None) -> Column:
    """The value of the newest row for which the condition holds."""
    value = F.max_by(column, F.when(condition, order()))
    return (value if default is None else F.coalesce(value, F.lit(default))).alias(column)
