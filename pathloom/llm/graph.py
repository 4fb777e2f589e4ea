"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import release, settle


def components(edges: DataFrame) -> DataFrame:
    """node, comp (its component's smallest node) of every node of the edges (a, b: long).

    Rounds of contraction: each node points to the smallest of its neighbours and itself, pointers are followed twice,
    edges move to what their ends point to. Each round leaves less than half of the nodes of a component.
    """
    left = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.union(left.select("b", "a"))
        first = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("to")))
        to = first
        for _ in range(2):
            further = to.select(F.col("node").alias("to"), F.col("to").alias("next"))
            to = to.join(further, "to").select("node", F.col("next").alias("to"))
        to, before = settle(to), labels
        labels = to.withColumnRenamed("to", "comp") if before is None else settle(before.join(to.select(F.col("node").alias("comp"), "to"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        done, left = left, settle(left.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        release(done, first, *(() if before is None else (before, to)))
        if before is None and not left.isEmpty():
            kept = to
            labels = settle(labels)
            release(kept)
    return labels if labels is not None else edges.sparkSession.createDataFrame([], "node long, comp long")
