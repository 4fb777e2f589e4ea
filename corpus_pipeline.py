"""The corpus pipeline: quality classifier, line dedup, near-duplicate join, PII redaction, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents it leaves, with their columns; the last one returns
the packed pieces. Stages are written to the shared folder and read again, so a lost executor costs one stage at most.

Defined results: a null text is scored as an empty one, has one empty line and no shingles, and packs as the end id
alone; rows without a doc_id and rows that share one are documents of their own; of repeated rows one keeps its lines,
the others go if nothing is left of them; columns that documents do not have in common with the stages pass through
whatever their names; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import jaccard_join, line_dedup, packing, pii, quality_model
from pathloom.llm.common import KEY, keyed, release, settle, table, vocabulary

LEAST_SCORE, END_ID, CAPACITY = 0.3, 2, 4096
NEAR_ROWS = 500_000


def counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    return quality_model.score(docs, model, name="__score", least=LEAST_SCORE).drop("__score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which nothing is left."""
    own = {c: f"__own_{c}" for c in docs.columns if c in ("n_lines", "n_removed", "kept_sha256")}
    left = line_dedup.dedup(docs.withColumnsRenamed(own)).where("n_removed = 0 or text rlike '[^ \\\\t-\\\\r]'").drop("n_lines", "n_removed", "kept_sha256")
    return counted(left.withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the first by doc_id, then the table's order."""
    rows = keyed(docs)
    gone = settle(jaccard_join.grouped(rows).where("not stays").select(KEY))
    return rows.join(F.broadcast(gone) if gone.count() <= NEAR_ROWS else gone, KEY, "left_anti").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return counted(pii.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences, with their ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), END_ID, CAPACITY)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("packing", packed)]
#: No stage can be written in SQL; each is tested against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs)
            release(before)
    return docs
