"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import centroids, chat, fingerprints, jaccard_join, line_dedup, packing, page_text, periodic_runs, pii, piece_codec, quality_model, quality_rules, suffix_dedup
from pathloom.llm.common import table, vocabulary, whole_text

END_ID, CAPACITY, LEAST_SCORE = 2, 4096, 0.3


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("host_risk")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs, model, columns=["doc_id"])
    return scored.select("doc_id", quality_model.held_out().alias("held_out"), "score", (F.col("score") >= LEAST_SCORE).cast("int").alias("predicted"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_trick(table(spark, sf_dir, "conversations"))
    return chat.format_conversations(turns, with_text=False).drop("rewrites")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove(table(spark, sf_dir, "documents"), with_text=False)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), END_ID, CAPACITY, with_ids=False)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.digests(periodic_runs.detect(docs, periodic_runs.periodic_text(F.col("doc_id"), whole_text())))


def op12_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(table(spark, sf_dir, "pages")).drop("n_blocks", "n_main")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, seed=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_quality_rules, op3_jaccard_join, op4_pii, op5_quality_classifier, op6_chat_formatting, op7_suffix_dedup, op8_packing, op9_fingerprints, op10_sentencepiece, op11_periodic_runs, op12_page_text, op13_centroids)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict[str, str] = {"op2_quality_rules": quality_rules.ORACLE, "op3_jaccard_join": jaccard_join.ORACLE, "op6_chat_formatting": chat.ORACLE, "op12_page_text": page_text.ORACLE, "op13_centroids": centroids.oracle()}
