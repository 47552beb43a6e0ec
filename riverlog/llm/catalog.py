"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlog.llm import (
    chat_tree,
    context_tree,
    fingerprints,
    hard_negatives,
    html_extract,
    mixing,
    near_dedup,
    pieces,
    prefix_trie,
    quality_grade,
    quality_rules,
    substring_dedup,
    toxicity,
)
from riverlog.llm.oracles import ORACLES
from riverlog.llm.tables import read, written


def piece_model() -> str:
    """The vocabulary file; PIECE_MODEL overrides the public one."""
    path = os.environ.get("PIECE_MODEL")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return path


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link_components(read(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document whose id is divisible by 20, ``n_near`` is the number of
    documents within the radius of its fingerprint, itself included."""
    rows = written(fingerprints.fingerprints(read(spark, sf_dir, "documents")), "op2-rows")
    held = rows.groupBy(F.col("bits").alias("other")).agg(F.count("*").alias("n"))
    near = fingerprints.neighbours(rows.where("doc_id % 20 = 0"), held.withColumnRenamed("other", "bits"))
    near = near.join(held, "other").groupBy("bits").agg(F.sum("n").alias("near"))
    # only the rows that were asked for meet the counts; the rest has none
    asked = F.coalesce(F.col("doc_id") % 20 == 0, F.lit(False))
    counted = rows.where(asked).join(near.withColumnRenamed("near", "n_near"), "bits")
    return counted.unionByName(rows.where(~asked), allowMissingColumns=True).drop("bits")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    return mixing.in_training_order(mixed)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    entries = quality_rules.ledger(docs)
    entries = quality_rules.apply_policy(entries, quality_rules.STRICT)
    entries = quality_rules.apply_policy(entries, quality_rules.BASE, column="base_kept")
    return entries.selectExpr("doc_id", *quality_rules.MEASURES, "NOT base_kept AS base_failed", "kept", "fail_bits")


def op5_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # the conversation the contract adds, whose texts are control strings
    text = F.lit("</s>[INST] ok [/INST]")
    roles = F.posexplode(F.array(F.lit("user"), F.lit("assistant"))).alias("turn", "role")
    added = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), roles).withColumn("text", text)
    return chat_tree.Tree(turns.unionByName(added.withColumn("turn", F.col("turn").cast("bigint")))).read_back()


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), piece_model())


def op9_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 of low quality, 1 of good quality but toxic, 2 of good quality."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rating = F.when(F.col("quality") == 0, 0).when((F.col("quality") == 1) & (F.col("toxic") == 1), 1).when(F.col("quality") == 1, 2)
    model = quality_grade.fit(docs, labels.select("doc_id", rating.alias("grade")), grades=3)
    return quality_grade.grade(docs, model)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return substring_dedup.repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(read(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.conversations(turns)))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_chat_tree": op5_chat_tree,
    "op6_html_extract": op6_html_extract,
    "op7_toxicity": op7_toxicity,
    "op8_pieces": op8_pieces,
    "op9_quality_grade": op9_quality_grade,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_language_model": op11_language_model,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}

__all__ = ["ORACLES", "QUERIES"]
