"""From documents to a tokenised training mix, in stages written one by one.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept.  Rows that are odd are treated as the stages' operators state: texts that
are null or empty fail the rules and go; rows without a doc_id stay; repeated
rows of one doc_id stay or go together; an empty table stays empty; columns
other than those of ``documents`` are dropped at the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riverlog.llm import mixing, near_dedup, pieces, quality_rules, substring_dedup
from riverlog.llm.catalog import piece_model
from riverlog.llm.tables import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    entries = quality_rules.ledger(docs.select(*COLUMNS))
    return quality_rules.apply_policy(entries, quality_rules.STRICT).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs.select(*COLUMNS))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.rewrite(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.copies_in_order(mixing.mix(docs.select(*COLUMNS)), COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(docs, piece_model())


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("mixing", mix_sources),
    ("pieces", encode),
]

# Signatures, hash order and merges have no SQL form; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
