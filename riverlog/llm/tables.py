"""Intermediate tables in the shared folder, and small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlog.plans.storage import written

__all__ = ["read", "word_count", "word_list", "written"]

# The white space of the contracts, as code points 9 to 13 and 32.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_list(text: Column) -> Column:
    """Words of a text as an array; none for a null or blank text."""
    flat = F.trim(F.translate(text, BLANKS, " " * len(BLANKS)))
    return F.when(flat != "", F.split(flat, " +")).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK_RUN[1:]}")), F.lit(0)).cast("bigint")
