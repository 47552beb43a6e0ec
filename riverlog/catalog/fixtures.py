"""Log data made from the given tables, by Spark, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlog.functions.timestamps import micros, rfc3339
from riverlog.operators.parse import parse_logs

# The severity each kind of event is logged with.
SEVERITY = {
    "view": "debug",
    "click": "info",
    "signup": "info",
    "purchase": "warn",
    "error": "error",
}

# Processing time given to entries without a usable timestamp.
NOW = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def utc(df: DataFrame, name: str) -> Column:
    """A wall-clock column read as UTC, whatever the session zone."""
    kind = df.schema[name].dataType.simpleString()
    return F.timestamp_micros(micros(F.col(name), kind))


def severity() -> Column:
    chosen = None
    for kind, level in SEVERITY.items():
        test = F.col("event_type") == kind
        chosen = F.when(test, level) if chosen is None else chosen.when(test, level)
    return chosen


def source_label() -> Column:
    return F.concat(F.lit("svc"), (F.col("user_id") % 5).cast("string"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean JSON line per event, with its id and source label."""
    events = table(spark, sf_dir, "events")
    line = F.to_json(
        F.struct(
            rfc3339(utc(events, "ts")).alias("ts"),
            severity().alias("severity"),
            F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("msg"),
            "user_id",
            "event_type",
            "value",
            "props",
        )
    )
    return events.select("event_id", source_label().alias("source"), line.alias("value"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as entries; ``event_id`` is the arrival position."""
    return parse_logs(event_lines(spark, sf_dir), now=now())


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines, of which eight in twenty are broken or odd in some way."""
    clean = event_lines(spark, sf_dir)
    kind = F.col("event_id") % 20
    line = F.col("value")
    odd = (
        F.when(kind == 0, "")
        .when(kind == 1, F.concat(F.lit("plain "), F.col("event_id").cast("string")))
        .when(kind == 2, F.concat(line, F.lit(" x")))
        .when(kind == 3, F.concat(F.lit("["), line, F.lit("]")))
        .when(kind == 4, "null")
        .when(kind == 5, F.regexp_replace(line, '"ts":"[^"]*"', '"ts":1700000000'))
        .when(kind == 6, F.regexp_replace(line, '"severity":"[^"]*"', '"severity":3'))
        .when(kind == 7, F.concat(F.lit('{"user_id":-1,'), F.expr("substring(value, 2)")))
        .otherwise(line)
    )
    return clean.withColumn("value", odd)


def short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines without floating-point numbers, so that another engine can
    write the same bytes."""
    events = table(spark, sf_dir, "events")
    line = F.concat(
        F.lit('{"ts":"'),
        rfc3339(utc(events, "ts")),
        F.lit('","severity":"'),
        severity(),
        F.lit('","msg":"event '),
        F.col("event_id").cast("string"),
        F.lit('","event_id":'),
        F.col("event_id").cast("string"),
        F.lit(',"user_id":'),
        F.col("user_id").cast("string"),
        F.lit("}"),
    )
    return events.select("event_id", source_label().alias("source"), line.alias("value"))


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: the whole text is the message, the rest fields."""
    documents = table(spark, sf_dir, "documents")
    line = F.to_json(
        F.struct(F.col("text").alias("msg"), "lang", F.col("source").alias("origin"), "doc_id", "n_chars")
    )
    return parse_logs(documents.select("doc_id", line.alias("value")), source="documents", now=now())


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as entries; answers are marked as continuations by a tab."""
    turns = table(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "user", F.col("text")).otherwise(F.concat(F.lit("\t"), F.col("text")))
    line = F.to_json(F.struct(text.alias("msg"), "role"))
    lines = turns.select("conv_id", "turn", line.alias("value"))
    return parse_logs(lines, source="chat", now=now())


def file_polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders read as polls of one file per customer."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_custkey").alias("path"),
        micros(F.col("o_orderdate"), orders.schema["o_orderdate"].dataType.simpleString()).alias("poll_us"),
        F.col("o_orderkey").alias("poll_id"),
        (F.col("o_orderstatus") != "F").alias("available"),
        (F.col("o_orderkey") % 3).alias("inode"),
        F.floor("o_totalprice").alias("size"),
    )
