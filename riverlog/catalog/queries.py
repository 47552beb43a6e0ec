"""One query per operator, each over whole given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riverlog.catalog import fixtures as X
from riverlog.functions.values import field_text
from riverlog.model import FIELDS, FieldRule, MatchRule, RedactRule, RenameRule, Route
from riverlog.operators import batching, buffer, dedup, envelope, multiline, observe, predicates, rate, rewrite, watermark
from riverlog.operators import route as routing
from riverlog.operators.parse import judged_lines, malformed_lines, parse_logs, to_json_lines
from riverlog.plans.commits import CommitLog
from riverlog.plans.job import build_job
from riverlog.plans.storage import filesystem, qualified, scratch_path, written
from riverlog.sinks.basic import FileSink, FilteredSink, RetrySink, RouterSink, write_each
from riverlog.sinks.basic import fan_out as fan_out_to
from riverlog.sinks.http import HttpSource
from riverlog.sinks.outlets import read_dead_letters
from riverlog.sinks.retry import RetryPolicy
from riverlog.sources.files import Source, read_logs, union_sources
from riverlog.sources.tail import tail_logs
from riverlog.streaming.counters import LiveCounters

Query = Callable[[SparkSession, str], DataFrame]

ARRIVAL = ("timestamp", "event_id")
HALF_DAY = 12 * 3600.0


def _number(name: str) -> Column:
    return F.try_variant_get(F.col(FIELDS).getItem(name), "$", "bigint").alias(name)


def _text(name: str, alias: str | None = None) -> Column:
    return field_text(name).alias(alias or name)


def _at() -> Column:
    return F.unix_micros("timestamp").alias("ts_us")


def _pair() -> Column:
    """A key that repeats: the user and what the user did."""
    return F.concat_ws(" ", field_text("user_id"), field_text("event_type"))


# -- sources ----------------------------------------------------------------


def scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scan")
    X.short_lines(spark, sf_dir).select("value").write.text(path)
    return read_logs(spark, path, "events").select("source", F.col("value").alias("line"))


def scan_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with byte positions; every line must start where one ended."""
    path = scratch_path(spark, "positions")
    X.short_lines(spark, sf_dir).select("value").write.text(path)
    lines = read_logs(spark, f"{path}/*.txt", with_position=True)
    size = F.octet_length("value") + 1
    per_file = lines.groupBy("file").agg(
        F.sum(size).alias("bytes"), F.max(F.col("pos") + size).alias("end"), F.count(F.lit(1)).alias("n")
    )
    return per_file.agg(
        F.sum("n").alias("lines"), F.sum("bytes").alias("bytes"), F.sum("end").alias("bytes_by_position")
    )


def tail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming source, run until it has read all there is."""
    path = scratch_path(spark, "tail")
    out = scratch_path(spark, "tail-out")
    X.short_lines(spark, sf_dir).select("value").write.text(path)
    lines = tail_logs(spark, f"{path}/*.txt", "events", start="earliest")
    query = (
        parse_logs(lines, now=X.now())
        .select("source", _number("event_id"), "level", _at())
        .writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "tail-state"))
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def tail_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream follows files that are then replaced by files of other lines, under
    the same names: it starts again at their first bytes and goes on after them."""
    folder, out, state = (scratch_path(spark, name) for name in ("rotate", "rotate-out", "rotate-state"))
    short = X.short_lines(spark, sf_dir)
    store, path = filesystem(qualified(spark, folder))

    def placed(third: int) -> None:
        staged = scratch_path(spark, "rotate-next")
        short.where(F.col("event_id") % 3 == third).select("value").write.text(staged)
        source, origin = filesystem(qualified(spark, staged))
        store.create_dir(path)
        found = [i.path for i in source.get_file_info(fs.FileSelector(origin)) if i.base_name.startswith("part-")]
        for number, name in enumerate(sorted(found)):
            store.move(name, f"{path}/{number}.log")

    for third in range(3):
        placed(third)
        lines = tail_logs(spark, f"{path}/*.log", "app", start="earliest")
        query = (
            parse_logs(lines, now=X.now())
            .select("source", _number("event_id"), "level")
            .writeStream.format("parquet")
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start(out)
        )
        query.awaitTermination()
    return spark.read.parquet(out).groupBy("source", "event_id", "level").agg(F.count(F.lit(1)).alias("times"))


def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, orders = scratch_path(spark, "events"), scratch_path(spark, "orders")
    X.short_lines(spark, sf_dir).select("value").write.text(events)
    X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string")).write.text(orders)
    lines, skipped = union_sources(
        spark,
        [Source(events, "app"), Source(orders, "shop"), Source(scratch_path(spark, "missing"), "gone")],
    )
    return lines.groupBy("source").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.octet_length("value")).alias("bytes"),
        F.lit(",".join(source.label for source in skipped)).alias("skipped"),
    )


# -- parse ------------------------------------------------------------------


def parse_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.logs(spark, sf_dir).select(
        "event_id",
        _at(),
        "level",
        "message",
        "source",
        _number("user_id"),
        _text("event_type"),
        F.try_variant_get(F.col(FIELDS).getItem("value"), "$", "double").alias("value"),
        _text("props"),
    )


def parse_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parse_logs(X.dirty_lines(spark, sf_dir), now=X.now())
    return entries.select("event_id", _at(), "level", "message", _number("user_id"))


def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return malformed_lines(X.dirty_lines(spark, sf_dir)).select("event_id", "source", "reason")


def raw_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parse_logs(X.dirty_lines(spark, sf_dir), now=X.now(), raw=True)
    return entries.select(
        "event_id",
        "level",
        # whole, but for the digits of the floating-point number in a line kept as it is
        F.regexp_replace("message", '"value":[^,}]*', '"value":').alias("text"),
        (F.col("message") == F.col("raw")).alias("is_line"),
        F.size(FIELDS).cast("bigint").alias("n_fields"),
    )


def entry_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = "timestamp string, level string, message string, source string, fields map<string,string>, raw string"
    entry = to_json_lines(X.logs(spark, sf_dir)).select(F.from_json("value", shape).alias("e"))
    return entry.select(
        F.col("e.timestamp").alias("timestamp"),
        F.col("e.level").alias("level"),
        F.col("e.message").alias("message"),
        F.col("e.source").alias("source"),
        F.col("e.fields")["user_id"].alias("user_id"),
        F.col("e.fields")["props"].alias("props"),
        F.array_join(F.map_keys("e.fields"), ",").alias("field_names"),
        F.col("e.raw").isNull().alias("no_raw"),
    )


# -- predicates -------------------------------------------------------------


def filter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        MatchRule("level", ["ERROR", "Warn"]),
        MatchRule("event_type", ["Purchase", "view"]),
    ]
    return predicates.filter_fields(X.logs(spark, sf_dir), rules).select("event_id", "level", _number("user_id"))


def min_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.min_level(X.logs(spark, sf_dir), "warn").select("event_id", "level")


def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.sample_logs(X.logs(spark, sf_dir), 0.1, seed=7, key="event_id").select("event_id")


def sample_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.sample_logs(X.logs(spark, sf_dir), 0.1, seed=99).select("event_id")


def sample_rand_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random sample: no row comes twice, none is made up, and its size is within
    six standard deviations of the rate; the same seed draws the same rows."""
    entries = X.logs(spark, sf_dir).select("event_id", "level")
    drawn, again = (written(predicates.sample_logs(entries, 0.1, seed=99), "drawn") for _ in range(2))
    total = entries.agg(F.count(F.lit(1)).alias("n"))
    size = drawn.agg(F.count(F.lit(1)).alias("k"), F.count_distinct("event_id").alias("ids"))
    strange = drawn.join(X.table(spark, sf_dir, "events").select("event_id"), "event_id", "left_anti").count()
    different = drawn.exceptAll(again).count()
    deviation = F.abs(F.col("k") - 0.1 * F.col("n"))
    return total.join(F.broadcast(size), F.col("k") <= F.col("n")).select(  # a row each
        (deviation <= 6 * F.sqrt(F.col("n") * 0.09)).alias("within_bounds"),
        (F.col("ids") == F.col("k")).alias("each_once"),
        F.lit(strange).cast("bigint").alias("strange"),
        F.lit(different).cast("bigint").alias("different"),
    )


def sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predicates.sample_stats(X.logs(spark, sf_dir), 0.25, seed=7, key="event_id")


# The dirty lines lack some fields, and hold numbers where text belongs.
_CONTRACT = [
    FieldRule("user_id", required=True, type="number"),
    FieldRule("event_type", required=True, type="string"),
    FieldRule("level", required=True),
    FieldRule("props", type="number"),
]


def schema_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parse_logs(X.dirty_lines(spark, sf_dir), now=X.now())
    return predicates.valid_entries(entries, _CONTRACT[:3]).select("event_id", "level")


def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = parse_logs(X.dirty_lines(spark, sf_dir), now=X.now())
    return predicates.schema_violations(entries, _CONTRACT).select("event_id", "violation")


def dedup_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup.dedup_window(X.logs(spark, sf_dir), HALF_DAY, _pair(), order=("event_id",))
    return kept.select("event_id", "message")


def dedup_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_bursts(X.logs(spark, sf_dir), HALF_DAY, _pair())


def dedup_live_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.dedup_live_size(X.logs(spark, sf_dir), HALF_DAY, _pair())


# -- rewrites ---------------------------------------------------------------


def add_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.add_field(rewrite.add_field(X.logs(spark, sf_dir), "env", "prod"), "event_type", "set")
    return out.select("event_id", _text("env"), _text("event_type"), F.size(FIELDS).cast("bigint").alias("n_fields"))


def remove_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.remove_field(rewrite.remove_field(X.logs(spark, sf_dir), "props"), "absent")
    return out.select("event_id", _text("props"), F.size(FIELDS).cast("bigint").alias("n_fields"))


def normalise_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.normalise_level(X.logs(spark, sf_dir)).select("event_id", "level")


def mask_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.mask_field(rewrite.mask_field(X.logs(spark, sf_dir), "user_id", "***"), "absent")
    return out.select("event_id", _text("user_id"), F.size(FIELDS).cast("bigint").alias("n_fields"))


def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = [
        functools.partial(rewrite.add_field, name="env", value="prod"),
        functools.partial(rewrite.mask_field, name="env", mask="hidden"),
        functools.partial(rewrite.remove_field, name="props"),
        rewrite.normalise_level,
    ]
    out = rewrite.apply_all(X.logs(spark, sf_dir), chain)
    return out.select("event_id", "level", _text("env"), F.size(FIELDS).cast("bigint").alias("n_fields"))


def redact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.redact(X.document_logs(spark, sf_dir), [RedactRule("origin"), RedactRule("absent")])
    return out.select("doc_id", _text("origin"), _text("lang"))


def redact_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [RedactRule("message", "@", "***"), RedactRule("lang", "^e"), RedactRule("n_chars", "[0-9]")]
    out = rewrite.redact(X.document_logs(spark, sf_dir), rules)
    return out.select("doc_id", "message", _text("lang"), _number("n_chars"))


def rename_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [
        RenameRule("user_id", "event_type"),
        RenameRule("event_type", "user_id"),
        RenameRule("level", "severity"),
        RenameRule("props", "source"),
    ]
    out = rewrite.rename_fields(X.logs(spark, sf_dir), rules)
    return out.select(
        "event_id", "level", "source", _text("user_id"), _text("event_type"), _text("severity"), _text("props")
    )


def truncate_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as bytes, in hex: a cut character is replaced by U+FFFD."""
    out = rewrite.truncate(X.document_logs(spark, sf_dir), {"message": 40, "lang": 5})
    return out.select("doc_id", F.hex(F.encode("message", "UTF-8")).alias("message_hex"), _text("lang"))


def timestamp_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rewrite.timestamp_text(X.logs(spark, sf_dir), "utc")
    out = rewrite.timestamp_text(out, "new_york", "America/New_York")
    out = rewrite.timestamp_text(out, "kolkata", "Asia/Kolkata")
    return out.select("event_id", _text("utc"), _text("new_york"), _text("kolkata"))


def envelope_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = envelope.wrap_envelopes(X.logs(spark, sf_dir), "events.log", ARRIVAL)
    return out.select("event_id", "seq", "envelope_source")


# -- several rows -----------------------------------------------------------


def multiline_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = multiline.coalesce_multiline(
        X.conversation_logs(spark, sf_dir), "message", ["\t"], ["conv_id"], ["turn"]
    )
    return out.select("conv_id", "turn", "message", _text("role"))


def batch_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batching.assign_batches(X.logs(spark, sf_dir), 25, order=ARRIVAL)
    return out.select("event_id", "source", "batch_id")


def batch_size_or_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = X.logs(spark, sf_dir).select("event_id", "timestamp", _number("user_id"))
    out = batching.assign_batches(entries, 4, 36 * 3600.0, ["user_id"], ARRIVAL)
    return out.select("event_id", "user_id", "batch_id")


def keep_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = X.logs(spark, sf_dir).withColumn("user_id", _number("user_id"))
    return buffer.keep_latest(entries, 5, ["user_id"], ARRIVAL).select("event_id", "user_id", "buffer_pos")


def keep_latest_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = buffer.keep_latest(X.logs(spark, sf_dir), 10, order=ARRIVAL, period=86400.0)
    return out.select("event_id", "source", "buffer_pos")


def buffer_flush_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job follows the lines and keeps the newest ten warnings of a day in the
    stream's state; a day is flushed when later days have come.  Two lines from
    far ahead end the last day."""
    lines, out, state = (scratch_path(spark, name) for name in ("flush-in", "flush-out", "flush-state"))
    short = X.short_lines(spark, sf_dir).select("value")
    buffered = {"type": "buffered", "capacity": 10, "by": ["source"], "flush_seconds": 86400, "inner": {"type": "file", "path": out}}
    spec = {
        "sources": [{"path": f"{lines}/*.txt", "label": "app"}],
        "sinks": [{"type": "router", "routes": [{"field": "level", "values": ["warn"], "sink": buffered}]}],
    }
    ahead = [spark.range(1).selectExpr(f"""'{{"ts":"{year}-01-01T00:00:00Z","level":"warn"}}' AS value""") for year in (2200, 2300)]
    for part in (short, *ahead):
        part.write.mode("append").text(lines)
        build_job(spec).start(spark, state, "earliest", {"availableNow": True}).awaitTermination()
    flushed = parse_logs(read_logs(spark, out, "out"), now=X.now())
    event_id = F.regexp_extract("message", "[0-9]+", 0).cast("bigint")
    return flushed.where("message <> ''").select(event_id.alias("event_id"), _at(), "level")


def rate_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rate.shape_rate(X.logs(spark, sf_dir), 0.001, 2, order=ARRIVAL)
    return out.select("event_id", "source", "release_at", "delay")


def _bigint_if_all_fit(df: DataFrame, name: str) -> DataFrame:
    """Whole numbers of up to 38 digits as ``bigint`` where each of them is one,
    left as they are where one is not."""
    df = written(df, name)
    small = F.col(name).try_cast("bigint")
    wide = df.where(F.col(name).isNotNull() & small.isNull()).limit(1).count()
    return df if wide else df.withColumn(name, small)


def rate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``total_delay`` is a ``bigint``, as in the SQL; where a total has more digits
    than that holds (and the SQL fails), all are ``decimal(38,0)``."""
    stats = rate.rate_stats(rate.shape_rate(X.logs(spark, sf_dir), 0.001, 2, order=ARRIVAL))
    return _bigint_if_all_fit(stats, "total_delay")


# -- routing and delivery ---------------------------------------------------

_ROUTES = [Route("level", ["error"], "alerts"), Route("event_type", ["purchase", "error"], "money")]


def route_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(X.logs(spark, sf_dir), _ROUTES).select("event_id", "route")


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = routing.route(X.logs(spark, sf_dir), _ROUTES, "rest")
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("entries"))


def file_sink_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "file-sink")
    FileSink(path).write(X.logs(spark, sf_dir))
    back = parse_logs(read_logs(spark, path, "file"), now=X.now())
    inner = F.col(FIELDS).getItem("fields")
    return back.select(
        _at(),
        "level",
        "message",
        _text("source", "origin"),
        F.try_variant_get(inner, "$.user_id", "bigint").alias("user_id"),
        F.try_variant_get(inner, "$.value", "double").alias("value"),
    )


class _Broken:
    """A sink that is down."""

    def write(self, entries: DataFrame, batch_id: int | None = None) -> None:
        raise OSError("disk full")


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two file sinks around one that fails: both get everything."""
    first, second = scratch_path(spark, "fan-a"), scratch_path(spark, "fan-b")
    entries = X.logs(spark, sf_dir)
    errors = write_each(
        entries, [("a", FileSink(first)), ("down", _Broken()), ("b", FileSink(second, ("level",)))]
    )
    lines = read_logs(spark, first, "a").unionByName(read_logs(spark, second, "b"))
    return lines.groupBy("source").agg(
        F.count(F.lit(1)).alias("lines"), F.lit("; ".join(errors)).alias("errors")
    )


def http_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines through the data source, a hundred to a request, into an outbox;
    read back from the requests, beside the totals of the commit messages."""
    outbox, report = (qualified(spark, scratch_path(spark, name)) for name in ("outbox", "http-report"))
    spark.dataSource.register(HttpSource)
    options = {"url": outbox, "per_request": "100", "report": report, "client": "riverlog.sinks.http:outbox_client"}
    lines = to_json_lines(X.logs(spark, sf_dir))
    lines.write.format(HttpSource.name()).mode("append").options(**options, **{"header.X-Team": "logs"}).save()
    shape = "array<struct<level string, message string, fields struct<user_id bigint>>>"
    bodies = spark.read.text(outbox, wholetext=True).select(F.explode(F.from_json("value", shape)).alias("e"))
    totals = spark.read.json(report).first()  # the only record: one sink, one batch
    found = bodies.groupBy(F.col("e.level").alias("level")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("e.fields.user_id").alias("users"),
        F.max("e.message").alias("last_message"),
    )
    return found.withColumns({name: F.lit(totals[name]).cast("bigint") for name in ("delivered", "failed")})


def _blocked(spark: SparkSession) -> str:
    """A folder that cannot be made: its parent is a file."""
    path = qualified(spark, scratch_path(spark, "blocker"))
    spark.range(1).selectExpr("'x' AS value").coalesce(1).write.text(path)
    store, folder = filesystem(path)
    files = [info.path for info in store.get_file_info(fs.FileSelector(folder)) if info.base_name.startswith("part-")]
    return f"{path}/{files[0].rpartition('/')[2]}/sink"


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors go to a sink that is down, the rest to one that works: three
    attempts, then every error entry is a dead letter, whole."""
    good, dead = scratch_path(spark, "delivered"), scratch_path(spark, "dead")
    down = RetrySink(FileSink(_blocked(spark), name="alerts"), RetryPolicy(3, base_delay=0.0), dead)
    router = RouterSink([Route("level", ["error"], "alerts")], {"alerts": down, "rest": FileSink(good)}, "rest")
    router.write(X.logs(spark, sf_dir))
    letters = read_dead_letters(spark, dead)
    delivered = read_logs(spark, good).select(F.lit("delivered").alias("sink"), "value", F.lit(None).cast("int").alias("attempts"))
    both = delivered.unionByName(letters.select("sink", F.col("entry").alias("value"), "attempts"))
    shape = "level string, message string, fields struct<user_id bigint, value double>"
    entry = both.withColumn("e", F.from_json("value", shape))
    return entry.select(
        "sink",
        F.col("attempts").cast("bigint").alias("attempts"),
        F.col("e.level").alias("level"),
        F.col("e.message").alias("message"),
        F.col("e.fields.user_id").alias("user_id"),
        F.col("e.fields.value").alias("value"),
    )


def one_pass_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sinks in one job: everything by level, a sample, two routes."""
    out = scratch_path(spark, "one-pass")
    sampled = FilteredSink(lambda: predicates.keep_expression(0.25, 7, "event_id"), FileSink(f"{out}/sample"))
    routes = {"alerts": FileSink(f"{out}/alerts"), "money": FileSink(f"{out}/money", ("source",))}
    fan_out_to(X.logs(spark, sf_dir), [FileSink(f"{out}/all", ("level",)), sampled, RouterSink(_ROUTES, routes)])
    shape = "level string, message string, fields struct<user_id bigint>"
    parts = []
    for name, folder in (("all", "level"), ("sample", None), ("alerts", None), ("money", "source")):
        rows = spark.read.text(f"{out}/{name}").withColumn("e", F.from_json("value", shape))
        label = F.lit("") if folder is None else F.col(folder).cast("string")
        parts.append(rows.select(F.lit(name).alias("sink"), label.alias("folder"), "e"))
    found = functools.reduce(DataFrame.unionByName, parts)
    return found.groupBy("sink", "folder").agg(
        F.count(F.lit(1)).alias("entries"),
        F.sum("e.fields.user_id").alias("users"),
        F.min("e.message").alias("first_message"),
    )


class _StopsBeforeCommit(CommitLog):
    """Stands for a driver that dies when the sinks have their entries."""

    def commit(self, batch_id: int, delivered: DataFrame) -> bool:
        raise InterruptedError("stopped before the commit")


def job_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job is stopped between sinks and commit, restarted, and run again after
    more lines came: each line is delivered once, and none is lost."""
    lines, out, commits = (scratch_path(spark, name) for name in ("resume-in", "resume-out", "resume-log"))
    short = X.short_lines(spark, sf_dir)
    spec = {"sources": [{"path": f"{lines}/*.txt", "label": "app"}], "sinks": [{"type": "file", "path": out}]}
    job = build_job(spec)
    for late in (False, True):
        short.where(F.col("event_id") % 3 == 2 if late else F.col("event_id") % 3 != 2).select("value").write.mode(
            "append"
        ).text(lines)
        for log in (_StopsBeforeCommit(spark, commits), CommitLog(spark, commits), CommitLog(spark, commits)):
            try:
                job.run(spark, log)
            except InterruptedError:
                pass
    delivered = parse_logs(read_logs(spark, out, "out"), now=X.now())
    return delivered.groupBy(F.regexp_extract("message", "[0-9]+", 0).cast("bigint").alias("event_id")).agg(
        F.count(F.lit(1)).alias("deliveries"), F.max("level").alias("level")
    )


def _last_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Watermarks for an arrival order that is not time."""
    entries = X.logs(spark, sf_dir).withColumn(
        "amount", F.try_variant_get(F.col(FIELDS).getItem("value"), "$", "double")
    )
    return watermark.delivery_watermark(entries, ("amount", "event_id"))


def delivery_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _last_by_value(spark, sf_dir).select("source", "watermark")


def incremental_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries arrive in ticks that do not follow their times; delivery stopped
    inside a tick, and one source was never delivered."""
    order = ("tick", "event_id")
    entries = X.logs(spark, sf_dir).withColumn("tick", F.col("event_id") % 100)
    delivered = entries.where("source <> 'svc0' AND (tick < 60 OR (tick = 60 AND event_id < 500))")
    marks = watermark.delivery_watermark(delivered, order)
    return watermark.resume_after(entries, marks, order).select("event_id", "source")


def spec_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, out = scratch_path(spark, "job-in"), scratch_path(spark, "job-out")
    X.short_lines(spark, sf_dir).select("value").write.text(lines)
    sampled = {
        "type": "sampled",
        "rate": 0.5,
        "seed": 3,
        "key": "message",
        "inner": {"type": "file", "path": f"{out}/sampled"},
    }
    newest = {"type": "buffered", "capacity": 20, "inner": {"type": "file", "path": f"{out}/newest"}}
    spec = {
        "sources": [{"path": lines, "label": "app"}],
        "sinks": [
            {
                "type": "router",
                "routes": [
                    {"field": "level", "values": ["error"], "sink": {"type": "file", "path": f"{out}/errors"}},
                    {"field": "level", "values": ["warn"], "sink": newest},
                ],
                "fallback": sampled,
            }
        ],
    }
    build_job(spec).run(spark)
    parts = [
        parse_logs(read_logs(spark, f"{out}/{name}", name), now=X.now())
        for name in ("errors", "newest", "sampled")
    ]
    return functools.reduce(DataFrame.unionByName, parts).select("source", "level", "message")


# -- observation ------------------------------------------------------------


def pipeline_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sinks: one takes info and above, one is down and would take errors."""
    judged = judged_lines(X.dirty_lines(spark, sf_dir), now=X.now())
    level = F.col("level")
    return observe.pipeline_counters(
        judged,
        F.col("reason").isNull(),
        level.isin("info", "warn", "error").cast("bigint"),
        (level == "error").cast("bigint"),
    )


def live_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job follows the dirty lines, one micro-batch after the other, and counts
    while it runs: info and above go to files, errors to a sink that is down."""
    lines, out, state, dead = (scratch_path(spark, name) for name in ("live-in", "live-out", "live-state", "live-dead"))
    dirty = X.dirty_lines(spark, sf_dir)
    files = {"type": "file", "path": out}
    down = {"type": "retry", "dead_letters": dead, "inner": {"type": "file", "path": _blocked(spark)}}
    levels = ("info", "warn", "error")
    spec = {
        "sources": [{"path": f"{lines}/*.txt", "label": "app"}],
        "sinks": [
            {"type": "router", "routes": [{"field": "level", "values": levels, "sink": files}]},
            {"type": "router", "routes": [{"field": "level", "values": ["error"], "sink": down}]},
        ],
    }
    counters = LiveCounters()
    for part in range(2):
        dirty.where(F.col("event_id") % 2 == part).select("value").write.mode("append").text(lines)
        job = build_job(spec)
        job.start(spark, state, "earliest", {"availableNow": True}, counters=counters).awaitTermination()
    counters.wait(batches=2)
    spark.streams.removeListener(counters)
    return counters.table(spark).drop("uptime_seconds")


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources are healthy within ten minutes of the newest entry."""
    status = observe.stale_status(X.logs(spark, sf_dir), 600.0)
    report = observe.health_report(status)
    names = F.transform(
        "components",
        lambda c: F.concat_ws(" ", c["name"], c["healthy"].cast("string"), c["detail"]),
    )
    return report.select("healthy", F.array_join(names, "; ").alias("components"))


def state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observe.state_transitions(X.file_polls(spark, sf_dir), order=("poll_us", "poll_id"))
    return out.select("path", "poll_id", "state")


def rotation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observe.rotation_events(X.file_polls(spark, sf_dir), order=("poll_us", "poll_id"))
    return out.select("path", "poll_id", "reason")


def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lines to entries, severe ones only, counted by level."""
    severe = predicates.min_level(X.logs(spark, sf_dir), "info")
    return (
        rewrite.normalise_level(severe)
        .groupBy("level", "source")
        .agg(F.count(F.lit(1)).alias("entries"), F.max(F.unix_micros("timestamp")).alias("last_us"))
    )


QUERIES: dict[str, Query] = {
    "level_counts": level_counts,
    "scan_lines": scan_lines,
    "scan_positions": scan_positions,
    "tail_lines": tail_lines,
    "tail_rotation": tail_rotation,
    "union_sources": union_of_sources,
    "parse_entries": parse_entries,
    "parse_dirty": parse_dirty,
    "malformed_lines": malformed,
    "raw_passthrough": raw_passthrough,
    "entry_json": entry_json,
    "filter_fields": filter_fields,
    "min_level": min_level,
    "sample_hash": sample_hash,
    "sample_rand": sample_rand,
    "sample_rand_bounds": sample_rand_bounds,
    "sample_stats": sample_stats,
    "schema_valid": schema_valid,
    "schema_violations": schema_violations,
    "dedup_window": dedup_window,
    "dedup_bursts": dedup_bursts,
    "dedup_live_size": dedup_live_size,
    "add_field": add_field,
    "remove_field": remove_field,
    "normalise_level": normalise_level,
    "mask_field": mask_field,
    "transform_chain": transform_chain,
    "redact_fields": redact_fields,
    "redact_pattern": redact_pattern,
    "rename_fields": rename_fields,
    "truncate_bytes": truncate_bytes,
    "timestamp_text": timestamp_text,
    "envelope_seq": envelope_seq,
    "multiline_coalesce": multiline_coalesce,
    "batch_by_size": batch_by_size,
    "batch_size_or_time": batch_size_or_time,
    "keep_latest": keep_latest,
    "keep_latest_daily": keep_latest_daily,
    "buffer_flush_stream": buffer_flush_stream,
    "rate_shape": rate_shape,
    "rate_stats": rate_stats,
    "route_entries": route_entries,
    "route_counts": route_counts,
    "file_sink_roundtrip": file_sink_roundtrip,
    "fan_out": fan_out,
    "http_delivery": http_delivery,
    "dead_letters": dead_letters,
    "one_pass_delivery": one_pass_delivery,
    "job_resume": job_resume,
    "delivery_watermark": delivery_watermark,
    "incremental_resume": incremental_resume,
    "spec_job": spec_job,
    "pipeline_counters": pipeline_counters,
    "live_counters": live_counters,
    "health_report": health_report,
    "state_transitions": state_transitions,
    "rotation_events": rotation_events,
}
