"""Delivery in one pass: retries, dead letters, isolation, replays, commits."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riverlog.model import Route, RuleError
from riverlog.plans.commits import KEEP, CommitLog
from riverlog.plans.job import build_job
from riverlog.sinks import outlets
from riverlog.sinks.basic import ConsoleSink, FanOutError, FileSink, FilteredSink, RetrySink, RouterSink, fan_out
from riverlog.sinks.http import HttpSink, HttpSource
from riverlog.sinks.retry import RetryPolicy
from riverlog.sources.files import read_logs
from riverlog.streaming.counters import LiveCounters


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


@pytest.fixture
def blocked(folder):
    """A path that cannot become a folder."""
    with open(folder + "/file", "w") as file:
        file.write("in the way")
    return folder + "/file/out"


def lines(count, level="info"):
    return ['{"ts":"2024-03-01T00:00:%02dZ","level":"%s","msg":"m%d","n":%d}' % (n % 60, level, n, n) for n in range(count)]


def messages(spark, path):
    return sorted(json.loads(row["value"])["message"] for row in read_logs(spark, path).collect())


def answering(statuses):
    """A client whose answers come in turn, then 200."""

    def client():
        left = list(statuses)
        return lambda url, body, headers: left.pop(0) if left else 200

    return client


# -- retries and dead letters -------------------------------------------------


def test_two_failures_then_success(make):
    sink = HttpSink("http://collector", retry=RetryPolicy(5, 0.0), client=answering([500, 503]))
    outcome = sink.outcome(make(*lines(1)))
    assert (outcome.delivered, outcome.failed, outcome.attempts, outcome.error) == (1, 0, 3, None)


def test_exhausted_http_entries_become_dead_letters(spark, make, folder):
    down = HttpSink("http://collector", per_request=2, client=answering([500] * 100))
    entries = make(*lines(5)).coalesce(1)
    RetrySink(down, RetryPolicy(3, 0.0), folder + "/dead").write(entries)
    letters = outlets.read_dead_letters(spark, folder + "/dead").collect()
    assert sorted(json.loads(row["entry"])["message"] for row in letters) == [f"m{n}" for n in range(5)]
    assert {(row["sink"], row["error"], row["attempts"]) for row in letters} == {
        ("http sink", "unexpected status 500 from http://collector", 3)
    }
    with pytest.raises(FanOutError, match="5 of 5 entries failed: all 3 attempts exhausted: unexpected status 500"):
        RetrySink(down, RetryPolicy(3, 0.0)).write(entries)


def test_file_and_routed_sinks_have_dead_letters(spark, make, folder, blocked):
    entries = make(*lines(3), *lines(2, "error"))
    RetrySink(FileSink(blocked), RetryPolicy(2, 0.0), folder + "/dead-file").write(entries)
    assert outlets.read_dead_letters(spark, folder + "/dead-file").count() == 5
    router = RouterSink(
        [Route("level", ["error"], "bad")], {"bad": FileSink(blocked, name="bad"), "rest": FileSink(folder + "/ok")}, "rest"
    )
    RetrySink(router, RetryPolicy(2, 0.0), folder + "/dead").write(entries)
    letters = outlets.read_dead_letters(spark, folder + "/dead").collect()
    assert [(row["sink"], row["attempts"], json.loads(row["entry"])["level"]) for row in letters] == [("bad", 2, "error")] * 2
    assert messages(spark, folder + "/ok") == ["m0", "m1", "m2"]


def test_own_sinks_are_retried_whole(make):
    calls = []

    class Flaky:
        def write(self, entries, batch_id=None):
            calls.append(batch_id)
            if len(calls) < 3:
                raise OSError("not yet")

    RetrySink(Flaky(), RetryPolicy(4, 0.0)).write(make(*lines(1)), 7)
    assert calls == [7, 7, 7]


def test_retry_in_a_job_description(spark, folder, blocked):
    os.makedirs(folder + "/in")
    with open(folder + "/in/a.log", "w") as file:
        file.write("\n".join(lines(4)) + "\n")
    sink = {"type": "retry", "retry": {"max_attempts": 2, "base_delay": 0}, "dead_letters": folder + "/dead"}
    spec = {"sources": [{"path": folder + "/in/*.log"}], "sinks": [{**sink, "inner": {"type": "file", "path": blocked}}]}
    build_job(spec).run(spark)
    assert outlets.read_dead_letters(spark, folder + "/dead").count() == 4
    for bad in ({"type": "retry"}, {**sink, "retry": {"max_attempts": 0}, "inner": {"type": "stdout"}}, {**sink, "retry": {"x": 1}, "inner": {"type": "stdout"}}):
        with pytest.raises(RuleError, match=r"sink\[0\]"):
            build_job({"sources": [{"path": "x"}], "sinks": [bad]})


# -- one pass -----------------------------------------------------------------


def test_one_pass_over_the_entries_and_isolated_errors(spark, make, folder, blocked):
    entries = make(*lines(40))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = entries.select("timestamp", "level", "message", "source", F.to_json("fields").alias("f"), "raw")
    counted = counted.mapInArrow(count, counted.schema).withColumn("fields", F.from_json("f", "map<string,variant>"))
    half = FilteredSink(lambda: F.col("message") < "m2", FileSink(folder + "/half"))
    sinks = [FileSink(folder + "/a"), FileSink(blocked), half, ConsoleSink(), FileSink(folder + "/a")]
    with pytest.raises(FanOutError, match="fanout errors: sink: 40 of 40 entries failed"):
        fan_out(counted, sinks)
    assert seen.value == 40
    assert messages(spark, folder + "/a") == sorted([f"m{n}" for n in range(40)] * 2)
    assert messages(spark, folder + "/half") == sorted(f"m{n}" for n in range(40) if f"m{n}" < "m2")
    assert not [name for name in os.listdir(folder + "/a") if name.startswith("_staged")]


def test_partition_folders_are_read_back(spark, make, folder):
    odd = ["a/b", "x=y", "100%", "é", "", "a b:c*"]
    entries = make(*lines(6)).withColumn("team", F.element_at(F.array(*map(F.lit, odd)), (F.col("pos") + 1).cast("int")))
    entries = entries.withColumn("team", F.when(F.col("team") != "", F.col("team")))
    fan_out(entries, [FileSink(folder + "/one", ("team",)), FileSink(folder + "/two", ("team", "level"))])
    for path in ("/one", "/two"):
        found = spark.read.text(folder + path).select("team", F.get_json_object("value", "$.message").alias("m")).collect()
        assert {(row["m"], row["team"]) for row in found} == {(f"m{n}", odd[n] or None) for n in range(6)}


def test_failed_job_leaves_nothing_and_replays_replace(spark, make, folder):
    entries = make(*lines(8))
    both = [FileSink(folder + "/x", name="x"), FileSink(folder + "/y", name="y")]
    fails = entries.withColumn("message", F.when(F.col("pos") == 5, F.raise_error(F.lit("lost"))).otherwise(F.col("message")))
    with pytest.raises(FanOutError, match="lost"):
        fan_out(fails, both)
    assert not os.path.exists(folder + "/x") or os.listdir(folder + "/x") == []
    for _ in range(2):
        fan_out(entries, both, batch_id=3)
    fan_out(entries.where("pos < 2"), both, batch_id=4)
    assert len(messages(spark, folder + "/x")) == len(messages(spark, folder + "/y")) == 10


def test_a_torn_file_keeps_what_was_delivered(folder):
    class Stream:
        def __init__(self, inner):
            self.inner, self.left = inner, 2

        def write(self, data):
            self.left -= 1
            if self.left < 0:
                self.inner.write(data[:3])
                raise OSError("disk full")
            self.inner.write(data)

        def close(self):
            self.inner.close()

    outlet = outlets.FileOutlet("torn", RetryPolicy(2, 0.0), path=folder + "/out")
    feed = outlets._Feed(outlet, "run", None, None, reached := outlets._Reached())
    reached.add(["s"] * 5)
    feed.put(["first"], [None], [0])
    stream, file = feed.channel.open[""]
    feed.channel.open[""] = Stream(stream), file
    for row, line in enumerate(("second", "third", "fourth", "fifth"), 1):
        feed.put([line], [None], [row])
    outlet.settle("run", feed.finish(), None)
    text = "".join(open(f"{folder}/out/{name}").read() for name in sorted(os.listdir(folder + "/out")))
    assert sorted(text.split()) == sorted(["first", "second", "third", "fourth", "fifth"])
    assert feed.outcome.delivered == 5 and feed.outcome.attempts == 6


# -- the http data source -----------------------------------------------------


def outbox_messages(folder):
    found = []
    for name in os.listdir(folder):
        body = json.load(open(f"{folder}/{name}"))
        found += [item["message"] for item in (body if isinstance(body, list) else [body])]
    return sorted(found)


CLIENT = "riverlog.sinks.http:outbox_client"


def test_batch_writes_through_the_format(spark, make, folder):
    spark.dataSource.register(HttpSource)
    rows = make(*lines(7)).select(F.to_json(F.struct("message")).alias("value")).coalesce(1)
    writer = rows.write.format("riverlog_http").mode("append")
    writer.options(url=folder + "/box", per_request=3, client=CLIENT, report=folder + "/report").save()
    assert outbox_messages(folder + "/box") == [f"m{n}" for n in range(7)] and len(os.listdir(folder + "/box")) == 3
    totals = spark.read.json(folder + "/report").first()
    assert (totals["delivered"], totals["failed"], totals["attempts"]) == (7, 0, 3)
    with pytest.raises(Exception, match="7 of 7 entries failed"):
        rows.write.format("riverlog_http").mode("append").options(url=__file__ + "/box", client=CLIENT).save()
    with pytest.raises(Exception, match="url is required"):
        rows.write.format("riverlog_http").mode("append").save()


def test_stream_writes_through_the_format(spark, folder):
    spark.dataSource.register(HttpSource)
    os.makedirs(folder + "/in")
    for number in range(3):
        with open(f"{folder}/in/{number}.txt", "w") as file:
            file.write(json.dumps({"message": f"m{number}"}) + "\n")
        query = (
            spark.readStream.text(folder + "/in")
            .writeStream.format("riverlog_http")
            .options(url=folder + "/box", client=CLIENT, report=folder + "/report", dead_letters=folder + "/dead")
            .option("checkpointLocation", folder + "/state")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    assert outbox_messages(folder + "/box") == ["m0", "m1", "m2"]
    reports = spark.read.json(folder + "/report").orderBy("batch").collect()
    assert [(row["batch"], row["delivered"]) for row in reports] == [(0, 1), (1, 1), (2, 1)]


# -- counters -----------------------------------------------------------------


def test_live_counters_equal_the_batch_counts(spark, folder, blocked):
    os.makedirs(folder + "/in")
    append(folder + "/in/a.log", *lines(6), "broken", *lines(3, "error"))
    append(folder + "/in/b.txt", *lines(2, "debug"), "{}", "[1]")
    routes = [{"field": "level", "values": ["error"], "sink": {"type": "file", "path": blocked}}]
    dead = {"type": "retry", "dead_letters": folder + "/dead", "inner": {"type": "router", "routes": routes}}
    info = {"type": "router", "routes": [{"field": "level", "values": ["info", "debug"], "sink": {"type": "file", "path": folder + "/out"}}]}
    spec = {"sources": [{"path": folder + "/in/*.log", "label": "app"}, {"path": folder + "/in/*.txt"}], "sinks": [info, dead]}
    counters = LiveCounters()
    for _ in range(2):
        job = build_job(spec)
        job.start(spark, folder + "/state", "earliest", {"availableNow": True}, counters=counters).awaitTermination()
        append(folder + "/in/a.log", *lines(2), "also broken")
    counters.wait(batches=2)
    found = {row["source"]: tuple(row)[1:-1] for row in counters.table(spark).collect()}
    # read, parsed, errors of parsing, written, failed, reached no sink
    assert found == {
        "app": (13, 11, 2, 8, 3, 5),
        folder + "/in/*.txt": (4, 3, 1, 2, 0, 2),
        "*": (17, 14, 3, 10, 3, 7),
    }
    spark.streams.removeListener(counters)


# -- buffers with a flush period ----------------------------------------------


def timed(minute, second, text, level="warn"):
    return json.dumps({"ts": f"2024-01-01T00:{minute:02d}:{second:02d}Z", "level": level, "msg": text})


def test_buffers_flush_when_their_period_is_over(spark, folder):
    buffered = {"type": "buffered", "capacity": 2, "flush_seconds": 60, "inner": {"type": "file", "path": folder + "/new"}}
    direct = {"type": "file", "path": folder + "/rest"}
    router = {"type": "router", "routes": [{"field": "level", "values": ["warn"], "sink": buffered}], "fallback": direct}
    retried = {"type": "retry", "retry": {"max_attempts": 2, "base_delay": 0}, "inner": router}
    spec = {"sources": [{"path": folder + "/*.log", "label": "app"}], "sinks": [{"type": "file", "path": folder + "/all"}, retried]}

    def flushed(*texts):
        append(folder + "/a.log", *texts)
        build_job(spec).start(spark, folder + "/state", "earliest", {"availableNow": True}).awaitTermination()
        return messages(spark, folder + "/new") if os.path.exists(folder + "/new") else []

    assert flushed(timed(0, 1, "a"), timed(0, 5, "b"), timed(0, 3, "c"), timed(0, 9, "i", "info")) == []
    # more of the same period, out of order, after a restart
    assert flushed(timed(0, 4, "d"), timed(0, 58, "x", "info")) == []
    assert flushed(timed(1, 1, "e")) == []
    # the next batch flushes the first minute: its two newest
    assert flushed(timed(3, 1, "g"), timed(1, 30, "f")) == ["b", "d"]
    assert flushed(timed(9, 0, "h")) == ["b", "d", "e", "f"]
    assert len(messages(spark, folder + "/all")) == 10 and messages(spark, folder + "/rest") == ["i", "x"]
    # what was delivered is marked by the lines themselves, not by later flushes
    assert CommitLog(spark, folder + "/state", "delivered").marks().first()["position"] > 0
    with pytest.raises(RuleError, match=r"sink\[0\]: flush_seconds"):
        build_job({"sources": [{"path": "x"}], "sinks": [{**buffered, "flush_seconds": 0}]})


# -- commits --------------------------------------------------------------------


class Stops(CommitLog):
    def commit(self, batch_id, delivered):
        raise InterruptedError("driver gone")


def append(path, *texts, newline=True):
    with open(path, "a") as file:
        file.write("\n".join(texts) + ("\n" if newline else ""))


def line(text):
    return json.dumps({"ts": "2024-03-01T00:00:00Z", "msg": text})


def job_over(folder):
    return build_job(
        {"sources": [{"path": folder + "/*.log", "label": "app"}], "sinks": [{"type": "file", "path": folder + "/out"}]}
    )


def test_runs_deliver_each_line_once(spark, folder):
    job, path = job_over(folder), folder + "/commits"
    append(folder + "/b.log", line("b1"), line("b2"))
    with pytest.raises(InterruptedError):
        job.run(spark, Stops(spark, path))
    # more comes before the restart, in a file that sorts in front, and half a line
    append(folder + "/a.log", line("a1"))
    append(folder + "/b.log", line("b3"), line("half")[:10], newline=False)
    job.run(spark, path)
    assert messages(spark, folder + "/out") == ["a1", "b1", "b2", "b3"]
    append(folder + "/b.log", line("half")[10:])
    append(folder + "/a.log", line("a2"))
    for _ in range(2):
        job.run(spark, path)
    assert messages(spark, folder + "/out") == ["a1", "a2", "b1", "b2", "b3", "half"]
    log = CommitLog(spark, path)
    assert log.latest() == 2
    assert {os.path.basename(row["file"]): row["position"] for row in log.marks().collect()}["a.log"] == len(line("a1")) + 1


def test_stream_stopped_between_sink_and_commit(spark, folder):
    job = job_over(folder)
    append(folder + "/a.log", line("1"), line("2"))
    state = folder + "/state"
    with pytest.raises(Exception, match="driver gone"):
        query = job.start(spark, state, "earliest", {"availableNow": True}, Stops(spark, state, "delivered"))
        query.awaitTermination()
    append(folder + "/a.log", line("3"))
    for text in ("4", "5"):
        job.start(spark, state, "latest", {"availableNow": True}).awaitTermination()
        append(folder + "/a.log", line(text))
    job.start(spark, state, "latest", {"availableNow": True}).awaitTermination()
    assert messages(spark, folder + "/out") == ["1", "2", "3", "4", "5"]
    log = CommitLog(spark, state, "delivered")
    assert log.watermarks().collect() == [("app", "2024-03-01T00:00:00.000000000Z")]
    with pytest.raises(RuleError, match="checkpoint"):
        job.start(spark, "")


def test_failed_delivery_commits_nothing(spark, folder, blocked):
    append(folder + "/a.log", line("1"))
    spec = {"sources": [{"path": folder + "/*.log"}], "sinks": [{"type": "file", "path": blocked}, {"type": "stdout"}]}
    with pytest.raises(FanOutError):
        build_job(spec).run(spark, folder + "/commits")
    assert CommitLog(spark, folder + "/commits").latest() is None


def test_commits_are_atomic_and_old_ones_are_forgotten(spark, make, folder):
    log = CommitLog(spark, folder, "one")
    entries = make(*lines(3), source="s").withColumn("file", F.lit("f"))
    assert log.marks().count() == 0 and not log.committed(0)
    assert log.commit(0, entries) and not log.commit(0, entries)
    assert not log._publish(0, {"batch": 0, "marks": "other"})
    assert [tuple(row) for row in log.marks().collect()] == [("s", "f", 2, "2024-03-01T00:00:02.000000000Z", 0)]
    for batch in range(1, KEEP + 3):
        assert log.commit(batch, entries.where("pos < 1") if batch == 5 else entries.limit(0))
    assert log.versions() == list(range(3, KEEP + 3)) and len(os.listdir(folder + "/one/marks")) == KEEP
    # the newest batch of a file counts, not its greatest place: the file was replaced
    assert log.marks().first()["position"] == 0 and log.marks().first()["batch"] == 5
    assert CommitLog(spark, folder, "two").latest() is None
