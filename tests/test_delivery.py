import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from riverlog.model import RuleError
from riverlog.operators.observe import health_report, pipeline_counters
from riverlog.operators.watermark import delivery_watermark, resume_after
from riverlog.plans.job import build_job
from riverlog.sinks.basic import ConsoleSink, FanOutError, FileSink, fan_out
from riverlog.sinks.http import DeliveryError, HttpSink
from riverlog.sinks.retry import RetriesExhausted, RetryPolicy
from riverlog.sources.files import Source, read_logs, union_sources


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


class Capture:
    def __init__(self, error=None):
        self.messages, self.error = [], error

    def write(self, entries, batch_id=None):
        if self.error:
            raise RuntimeError(self.error)
        self.messages += [r["message"] for r in entries.collect()]


# -- retry ------------------------------------------------------------------


def failing(times):
    calls = []

    def action():
        calls.append(1)
        if len(calls) <= times:
            raise OSError(f"failure {len(calls)}")
        return "ok"

    return action, calls


def test_retry_until_success():
    action, calls = failing(2)
    pauses = []
    assert RetryPolicy(5, 0.1).run(action, pauses.append) == "ok"
    assert len(calls) == 3 and pauses == pytest.approx([0.1, 0.2])


def test_retry_exhausted():
    action, calls = failing(9)
    with pytest.raises(RetriesExhausted, match="exhausted: failure 3") as caught:
        RetryPolicy(3, 0.001, 0.005).run(action, lambda _: None)
    assert len(calls) == 3 and str(caught.value.__cause__) == "failure 3"


def test_retry_options():
    assert [RetryPolicy(9, 1, 5, 2).delay(k) for k in range(4)] == [1, 2, 4, 5]
    assert RetryPolicy(9, 1, multiplier=0.5).delay(2) == 4
    with pytest.raises(RuleError):
        RetryPolicy(0)


# -- fan-out and simple sinks -----------------------------------------------


def test_fan_out_isolates_errors(make):
    df = make('{"msg":"a"}', '{"msg":"b"}')
    good, late = Capture(), Capture()
    with pytest.raises(FanOutError, match="fanout errors: err-a; err-b"):
        fan_out(df, [Capture("err-a"), good, Capture("err-b"), late])
    assert sorted(good.messages) == sorted(late.messages) == ["a", "b"]
    fan_out(df, [])


def test_console(make):
    out = []
    ConsoleSink(out=out.append).write(make('{"msg":"a","level":"info"}'))
    assert json.loads(out[0])["message"] == "a" and len(out) == 1
    out.clear()
    ConsoleSink(out.append).write(make(*('{"msg":"a%d"}' % n for n in range(1500))))
    assert sorted(json.loads(line)["message"] for line in out) == sorted(f"a{n}" for n in range(1500))
    ConsoleSink().write(make('{"msg":"printed by a task"}'))


def test_file_sink_appends_and_replays(spark, make, folder):
    sink = FileSink(folder + "/out")
    sink.write(make('{"msg":"a"}'))
    sink.write(make('{"msg":"b"}'))
    assert {json.loads(r["value"])["message"] for r in read_logs(spark, folder + "/out").collect()} == {"a", "b"}
    batches = FileSink(folder + "/batches")
    for _ in range(2):
        batches.write(make('{"msg":"a"}'), batch_id=7)
    batches.write(make('{"msg":"b"}'), batch_id=8)
    assert read_logs(spark, folder + "/batches").count() == 2
    with pytest.raises(RuleError):
        FileSink("")


# -- http -------------------------------------------------------------------


def recorder(path, statuses):
    """A transport that writes what it is given to a file; answers in turn."""

    def client():
        answers = list(statuses)

        def post(url, body, headers):
            with open(path, "a") as log:
                log.write(json.dumps([url, body.decode(), dict(headers)]) + "\n")
            return answers.pop(0) if answers else 200

        return post

    return client


def requests(path):
    with open(path) as log:
        return [json.loads(line) for line in log]


def test_http_posts_each_entry(make, folder):
    os.environ["LOG_TOKEN"] = "t0ken"
    log = folder + "/log"
    sink = HttpSink("http://x/in", {"Authorization": "Bearer $LOG_TOKEN"}, client=recorder(log, []))
    sink.write(make('{"msg":"a","k":1}', '{"msg":"b"}').coalesce(1))
    sent = requests(log)
    assert [json.loads(body)["message"] for _, body, _ in sent] == ["a", "b"]
    assert sent[0][2] == {"Content-Type": "application/json", "Authorization": "Bearer t0ken"}
    custom = HttpSink("http://x", {"content-type": "text/plain"}).request_headers()
    assert custom == {"content-type": "text/plain"}


def test_http_batches_retries_and_errors(make, folder):
    df = make(*['{"msg":"%d"}' % i for i in range(5)]).coalesce(1)
    log = folder + "/arrays"
    sink = HttpSink("http://x", per_request=2, retry=RetryPolicy(2, 0.0), client=recorder(log, [500]))
    sink.write(df, batch_id=3)
    sent = requests(log)
    assert [len(json.loads(body)) for _, body, _ in sent] == [2, 2, 2, 1]
    assert sent[0][2]["Idempotency-Key"] == sent[1][2]["Idempotency-Key"] != sent[2][2]["Idempotency-Key"]
    down = HttpSink("http://x", client=recorder(folder + "/down", [200, 404, 301]))
    with pytest.raises(DeliveryError, match="2 of 5 entries failed.*status"):
        down.write(df)
    assert len(requests(folder + "/down")) == 5
    for options in ({"url": ""}, {"url": "u", "per_request": 0}):
        with pytest.raises(RuleError):
            HttpSink(**options)


# -- watermarks -------------------------------------------------------------


def test_watermark_and_resume(spark, make):
    df = make(
        '{"ts":"2024-06-01T12:00:00Z","msg":"a"}',
        '{"ts":"2024-06-01T11:00:00Z","msg":"b"}',
        '{"ts":"2024-06-01T13:00:00.5Z","msg":"c"}',
    )
    first = df.where("pos < 2")
    marks = delivery_watermark(first, order=("pos",))
    assert marks.select("source", "watermark").collect() == [("test", "2024-06-01T11:00:00.000000000Z")]
    noon = delivery_watermark(first, order=("timestamp",))
    assert noon.first()["watermark"] == "2024-06-01T12:00:00.000000000Z"
    assert [r["message"] for r in resume_after(df, noon, ("timestamp",)).collect()] == ["c"]
    assert resume_after(df, noon.withColumn("source", F.lit("other")), ("timestamp",)).count() == 3
    assert resume_after(df, noon, ("timestamp",)).columns == df.columns


def test_resume_loses_neither_ties_nor_late_entries(spark, make):
    df = make(
        '{"ts":"2024-06-01T12:00:00Z","msg":"delivered"}',
        '{"ts":"2024-06-01T12:00:00Z","msg":"same time"}',
        '{"ts":"2024-06-01T11:00:00Z","msg":"late"}',
    )
    marks = delivery_watermark(df.where("pos = 0"), ("pos",))
    assert sorted(r["message"] for r in resume_after(df, marks, ("pos",)).collect()) == ["late", "same time"]


# -- counters and health ----------------------------------------------------


def test_counters(spark):
    rows = [("a", True, 2, 0), ("a", True, 1, 1), ("a", False, 0, 0), ("b", True, 0, 2)]
    df = spark.createDataFrame(rows, "source string, ok boolean, w bigint, e bigint")
    out = {r["source"]: tuple(r)[1:] for r in pipeline_counters(df, F.col("ok"), F.col("w"), F.col("e")).collect()}
    assert out == {"a": (3, 2, 1, 3, 1, 1), "b": (1, 1, 0, 0, 2, 1), "*": (4, 3, 1, 3, 3, 2)}


def test_health(spark):
    schema = "name string, healthy boolean, detail string, registered bigint"

    def report(*rows):
        return health_report(spark.createDataFrame(list(rows), schema)).first()

    assert report()["healthy"] is True and report()["components"] == []
    mixed = report(("sink", True, "", 1), ("src", False, "file missing", 1))
    assert mixed["healthy"] is False
    assert [tuple(c) for c in mixed["components"]] == [("sink", True, None), ("src", False, "file missing")]
    replaced = report(("src", False, "x", 1), ("src", True, "", 2))
    assert replaced["healthy"] is True and len(replaced["components"]) == 1


# -- sources and jobs -------------------------------------------------------


def write(path, *lines):
    with open(path, "a") as file:
        file.write("".join(line + "\n" for line in lines))


def test_sources(spark, folder):
    write(folder + "/a.log", "one", "two")
    write(folder + "/b.log", "three")
    write(folder + "/c.txt", "four")
    rows = read_logs(spark, folder + "/*.log").collect()
    assert {(r["value"], os.path.basename(r["source"])) for r in rows} == {
        ("one", "a.log"), ("two", "a.log"), ("three", "b.log"),
    }
    lines, skipped = union_sources(
        spark, [Source(folder + "/*.log", "x"), Source(folder + "/none.log", "y"), Source(folder + "/c.txt")]
    )
    assert lines.count() == 4 and [s.label for s in skipped] == ["y"]
    empty, skipped = union_sources(spark, [Source(folder + "/none.log")])
    assert empty.count() == 0 and len(skipped) == 1


def test_positions(spark, folder):
    write(folder + "/a.log", "é1", "", "line three")
    with open(folder + "/a.log", "a") as file:
        file.write("no newline")
    rows = read_logs(spark, folder + "/a.log", with_position=True).orderBy("pos").collect()
    assert [(r["value"], r["pos"]) for r in rows] == [("é1", 0), ("", 4), ("line three", 5), ("no newline", 16)]


FILE = {"type": "file", "path": "/tmp/x"}


@pytest.mark.parametrize(
    "sinks, message",
    [
        ([], "at least one sink"),
        ([{"type": "stdout"}, {"type": "http"}], r"sink\[1\]: http sink requires a url"),
        ([{"type": "file"}], r"sink\[0\]: file sink requires a path"),
        ([{}], r"sink\[0\]: type is required"),
        ([{"type": "kafka"}], r"sink\[0\]: unknown type 'kafka'"),
        ([{"type": "buffered"}], "requires an inner sink"),
        ([{"type": "buffered", "inner": {"type": "http", "url": ""}}], r"sink\[0\]\.inner: http sink"),
        ([{"type": "sampled", "rate": 2.0, "inner": FILE}], "rate"),
        ([{"type": "sampled", "rate": 0.5}], "requires an inner sink"),
        ([{"type": "router"}], "requires routes"),
        ([{"type": "router", "routes": [{"field": "", "values": ["x"], "sink": FILE}]}], r"route\[0\]: missing field"),
        ([{"type": "router", "routes": [{"field": "f", "sink": FILE}]}], "missing values"),
        ([{"type": "router", "routes": [{"field": "f", "values": ["x"]}]}], "missing sink"),
        ([{"type": "router", "routes": [{"field": "f", "values": ["x"], "sink": {"type": "?"}}]}], "unknown type"),
    ],
)
def test_bad_jobs(sinks, message):
    with pytest.raises(RuleError, match=message):
        build_job({"sources": [{"path": "/tmp/a"}], "sinks": sinks})


def test_bad_sources():
    for sources in ([], [{"label": "x"}]):
        with pytest.raises(RuleError):
            build_job({"sources": sources, "sinks": [{"type": "stdout"}]})


def spec(folder):
    return {
        "sources": [{"path": folder + "/*.log", "tag": "app"}, {"path": folder + "/gone", "label": "gone"}],
        "sinks": [
            {"name": "console", "type": "stdout"},
            {
                "type": "router",
                "routes": [{"field": "level", "values": ["error"], "sink": {"type": "file", "file_path": folder + "/out"}}],
                "fallback": {"type": "buffered", "capacity": 1, "inner": {"type": "file", "path": folder + "/out"}},
            },
        ],
    }


def messages(spark, path):
    return sorted(json.loads(r["value"])["message"] for r in read_logs(spark, path).collect())


LINES = [
    '{"ts":"2024-01-01T00:00:01Z","level":"error","msg":"e"}',
    '{"ts":"2024-01-01T00:00:02Z","level":"info","msg":"i1"}',
    "broken",
    '{"ts":"2024-01-01T00:00:03Z","level":"info","msg":"i2"}',
]


def test_job_on_tables(spark, folder):
    write(folder + "/a.log", *LINES)
    out = []
    skipped = build_job(spec(folder), out=out.append).run(spark)
    assert [s.label for s in skipped] == ["gone"] and len(out) == 3
    assert messages(spark, folder + "/out") == ["e", "i2"]


def test_job_as_stream(spark, folder):
    write(folder + "/a.log", *LINES)
    out = []
    job = build_job(spec(folder), out=out.append)
    for lines in ([], ['{"ts":"2024-01-01T00:00:04Z","level":"info","msg":"i3"}']):
        write(folder + "/a.log", *lines)
        query = job.start(spark, folder + "/state", "earliest", {"availableNow": True})
        query.awaitTermination()
    assert len(out) == 4
    assert messages(spark, folder + "/out") == ["e", "i2", "i3"]
