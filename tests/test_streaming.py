import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from riverlog.model import RuleError
from riverlog.operators import batching, dedup, multiline, observe, predicates, rewrite
from riverlog.operators.parse import parse_logs
from riverlog.plans.storage import scratch_path
from riverlog.sinks.basic import FileSink, TransformedSink
from riverlog.sources import tail
from riverlog.streaming import stateful
from tests.test_ordered import at, skewed


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def append(path, text, mode="ab"):
    with open(path, mode) as file:
        file.write(text.encode())


def drain(spark, stream, out, state):
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()


class Follower:
    """Runs a tail query again and again and returns what each run added."""

    def __init__(self, spark, folder, pattern, **options):
        self.spark, self.folder, self.pattern, self.options = spark, folder, pattern, options
        self.seen = 0

    def __call__(self):
        lines = tail.tail_logs(self.spark, self.pattern, **self.options)
        drain(self.spark, lines, self.folder + "/out", self.folder + "/state")
        rows = self.spark.read.schema("value string, source string, file string, pos bigint").parquet(
            self.folder + "/out"
        )
        all_rows = [(r["value"], r["pos"]) for r in rows.collect()]
        new = len(all_rows) - self.seen
        self.seen = len(all_rows)
        return new, sorted(all_rows)


def test_tail_growth_partial_lines_and_rotation(spark, folder):
    path = folder + "/a.log"
    append(path, "one\ntwo\nthr")
    follow = Follower(spark, folder, folder + "/*.log", start="earliest", label="x")
    assert follow() == (2, [("one", 0), ("two", 4)])
    append(path, "ee\nfour\n")
    assert follow()[0] == 2
    assert follow()[0] == 0
    append(path, "new\n", "wb")  # truncated: shorter than before
    new, rows = follow()
    assert new == 1 and ("new", 0) in rows
    append(folder + "/next", "after a rotation, longer than before\n")
    os.replace(folder + "/next", path)  # another inode
    new, rows = follow()
    assert new == 1 and ("after a rotation, longer than before", 0) in rows
    append(folder + "/b.log", "b1\n")
    assert follow()[0] == 1


def test_tail_starts_at_the_end(spark, folder):
    path = folder + "/a.log"
    append(path, "old\n")
    follow = Follower(spark, folder, path)
    assert follow()[0] == 0
    append(path, "new\n")
    assert follow() == (1, [("new", 4)])
    with pytest.raises(RuleError):
        tail.tail_logs(spark, path, start="middle")


@pytest.mark.parametrize("size", [1, 3, 7, 64, 10_000])
def test_ranges_cover_every_line_once(folder, size):
    rng = random.Random(size)
    lines = ["x" * rng.randrange(20) for _ in range(50)]
    path = folder + "/a.log"
    append(path, "".join(line + "\n" for line in lines) + "tail")
    end = tail.last_line_end(path, os.path.getsize(path))
    assert end == sum(len(line) + 1 for line in lines)
    found = []
    for part in tail.split_ranges(path, 0, end, size):
        for batch in tail.read_range(part):
            found += batch.column("value").to_pylist()
    assert found == lines
    assert tail.last_line_end(path, 0) == 0


@pytest.mark.parametrize("size", [1, 3, 7, 64, 10_000])
def test_ranges_by_line_breaks_cover_every_line_once(folder, size):
    rng = random.Random(size)
    lines = ["x" * rng.randrange(20) for _ in range(50)]
    path = folder + "/a.log"
    append(path, "".join(line + "\n" for line in lines) + "unfinished")
    cuts = sorted(rng.sample(range(os.path.getsize(path)), 4))
    found = []
    for begin, end in zip([0, *cuts], [*cuts, os.path.getsize(path)]):
        for part in tail.split_ranges(path, begin, end, size, ended=True):
            for batch in tail.read_range(part):
                found += list(zip(batch.column("value").to_pylist(), batch.column("pos").to_pylist()))
    places = [sum(len(line) + 1 for line in lines[:n]) for n in range(50)]
    assert found == list(zip(lines, places))


def test_budget_is_dealt_in_turns():
    sizes = {f"f{number:05d}": 100 + number for number in range(10_000)}
    sizes["f00500"] = 10**9  # one file always has more
    left, turn, rounds, served = dict(sizes), "", 0, dict.fromkeys(sizes, 0)
    budget = 8 << 20
    while sum(size for path, size in left.items() if path != "f00500"):
        given, turn = tail.dealt(left, budget, turn)
        assert 0 < sum(given.values()) <= budget
        for path, size in given.items():
            left[path] -= size
            served[path] += 1
        left["f00500"] = 10**9
        rounds += 1
        assert rounds <= 20
    assert min(served.values()) >= 1
    # a budget below a quantum for each: all are served before one is served again
    order, turn = [], ""
    for _ in range(6):
        given, turn = tail.dealt(dict.fromkeys("abc", 10 * tail.QUANTUM), tail.QUANTUM, turn)
        order += given
    assert order == ["a", "b", "c", "a", "b", "c"]
    assert tail.dealt({"a": 0}, 100, "") == ({}, "")
    parts = tail.grouped([tail.ByteRange("p", 0, 0, size) for size in (3, 4, 90, 200, 1)], 100)
    assert [len(part.ranges) if isinstance(part, tail.RangeGroup) else 1 for part in parts] == [3, 1, 1]


def test_bounded_batches_go_on_exactly_after_restarts(spark, folder):
    for number in range(4):
        append(f"{folder}/{number}.log", "".join(f"{number}-{line}\n" for line in range(30 * (number + 1))))
    budget, sizes = 200, []
    for run in range(40):
        lines = tail.tail_logs(
            spark, folder + "/*.log", "x", start="earliest", max_bytes=budget, places=folder + "/state/places.json"
        )
        drain(spark, lines, folder + "/out", folder + "/state")
        rows = spark.read.schema("value string, source string, file string, pos bigint").parquet(folder + "/out").collect()
        sizes.append(sum(len(row["value"]) + 1 for row in rows))
        if run == 5:
            append(folder + "/4.log", "late\n")
        if len(rows) == 301:
            break
    assert sorted(row["value"] for row in rows) == sorted(
        [f"{number}-{line}" for number in range(4) for line in range(30 * (number + 1))] + ["late"]
    )
    # a batch may finish a line that an earlier one began
    assert max(b - a for a, b in zip([0, *sizes], sizes)) <= budget + 10 and len(sizes) > 5


def read_all(ranges):
    return [line for part in ranges for batch in tail.read_range(part) for line in batch.column("value").to_pylist()]


def polls(folder):
    options = tail.LineFiles.encode([folder + "/*.log*"])
    return tail._TailReader(options)


def test_tail_keeps_the_place_of_a_file_missing_from_one_poll(folder):
    path, reader = folder + "/a.log", polls(folder)
    append(path, "one\n")
    first = reader.latestOffset()
    assert read_all(reader.partitions(reader.initialOffset(), first)) == ["one"]
    os.rename(path, folder + "/hidden")
    missed = reader.latestOffset()
    assert read_all(reader.partitions(first, missed)) == []
    os.rename(folder + "/hidden", path)
    append(path, "two\n")
    assert read_all(reader.partitions(missed, reader.latestOffset())) == ["two"]

    again = polls(folder)  # the first poll after a restart misses it
    os.rename(path, folder + "/hidden")
    missed = again.latestOffset()
    start = {"files": dict(reader.ends)}
    assert read_all(again.partitions(start, missed)) == []
    os.rename(folder + "/hidden", path)
    append(path, "three\n")
    assert read_all(again.partitions(missed, again.latestOffset())) == ["three"]


def test_tail_goes_on_after_a_rename_under_the_pattern(folder):
    path, reader = folder + "/a.log", polls(folder)
    append(path, "one\n")
    first = reader.latestOffset()
    reader.partitions(reader.initialOffset(), first)
    append(path, "two\n")
    os.rename(path, path + ".1")
    append(path, "three\n")
    assert sorted(read_all(reader.partitions(first, reader.latestOffset()))) == ["three", "two"]


def test_tail_reads_the_file_it_planned(folder):
    path, reader = folder + "/a.log", polls(folder)
    append(path, "one\n")
    planned = reader.partitions(reader.initialOffset(), reader.latestOffset())
    os.rename(path, path + ".1")
    append(path, "other\n")
    assert read_all(planned) == ["one"]
    os.rename(path, path + ".1")  # replaces the one that was planned
    with pytest.raises(FileNotFoundError):
        read_all(planned)


# -- stateful operators: stream = batch --------------------------------------


def feed(spark, df, order, parts=3):
    """A stream that delivers the rows in order, one file per micro-batch."""
    rows = df.orderBy(*order).toArrow()
    path = scratch_path(spark, "feed").removeprefix("file:")
    os.makedirs(path)
    import pyarrow.parquet as pq

    step = -(-rows.num_rows // parts)
    for part in range(parts):
        name = f"{path}/{part}.parquet"
        pq.write_table(rows.slice(part * step, step), name)
        os.utime(name, (1_700_000_000 + part, 1_700_000_000 + part))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, stream, folder):
    drain(spark, stream, folder + "/out", folder + "/state")
    return spark.read.parquet(folder + "/out")


def lines_of(spark, rows):
    data = [
        (i, at(t), k, '{"msg":"%s","k":%d}' % (random.Random(i).choice(["head", "\\tat x", "\\tat y"]), i))
        for i, t, k in rows
    ]
    return spark.createDataFrame(data, "id bigint, ts timestamp, source string, value string")


def entries(lines):
    return parse_logs(lines, now=F.col("ts"))


ORDER = ["timestamp", "id"]


@pytest.mark.parametrize("watermark", [None, "1 second"])
def test_dedup_stream(spark, folder, watermark):
    lines = lines_of(spark, skewed(21, n=120))
    batch = dedup.dedup_window(entries(lines), 1.0, "source", order=("id",))
    stream = entries(feed(spark, lines, ["ts", "id"]))
    out = run(spark, stateful.dedup_stream(stream, 1.0, "source", order=["id"], watermark=watermark), folder)
    assert sorted(r["id"] for r in out.collect()) == sorted(r["id"] for r in batch.collect())
    assert out.select(F.expr("cast(fields['k'] as bigint) = id")).distinct().collect() == [(True,)]


def test_multiline_stream(spark, folder):
    rows = skewed(22, n=90)
    lines = lines_of(spark, rows)
    batch = multiline.coalesce_multiline(entries(lines), "message", ["\t"], order=ORDER)
    open_ids = {r[0] for r in batch.groupBy("source").agg(F.max("id")).select("max(id)").collect()}
    stream = entries(feed(spark, lines, ["ts", "id"]))
    merged = stateful.multiline_stream(stream, "message", ["\t"], order=ORDER)
    out = run(spark, merged.select("id", "timestamp", "message", "fields"), folder)
    got = sorted(out.select("id", "timestamp", "message").collect())
    want = batch.where(~F.col("id").isin(*open_ids)).select("id", "timestamp", "message")
    assert got == sorted(want.collect())
    assert out.select(F.expr("cast(fields['k'] as bigint) = id")).distinct().collect() == [(True,)]


def test_multiline_stream_flushes_silent_sources(spark, folder):
    lines = lines_of(spark, [(0, 0, "quiet"), (1, 10_000_000, "busy"), (2, 20_000_000, "busy"), (3, 30_000_000, "busy")])
    stream = entries(feed(spark, lines, ["ts"], parts=4))
    merged = stateful.multiline_stream(
        stream, "message", ["\t"], order=ORDER, flush_after=1.0, watermark="0 seconds"
    )
    out = run(spark, merged.select("id", "source"), folder)
    assert ("quiet", 0) in {(r["source"], r["id"]) for r in out.collect()}


def test_batch_stream(spark, folder):
    lines = lines_of(spark, skewed(23, n=120))
    batch = batching.assign_batches(entries(lines), 4, 1.5, order=ORDER)
    out = run(spark, stateful.batch_stream(entries(feed(spark, lines, ["ts", "id"])), 4, 1.5, order=ORDER), folder)
    assert sorted(out.select("id", "batch_id").collect()) == sorted(batch.select("id", "batch_id").collect())


def test_transition_and_rotation_streams(spark, folder):
    rng = random.Random(24)
    data = [
        (i, at(t), k, rng.random() < 0.6, rng.choice([1, 1, 2]), rng.choice([10, 20, None]))
        for i, t, k in skewed(24, n=120)
    ]
    polls = spark.createDataFrame(
        data, "id bigint, poll_ts timestamp, path string, available boolean, inode bigint, size bigint"
    )
    order = ["poll_ts", "id"]
    for name, stream_form, batch_form, column in (
        ("t", stateful.transitions_stream, observe.state_transitions, "state"),
        ("r", stateful.rotation_stream, observe.rotation_events, "reason"),
    ):
        out = run(spark, stream_form(feed(spark, polls, order), order=order), f"{folder}/{name}")
        want = batch_form(polls, order=order).select("id", column).collect()
        assert sorted(out.select("id", column).collect()) == sorted(want)


def test_keep_latest_per_micro_batch(spark, folder):
    lines = lines_of(spark, [(i, i, "s") for i in range(9)])
    sink = TransformedSink(stateful.keep_latest_batch(2, order=ORDER), FileSink(folder + "/kept"))
    query = (
        entries(feed(spark, lines, ["ts"]))
        .writeStream.foreachBatch(lambda df, batch_id: sink.write(df, batch_id))
        .option("checkpointLocation", folder + "/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    kept = parse_logs(spark.read.text(folder + "/kept").select("value"), source="f")
    ids = kept.select(F.try_variant_get(F.col("fields")["fields"], "$.k", "bigint")).collect()
    assert sorted(r[0] for r in ids) == [1, 2, 4, 5, 7, 8]


def test_stateless_operators_on_a_stream(spark, folder):
    lines = lines_of(spark, skewed(25, n=60))

    def chain(df):
        return predicates.filter_fields(
            rewrite.mask_field(rewrite.normalise_level(rewrite.add_field(df, "env", "x")), "k"), []
        ).select("id", "level", F.to_json("fields").alias("f"))

    out = run(spark, chain(entries(feed(spark, lines, ["ts", "id"]))), folder)
    assert sorted(out.collect()) == sorted(chain(entries(lines)).collect())
