"""Windowed and sequential operators, cut into few and many chunks, against
straightforward single-threaded computations."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riverlog.model import RuleError
from riverlog.operators.batching import assign_batches
from riverlog.operators.buffer import keep_latest
from riverlog.operators.dedup import dedup_bursts, dedup_live_size, dedup_window
from riverlog.operators.envelope import wrap_envelopes
from riverlog.operators.multiline import coalesce_multiline
from riverlog.operators.observe import rotation_events, state_transitions
from riverlog.operators.rate import rate_stats, shape_rate
from riverlog.plans.ordered import Previous, RowNumber, RunningMax, RunningSum, cut_rows, with_running

EPOCH = dt.datetime(2024, 1, 1)
CHUNKS = [None, 1, 13]


def at(us):
    return EPOCH + dt.timedelta(microseconds=us)


def us(ts):
    return round((ts - EPOCH) / dt.timedelta(microseconds=1))


def skewed(seed, n=300, gap=2_000_000, keys=5):
    """(id, ts, source): one source holds about half of the rows."""
    rng = random.Random(seed)
    clock, rows = 0, []
    for i in range(n):
        clock += rng.choice([0, 1, rng.randrange(gap), rng.randrange(gap // 50)])
        key = "hot" if rng.random() < 0.5 else f"s{rng.randrange(keys)}"
        rows.append((i, clock, key))
    return rows


def frame(spark, rows):
    data = [(i, at(t), k) for i, t, k in rows]
    return spark.createDataFrame(data, "id bigint, timestamp timestamp, source string").repartition(3)


@pytest.mark.parametrize("chunks", [1, 8, 30])
def test_running_values_do_not_depend_on_the_chunks(spark, chunks):
    rows = skewed(1)
    df = frame(spark, rows).withColumn("v", F.when(F.col("id") % 3 > 0, F.col("id") * 7 % 31))
    items = [
        RowNumber("n"),
        RunningSum("s", F.col("v")),
        RunningMax("m", F.col("v")),
        Previous("p", F.col("v")),
    ]
    order = ["timestamp", "id"]
    window = Window.partitionBy("source").orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plain = df.select(
        "id", F.row_number().over(window), F.sum("v").over(upto), F.max("v").over(upto), F.lag("v").over(window)
    )
    cut = with_running(df, ["source"], order, items, chunks).select("id", "n", "s", "m", "p")
    assert sorted(plain.collect()) == sorted(cut.collect())
    whole = with_running(df, [], order, [RowNumber("n")], chunks).select("id", "n")
    assert [r["n"] for r in whole.orderBy("id").collect()] == list(range(1, len(rows) + 1))


def test_null_keys_are_a_key(spark):
    rows = [(i, i * 10, None if i % 2 else "a") for i in range(60)]
    out = with_running(frame(spark, rows), ["source"], ["timestamp"], [RowNumber("n")], 10)
    assert [r["n"] for r in out.where("source is null").orderBy("id").collect()] == list(range(1, 31))


def test_rows_of_one_time_are_cut_by_the_rest_of_the_order(spark):
    df = frame(spark, [(i, 5, "hot") for i in range(400)])
    cut = cut_rows(df, ["source"], ["timestamp", "id"], chunks=8)
    sizes = [r["count"] for r in cut.chunk(df).groupBy("_chunk").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 150
    out = with_running(df, ["source"], ["timestamp", "id"], [RowNumber("n")], cut=cut)
    assert [r["n"] for r in out.orderBy("id").collect()] == list(range(1, 401))


def test_order_of_texts_and_nulls(spark):
    texts = ["b", None, 'q"\\u00e9', "a", "\u00e4", "c\nd", ""]
    df = spark.createDataFrame([(text,) for text in texts], "s string")
    out = with_running(df, [], ["s"], [RowNumber("n")], 5).orderBy("n").collect()
    assert [r["s"] for r in out] == [None, *sorted(text for text in texts if text is not None)]
    assert with_running(df.limit(0), [], ["s"], [RowNumber("n")], 5).count() == 0


def test_rows_never_meet_in_one_task(spark):
    df = frame(spark, skewed(2))
    out = wrap_envelopes(df, "app.log", ["timestamp", "id"], chunks=6)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    window_keys = [line for line in plan.splitlines() if "Window" in line and "row_number" in line]
    assert window_keys and all("_chunk" in line for line in window_keys)


# -- dedup ------------------------------------------------------------------


def dedup_reference(rows, window):
    last, kept, bursts = {}, [], {}
    for i, t, k in rows:
        fresh = k not in last or t - last[k] >= window
        if fresh:
            kept.append(i)
            bursts.setdefault(k, []).append([t, t, 0])
        bursts[k][-1][1:] = [t, bursts[k][-1][2] + 1]
        last[k] = t
    return kept, bursts, last


@pytest.mark.parametrize("window", [0.000001, 0.01, 0.5, 1.0, 7.0])
def test_dedup(spark, window):
    rows = skewed(3)
    df = frame(spark, rows)
    kept, bursts, last = dedup_reference(rows, round(window * 1e6))
    out = dedup_window(df, window, "source", order=("id",))
    assert sorted(r["id"] for r in out.collect()) == kept
    assert out.columns == df.columns
    for chunks in CHUNKS:
        found = dedup_bursts(df, window, "source", chunks=chunks).collect()
        got = sorted((r["first_at"], r["last_at"], r["occurrences"]) for r in found)
        base = round(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
        assert got == sorted((base + a, base + b, n) for group in bursts.values() for a, b, n in group)
    newest = max(last.values())
    live = sum(newest - t <= round(window * 1e6) for t in last.values())
    assert dedup_live_size(df, window, "source").first()["live_lines"] == live


def test_dedup_boundary(spark):
    df = frame(spark, [(0, 0, "a"), (1, 999_999, "a"), (2, 1_999_999, "a"), (3, 2_000_000, "b")])
    assert [r["id"] for r in dedup_window(df, 1.0, "source").orderBy("id").collect()] == [0, 2, 3]
    with pytest.raises(RuleError):
        dedup_window(df, 0)


# -- multiline --------------------------------------------------------------


def multiline_reference(rows):
    groups, open_ = [], {}
    for i, _, key, text in rows:
        if text.startswith(("\t", "at ")) and key in open_:
            open_[key][1].append(text)
        else:
            open_[key] = (i, [text])
            groups.append(open_[key])
    return sorted((i, "\n".join(texts)) for i, texts in groups)


@pytest.mark.parametrize("chunks", CHUNKS)
def test_multiline(spark, make, chunks):
    rng = random.Random(4)
    rows = [(*row, rng.choice(["head", "\tat x", "at y", ""])) for row in skewed(4)]
    data = [(i, at(t), "", text, k) for i, t, k, text in rows]
    df = spark.createDataFrame(data, "id bigint, timestamp timestamp, level string, message string, source string")
    df = df.withColumn("fields", F.expr("map('k', cast(id as variant))")).withColumn("raw", F.lit(""))
    out = coalesce_multiline(df, "message", ["\t", "at "], ["source"], ["timestamp", "id"], chunks)
    assert sorted((r["id"], r["message"]) for r in out.select("id", "message").collect()) == multiline_reference(rows)
    assert out.select(F.expr("cast(fields['k'] as bigint) = id")).distinct().collect() == [(True,)]


def test_multiline_field_becomes_text(make):
    df = make('{"stack":"head"}', '{"stack":"\\tat a"}', '{"other":1}', '{"stack":5}')
    out = coalesce_multiline(df, "stack", ["\t"], ["source"], ["pos"]).orderBy("pos")
    texts = [r[0] for r in out.select(F.expr("cast(fields['stack'] as string)")).collect()]
    assert texts == ["head\n\tat a", "", ""]
    for field, prefixes in (("", ["x"]), ("f", [])):
        with pytest.raises(RuleError):
            coalesce_multiline(df, field, prefixes)


# -- batches ----------------------------------------------------------------


def batch_reference(rows, size, interval, start=None):
    state, out = {}, {}
    for i, t, k in rows:
        if k not in state:
            state[k] = [(t if start is None else start) + interval, 0, 1]
        s = state[k]
        while t >= s[0]:
            if s[1]:
                s[1], s[2] = 0, s[2] + 1
            s[0] += interval
        out[i] = s[2]
        s[1] += 1
        if s[1] == size:
            s[0], s[1], s[2] = t + interval, 0, s[2] + 1
    return out


@pytest.mark.parametrize("chunks", CHUNKS)
@pytest.mark.parametrize("size, interval", [(3, 1.0), (7, 5.0), (1000, 2.0), (4, 1000.0), (1, 0.001)])
def test_batches(spark, chunks, size, interval):
    rows = skewed(5)
    out = assign_batches(
        frame(spark, rows), size, interval, ["source"], ["timestamp", "id"], chunks=chunks
    )
    got = {r["id"]: r["batch_id"] for r in out.collect()}
    assert got == batch_reference(rows, size, round(interval * 1e6))


def test_batches_by_size_and_start(spark):
    rows = skewed(6, n=80)
    df = frame(spark, rows)
    by_size = assign_batches(df, 4, None, ["source"], ["timestamp", "id"], chunks=7)
    assert {r["id"]: r["batch_id"] for r in by_size.collect()} == batch_reference(rows, 4, 10**15)
    start = F.lit("2023-12-31T23:59:59.700Z").cast("timestamp")
    for chunks in (7, None):
        timed = assign_batches(df, 4, 1.0, ["source"], ["timestamp", "id"], start=start, chunks=chunks)
        assert {r["id"]: r["batch_id"] for r in timed.collect()} == batch_reference(rows, 4, 10**6, -300_000)
    for size, interval in ((0, 1.0), (1, 0), (1, -1)):
        with pytest.raises(RuleError):
            assign_batches(df, size, interval)


# -- buffer, rate, envelope -------------------------------------------------


@pytest.mark.parametrize("limit_threshold", ["1000", "1"])
def test_keep_latest(spark, limit_threshold):
    rows = skewed(7, n=60)
    df = frame(spark, rows)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", limit_threshold)
    try:
        got = keep_latest(df, 2, order=["timestamp", "id"]).select("id", "buffer_pos").collect()
        want = []
        for key in {k for _, _, k in rows}:
            tail = [i for i, _, k in rows if k == key][-2:]
            want += [(i, pos) for pos, i in enumerate(tail, 1)]
        assert sorted(got) == sorted(want)
        total = keep_latest(df, 3, [], ["timestamp", "id"]).orderBy("buffer_pos").collect()
        assert [r["id"] for r in total] == [57, 58, 59]
        timed = keep_latest(df, 1, ["source"], ["timestamp", "id"], period=1.0)
        base = {(k, t // 1_000_000): i for i, t, k in rows}
        assert sorted(r["id"] for r in timed.collect()) == sorted(base.values())
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    with pytest.raises(RuleError):
        keep_latest(df, 0)


def bucket_reference(arrivals, rate, burst):
    """Simulated token bucket in exact fractions."""
    from fractions import Fraction

    tokens, clock, out = Fraction(burst), None, []
    for a in arrivals:
        now = Fraction(a) if clock is None else max(Fraction(a), clock)
        if clock is not None:
            tokens = min(Fraction(burst), tokens + (now - clock) * rate / 10**6)
        if tokens < 1:
            now += (1 - tokens) * 10**6 / rate
            tokens = Fraction(1)
        tokens -= 1
        clock = now
        out.append(int(now))
    return out


@pytest.mark.parametrize("chunks", [12, None])
@pytest.mark.parametrize("rate, burst", [(5, 1), (2, 4), (100, 1)])
def test_shape_rate(spark, chunks, rate, burst):
    rows = skewed(8, n=150)
    base = round(EPOCH.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6)
    out = shape_rate(frame(spark, rows), rate, burst, order=["timestamp", "id"], chunks=chunks)
    got = {r["id"]: (r["release_at"] - base, r["delay"]) for r in out.collect()}
    for key in {k for _, _, k in rows}:
        mine = [(i, t) for i, t, k in rows if k == key]
        for (i, t), release in zip(mine, bucket_reference([t for _, t in mine], rate, burst)):
            assert got[i] == (release, release - t)


def test_shape_rate_cases(spark):
    three = frame(spark, [(i, 0, "s") for i in range(3)])
    out = shape_rate(three, 5, 1, order=["timestamp", "id"]).orderBy("id").collect()
    assert [r["delay"] for r in out] == [0, 200_000, 400_000]
    stopped = shape_rate(three, 0, 2, order=["timestamp", "id"])
    assert [r["delay"] for r in stopped.orderBy("id").collect()] == [0, 0, None]
    assert {r["delay"] for r in shape_rate(three, 5, 0, order=["timestamp", "id"]).collect()} == {None}
    stats = rate_stats(stopped).first()
    assert (stats["entries"], stats["immediate"], stats["delayed"], stats["never"]) == (3, 2, 0, 1)
    for rate, burst in ((-1, 1), (1, -1)):
        with pytest.raises(RuleError):
            shape_rate(three, rate, burst)


@pytest.mark.parametrize("chunks", [9, None])
def test_envelopes(spark, chunks):
    rows = skewed(9, n=100)
    df = frame(spark, rows)
    out = wrap_envelopes(df, "app.log", ["timestamp", "id"], chunks=chunks).orderBy("id").collect()
    assert [r["seq"] for r in out] == list(range(1, 101))
    assert {r["envelope_source"] for r in out} == {"app.log"}
    loose = wrap_envelopes(df, "app.log", dense=False).select("seq").distinct().count()
    assert loose == 100
    with pytest.raises(RuleError):
        wrap_envelopes(df, "")


# -- observation tables -----------------------------------------------------


@pytest.mark.parametrize("chunks", [9, None])
def test_transitions_and_rotation(spark, chunks):
    rng = random.Random(10)
    rows = [(i, t, k, rng.random() < 0.6, rng.choice([1, 1, 1, 2]), rng.choice([10, 20, 30, None])) for i, t, k in skewed(10)]
    data = [(i, at(t), k, up, ino, size) for i, t, k, up, ino, size in rows]
    polls = spark.createDataFrame(
        data, "id bigint, poll_ts timestamp, path string, available boolean, inode bigint, size bigint"
    )
    last, meta, changes, events = {}, {}, [], []
    for i, _, k, up, ino, size in rows:
        if last.get(k) != up:
            changes.append((i, "available" if up else "missing"))
        last[k] = up
        if size is None:
            continue
        if k in meta and meta[k][0] != ino:
            events.append((i, "inode_changed"))
        elif k in meta and size < meta[k][1]:
            events.append((i, "truncated"))
        meta[k] = (ino, size)
    order = ["poll_ts", "id"]
    got = state_transitions(polls, order=order, chunks=chunks).select("id", "state").collect()
    assert sorted(got) == changes
    got = rotation_events(polls, order=order, chunks=chunks).select("id", "reason").collect()
    assert sorted(got) == events


def test_batches_keep_every_row_of_a_tie(spark):
    rows = [("a", "2024-01-01 00:00:00", n) for n in (1, 2)] + [("a", "2024-01-01 00:00:01", 3), ("a", "2024-01-01 00:01:00", 4)]
    df = spark.createDataFrame(rows, "source string, ts string, n int").withColumn("timestamp", F.col("ts").cast("timestamp"))
    out = assign_batches(df, 3, by=["source"], interval=5.0, order=("timestamp",))
    assert sorted(r["n"] for r in out.collect()) == [1, 2, 3, 4]


def test_totals_of_delays_beyond_long(spark):
    from riverlog.catalog.queries import _bigint_if_all_fit

    rows = [("a", 0, 0), ("a", 2**62, 2**62), ("a", 2**62 + 1, 2**62 + 1), ("a", None, None), ("b", None, None), ("c", 7, 7)]
    shaped = spark.createDataFrame(rows, "source string, release_at bigint, delay bigint")
    stats = rate_stats(shaped)
    got = {r["source"]: (r["entries"], r["never"], r["max_delay"], r["total_delay"]) for r in stats.collect()}
    assert got == {"a": (4, 1, 2**62 + 1, 2**63 + 1), "b": (1, 1, None, None), "c": (1, 0, 7, 7)}
    kept = _bigint_if_all_fit(stats, "total_delay")
    assert {r["source"]: r["total_delay"] for r in kept.collect()} == {"a": 2**63 + 1, "b": None, "c": 7}
    small = _bigint_if_all_fit(stats.where("source <> 'a'"), "total_delay")
    assert dict(small.dtypes)["total_delay"] == "bigint"
    assert {r["source"]: r["total_delay"] for r in small.collect()} == {"b": None, "c": 7}
