import datetime as dt

import pytest
from pyspark.sql import functions as F

from riverlog.functions.values import field_string, field_text, field_type
from riverlog.model import RuleError
from riverlog.operators.parse import malformed_lines, parse_logs, split_malformed, to_json_lines


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def fields(df):
    return [r[0] for r in df.select(F.to_json("fields")).collect()]


def test_canonical_line(make):
    df = make('{"timestamp":"2024-01-15T10:00:00Z","level":"info","message":"started","pid":42}')
    row = df.select("timestamp", "level", "message", "source", field_text("pid").alias("pid")).first()
    assert row["timestamp"] == dt.datetime(2024, 1, 15, 10, 0, 0)
    assert (row["level"], row["message"], row["source"], row["pid"]) == ("info", "started", "test", "42")
    assert fields(df) == ['{"pid":42}']


def test_aliases(make):
    row = make('{"ts":"2024-06-01T12:00:00Z","severity":"error","msg":"oops"}').first()
    assert row["timestamp"] == dt.datetime(2024, 6, 1, 12)
    assert (row["level"], row["message"]) == ("error", "oops")


def test_alias_precedence_and_usable_values(make):
    df = make(
        '{"ts":"2024-06-01T12:00:00Z","time":"2024-06-02T12:00:00Z","severity":"error","level":7}',
        '{"timestamp":"yesterday","ts":"2024-06-01T12:00:00+02:00"}',
        '{"ts":1700000000,"level":3,"x":1}',
        '{"ts":"2024-01-15"}',
    )
    rows = df.collect()
    assert rows[0]["timestamp"] == dt.datetime(2024, 6, 2, 12) and rows[0]["level"] == "error"
    assert rows[1]["timestamp"] == dt.datetime(2024, 6, 1, 10)
    assert rows[2]["timestamp"] == dt.datetime(2024, 1, 1) and rows[2]["level"] == ""
    assert rows[3]["timestamp"] == dt.datetime(2024, 1, 1)
    assert fields(df)[2] == '{"x":1}'


def test_missing_timestamp_gets_processing_time(spark):
    before = dt.datetime.now()
    row = parse_logs(lines(spark, '{"message":"hello"}'), source="s").first()
    assert abs((row["timestamp"] - before).total_seconds()) < 24 * 3600
    assert row["message"] == "hello" and row["level"] == ""


@pytest.mark.parametrize(
    "line, reason",
    [
        ("", "empty line"),
        ("not json at all", "invalid JSON"),
        ('{"a":1} x', "invalid JSON"),
        ('{"a":1}]', "invalid JSON"),
        ('{"a":1},{"b":2}', "invalid JSON"),
        ("{'a':1}", "invalid JSON"),
        ('{"a":NaN}', "invalid JSON"),
        ("42", "not an object"),
        ('"text"', "not an object"),
        ("[1,2]", "not an object"),
        ("[]", "not an object"),
        (" ", "invalid JSON"),
    ],
)
def test_malformed(spark, line, reason):
    df = lines(spark, line)
    assert parse_logs(df, source="s").count() == 0
    assert [r["reason"] for r in malformed_lines(df).collect()] == [reason]


def test_null_line_is_an_empty_entry(make):
    row = make("null")
    assert row.count() == 1 and fields(row) == ["{}"]


def test_split(spark):
    good, bad = split_malformed(lines(spark, '{"a":1}', "", "x", "null"), source="s")
    assert good.count() == 2 and bad.count() == 2


def test_duplicate_keys_last_wins(make):
    df = make('{"a":1,"level":"info","a":2,"level":"warn"}')
    assert fields(df) == ['{"a":2}'] and df.first()["level"] == "warn"


def test_raw_passthrough(spark):
    df = parse_logs(lines(spark, "plain text", '{"msg":"m","k":1}'), source="s", raw=True)
    rows = {r["message"] for r in df.collect()}
    assert rows == {"plain text", "m"}
    assert set(fields(df)) == {"{}", '{"k":1}'}


def test_source_needed(spark):
    with pytest.raises(RuleError):
        parse_logs(lines(spark, "{}"))


def test_text_and_types(make):
    df = make('{"s":"x","n":1.0,"e":1e6,"b":true,"z":null,"o":{"a":1},"l":[1],"f":1.5}')
    names = ["s", "n", "e", "b", "z", "o", "l", "f", "gone"]
    text = df.select(*[field_text(n).alias(n) for n in names]).first()
    assert list(text) == ["x", "1", "1000000", "true", "<nil>", '{"a":1}', "[1]", "1.5", None]
    kinds = df.select(*[field_type(n).alias(n) for n in names]).first()
    assert list(kinds) == ["string", "number", "number", "boolean", "null", "object", "array", "number", None]
    assert df.select(field_string("n")).first()[0] is None


def test_lookup_prefers_fields_then_attributes(make):
    from riverlog.operators.rewrite import add_field

    df = make('{"level":"info"}')
    assert df.select(field_text("level")).first()[0] == "info"
    assert add_field(df, "level", "other").select(field_text("level")).first()[0] == "other"
    assert make("{}").select(field_text("level")).first()[0] is None


def test_json_line(make):
    df = make('{"ts":"2024-06-01T12:00:00.120Z","level":"info","msg":"m","z":1,"a":"é"}', '{"msg":"n"}')
    out = [r[0] for r in to_json_lines(df).collect()]
    assert out[0] == (
        '{"timestamp":"2024-06-01T12:00:00.12Z","level":"info","message":"m","source":"test",'
        '"fields":{"a":"é","z":1}}'
    )
    assert out[1] == '{"timestamp":"2024-01-01T00:00:00Z","level":"","message":"n","source":"test"}'


def test_line_is_decoded_once(make):
    from riverlog.operators.predicates import min_level

    df = min_level(make('{"level":"warn"}'), "warn")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_lines_are_judged_once(spark):
    from riverlog.operators.parse import judged_lines, malformed_lines, parse_logs

    rows = [('{"msg":"fine","k":[1]}', "s", 0), ("", "s", 1), ("nonsense", "t", 2), ("[7]", "t", 3), ("null", "t", 4), (None, "u", 5)]
    lines = spark.createDataFrame(rows, "value string, source string, pos bigint")
    now = F.lit("2024-01-01T00:00:00Z").cast("timestamp")
    judged = {row["pos"]: row for row in judged_lines(lines, now=now).collect()}
    assert {pos: row["reason"] for pos, row in judged.items()} == {
        0: None, 1: "empty line", 2: "invalid JSON", 3: "not an object", 4: None, 5: "empty line",
    }
    assert judged[2]["message"] == "nonsense" and judged[0]["message"] == "fine"
    keys = ("pos", "message", "source", "level", "raw")
    good = {tuple(row[k] for k in keys) for row in judged.values() if row["reason"] is None}
    assert good == {tuple(row[k] for k in keys) for row in parse_logs(lines, now=now).collect()}
    bad = {(row["pos"], row["reason"], row["raw"]) for row in judged.values() if row["reason"] is not None}
    assert bad == {(row["pos"], row["reason"], row["raw"]) for row in malformed_lines(lines).collect()}
