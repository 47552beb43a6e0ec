import datetime as dt
import functools

import pytest
from pyspark.sql import functions as F

from riverlog.model import RedactRule, RenameRule, RuleError
from riverlog.operators import rewrite as R


def fields(df):
    import json

    return [json.loads(r[0]) for r in df.select(F.to_json("fields")).collect()]


def test_add_remove_mask_upper(make):
    df = make('{"level":"info","user":"alice","token":"secret","n":null}')
    assert fields(R.add_field(df, "env", "prod")) == [{"user": "alice", "token": "secret", "n": None, "env": "prod"}]
    assert fields(R.add_field(df, "user", "bob"))[0]["user"] == "bob"
    assert fields(R.remove_field(df, "token")) == [{"user": "alice", "n": None}]
    assert fields(R.remove_field(df, "absent")) == fields(df)
    assert R.normalise_level(df).first()["level"] == "INFO"
    assert fields(R.mask_field(df, "token", "***"))[0]["token"] == "***"
    assert fields(R.mask_field(df, "n"))[0]["n"] == "[REDACTED]"
    assert fields(R.mask_field(df, "absent")) == fields(df)


def test_chain_runs_left_to_right(make):
    df = make('{"token":"secret"}')
    out = R.apply_all(
        df,
        [
            functools.partial(R.add_field, name="a", value="1"),
            functools.partial(R.mask_field, name="a", mask="x"),
            functools.partial(R.remove_field, name="token"),
        ],
    )
    assert fields(out) == [{"a": "x"}]


def test_redact(make):
    df = make('{"password":"s3cr3t","email":"user@example.com","host":"localhost","n":7,"msg":"mail a@b"}')
    rules = [RedactRule("password"), RedactRule("email", "@"), RedactRule("host", "@"), RedactRule("n", "7"), RedactRule("gone")]
    out = fields(R.redact(df, rules, "***"))[0]
    assert out == {"password": "***", "email": "***", "host": "localhost", "n": 7}
    assert fields(R.redact(df, [RedactRule("password")]))[0]["password"] == "[REDACTED]"
    assert fields(R.redact(df, [RedactRule("n", mask="#")]))[0]["n"] == "#"
    assert R.redact(df, [RedactRule("message", "@")]).first()["message"] == "[REDACTED]"
    twice = [RedactRule("email", "@", "seen"), RedactRule("email", "^seen$", "twice")]
    assert fields(R.redact(df, twice))[0]["email"] == "twice"


def test_redact_rejects_bad_rules(make):
    for rules in ([], [RedactRule("")], [RedactRule("a", "(?=x)")], [RedactRule("a", r"(x)\1")]):
        with pytest.raises(RuleError):
            R.redact(make("{}"), rules)


def test_truncate(make):
    long = "this message is much longer than ten bytes and must be cut"
    df = make('{"msg":"%s","svc":"short","count":42,"u":"aéééééé"}' % long)
    out = R.truncate(df, {"message": 10, "svc": 10, "count": 4, "u": 7, "gone": 5}).first()
    assert out["message"] == "this me..." and len(out["message"]) == 10
    got = fields(R.truncate(df, {"svc": 10, "count": 4, "u": 7, "gone": 5}))[0]
    assert got["svc"] == "short" and got["count"] == 42
    assert got["u"] == "aé�..."
    for bad in ({}, {"": 10}, {"a": 3}):
        with pytest.raises(RuleError):
            R.truncate(df, bad)


def rename(*pairs):
    return [RenameRule(a, b) for a, b in pairs]


def test_rename(make):
    df = make('{"level":"info","msg":"hello","host":"srv-1","a":1,"b":2}')
    assert fields(R.rename_fields(df, rename(("host", "hostname"))))[0] == {"hostname": "srv-1", "a": 1, "b": 2}
    assert fields(R.rename_fields(df, rename(("gone", "x")))) == fields(df)
    assert fields(R.rename_fields(df, rename(("a", "b"), ("b", "a"))))[0] == {"host": "srv-1", "a": 2, "b": 1}
    assert fields(R.rename_fields(df, rename(("a", "b"))))[0] == {"host": "srv-1", "b": 1}
    assert fields(R.rename_fields(df, rename(("a", "x"), ("b", "x"))))[0] == {"host": "srv-1", "x": 2}
    assert fields(R.rename_fields(df, rename(("b", "x"), ("a", "x"))))[0] == {"host": "srv-1", "x": 1}
    assert fields(R.rename_fields(df, rename(("a", "x"), ("a", "y"))))[0] == {"host": "srv-1", "b": 2, "y": 1}


def test_rename_attributes(make):
    df = make('{"level":"info","msg":"hello","host":"srv-1","n":5,"at":"2024-06-01T00:00:00Z"}')
    out = R.rename_fields(df, rename(("level", "severity"), ("host", "source"), ("n", "message"), ("at", "timestamp")))
    row = out.first()
    assert (row["level"], row["source"]) == ("", "srv-1")
    assert row["timestamp"] == dt.datetime(2024, 6, 1)
    assert fields(out)[0] == {"severity": "info", "message": 5}
    assert row["message"] == ""
    swapped = R.rename_fields(df, rename(("level", "message"), ("message", "level"))).first()
    assert (swapped["level"], swapped["message"]) == ("hello", "info")


def test_rename_rejects_bad_rules(make):
    for rules in ([], rename(("", "x")), rename(("x", ""))):
        with pytest.raises(RuleError):
            R.rename_fields(make("{}"), rules)


@pytest.mark.parametrize(
    "zone, text",
    [
        ("UTC", "2024-01-15T18:00:00.5Z"),
        ("America/New_York", "2024-01-15T13:00:00.5-05:00"),
        ("Asia/Kolkata", "2024-01-15T23:30:00.5+05:30"),
        ("Europe/London", "2024-01-15T18:00:00.5Z"),
    ],
)
def test_timestamp_text(spark, make, zone, text):
    df = make('{"ts":"2024-01-15T18:00:00.500Z"}')
    assert fields(R.timestamp_text(df, zone=zone))[0] == {"timestamp": text}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert fields(R.timestamp_text(df, "@ts", zone))[0] == {"@ts": text}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
