import pytest
from pyspark.sql import functions as F

from riverlog.model import FieldRule, MatchRule, Route, RuleError
from riverlog.operators import predicates as P
from riverlog.operators.route import route


def messages(df):
    return [r["message"] for r in df.select("message").collect()]


def test_filter_and_over_rules_or_over_values(make):
    df = make(
        '{"msg":"a","level":"error","service":"auth"}',
        '{"msg":"b","level":"ERROR","service":"payments"}',
        '{"msg":"c","level":"warn","service":"payments"}',
        '{"msg":"d","service":"payments"}',
    )
    rules = [MatchRule("level", ["error"]), MatchRule("service", ["Payments"])]
    assert messages(P.filter_fields(df, rules)) == ["b"]
    assert messages(P.filter_fields(df, [MatchRule("level", ["error", "warn"])])) == ["a", "b", "c"]
    assert len(messages(P.filter_fields(df, []))) == 4


def test_filter_compares_text_of_any_value(make):
    df = make('{"msg":"n","v":42}', '{"msg":"b","v":true}', '{"msg":"z","v":null}', '{"msg":"x"}')
    assert messages(P.filter_fields(df, [MatchRule("v", ["42", "TRUE", "<nil>"])])) == ["n", "b", "z"]


@pytest.mark.parametrize("rule", [MatchRule("", ["x"]), MatchRule("  ", ["x"]), MatchRule("f", [])])
def test_filter_rejects_bad_rules(make, rule):
    with pytest.raises(RuleError):
        P.filter_fields(make("{}"), [rule])


@pytest.mark.parametrize(
    "threshold, levels, kept",
    [
        ("warn", ["warn", "error", "fatal"], 3),
        ("error", ["debug", "info", "warn"], 0),
        ("debug", ["verbose", "", "debug"], 1),
        ("info", ["INFO", "Debug"], 1),
    ],
)
def test_min_level(make, threshold, levels, kept):
    df = make(*['{"level":"%s"}' % level for level in levels], '{"level":5}', "{}")
    assert P.min_level(df, threshold).count() == kept


def test_min_level_options(make):
    df = make('{"level":"WARN"}')
    assert P.min_level(df, "warn", case_sensitive=True).count() == 0
    for bad in ("", "loud"):
        with pytest.raises(RuleError):
            P.min_level(df, bad)
    with pytest.raises(RuleError):
        P.min_level(df, "WARN", case_sensitive=True)


def test_sample(spark):
    df = spark.range(10_000).select(F.col("id").cast("string").alias("raw"))
    kept = P.sample_logs(df, 0.1, seed=99).count()
    assert 500 <= kept <= 2000
    hashed = P.sample_logs(df, 0.1, seed=7, key="raw")
    assert 500 <= hashed.count() <= 2000
    spread = P.sample_logs(df.repartition(7), 0.1, seed=7, key="raw")
    assert hashed.exceptAll(spread).isEmpty() and spread.exceptAll(hashed).isEmpty()
    assert P.sample_logs(df, 1.0).count() == 10_000
    stats = P.sample_stats(df, 0.1, seed=7, key="raw").first()
    assert stats["kept"] == hashed.count() and stats["kept"] + stats["dropped"] == 10_000


@pytest.mark.parametrize("rate", [0, -0.5, 1.5])
def test_sample_rejects_rates(spark, rate):
    with pytest.raises(RuleError):
        P.sample_logs(spark.range(1), rate)


def test_validate(make):
    df = make(
        '{"msg":"ok","service":"api","code":200,"up":true}',
        '{"msg":"missing","code":200}',
        '{"msg":"type","service":"api","code":"200"}',
        '{"msg":"null","service":null}',
        '{"msg":"bool","service":"api","up":"yes"}',
        '{"msg":"optional","service":"api"}',
    )
    rules = [
        FieldRule("service", True, "string"),
        FieldRule("code", False, "number"),
        FieldRule("up", False, "boolean"),
        FieldRule("msg2", False, "date"),
    ]
    good, bad = P.validate(df, rules)
    assert messages(good) == ["ok", "optional"]
    found = {r["message"]: r["violation"] for r in bad.collect()}
    assert found == {
        "missing": "required field service is missing",
        "type": "field code must be a number, got string",
        "null": "field service must be a string, got null",
        "bool": "field up must be a boolean, got string",
    }
    assert P.valid_entries(df, [FieldRule("code")]).count() == 6
    assert P.valid_entries(df, [FieldRule("message", True, "string")]).count() == 6


def test_validate_rejects_bad_contracts(make):
    for rules in ([], [FieldRule("")]):
        with pytest.raises(RuleError):
            P.validate(make("{}"), rules)


def routed(df, *args):
    return {r["message"]: r["route"] for r in route(df, *args).collect()}


def test_route(make):
    df = make(
        '{"msg":"a","level":"error","service":"payments"}',
        '{"msg":"b","level":"info","service":"payments"}',
        '{"msg":"c","level":"info"}',
        '{"msg":"d","level":"ERROR"}',
    )
    rules = [Route("level", ["error"], "errors"), Route("service", ["payments"], "money")]
    assert routed(df, rules) == {"a": "errors", "b": "money"}
    assert routed(df, rules, "rest") == {"a": "errors", "b": "money", "c": "rest", "d": "rest"}
    assert routed(df, rules[::-1])["a"] == "money"
    last_wins = [Route("level", ["error", "info"], "one"), Route("level", ["error"], "two")]
    assert routed(df, last_wins) == {"a": "two", "b": "one", "c": "one"}


@pytest.mark.parametrize(
    "rules", [[], [Route("", ["x"], "r")], [Route("f", [], "r")], [Route("f", ["x"], "")]]
)
def test_route_rejects_bad_rules(make, rules):
    with pytest.raises(RuleError):
        route(make("{}"), rules)
