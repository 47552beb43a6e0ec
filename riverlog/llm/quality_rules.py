"""Quality rules as a ledger of failure bits, and policies over it.

``ledger`` evaluates every rule once per document and stores the measurements
with one bit per failed rule.  A policy is a version with a mask of rules:
``apply_policy`` keeps what fails none of them, by one bitwise and.
``ablation`` tells what every rule of a policy costs, by counting the distinct
masked bit patterns, of which there are at most as many as subsets of rules
that occur together, whatever the number of documents.

Everything is built-in expressions inside one projection per step; a document
is measured in its own row, so nothing is shuffled.

Results for odd input: a null, empty or blank text has no words, all counts 0,
and fails ``few_words``; repeated rows are measured each by itself; the columns
of the input stay, and a measurement replaces one of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverlog.llm.tables import BLANKS, word_list

# The symbols of the contract and the size of its windows.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Fails where ``test`` over the measurements is true."""

    name: str
    test: str


# The order is the bit order and must only grow, so stored ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("exclamations", "10 * n_exclaims > 5 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        known = [rule.name for rule in rules]
        return sum(1 << known.index(name) for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("v1", tuple(rule.name for rule in RULES))


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words() -> Column:
    """Words covered by windows whose word sequence is in the text twice or more.

    Sorted by (hash, start), windows of one sequence stand together; the starts
    of those with an equal neighbour, sorted, add what each covers beyond the
    one before.  Texts whose window hashes are all different end at the first
    test, which is nearly all of them.
    """
    pairs = F.array_sort(F.transform("_grams", lambda gram, at: F.struct(gram.alias("gram"), at.alias("at"))))
    size = F.size("_grams")

    def equal_neighbour(pair: Column, at: Column) -> Column:
        before = (at > 0) & (F.get("_pairs", at - 1)["gram"] == pair["gram"])
        after = (at < size - 1) & (F.get("_pairs", at + 1)["gram"] == pair["gram"])
        return before | after

    starts = F.array_sort(F.transform(F.filter("_pairs", equal_neighbour), lambda pair: pair["at"]))
    new = F.transform(
        "_starts",
        lambda start, at: F.when(at == 0, F.lit(WINDOW)).otherwise(
            F.least(F.lit(WINDOW), start - F.get("_starts", at - 1))
        ),
    )
    return pairs, starts, F.aggregate(new, F.lit(0).cast("bigint"), lambda total, step: total + step)


def measure(docs: DataFrame) -> DataFrame:
    """All rows and columns with the measurements of ``MEASURES``, and ``n_lines``
    and ``n_exclaims``, each long."""
    text = F.coalesce("text", F.lit(""))
    blank = F.translate(text, BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    pairs, starts, covered = _repeat_words()
    measured = docs.withColumns({"_words": word_list(F.col("text")), "_lines": lines})
    measured = measured.withColumn("_hashes", F.transform("_words", lambda word: F.xxhash64(word)))
    windows = F.when(
        F.size("_hashes") >= WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.size("_hashes") - WINDOW + 1), lambda at: F.xxhash64(F.slice("_hashes", at, WINDOW))
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    measured = measured.withColumn("n_words", F.size("_words").cast("bigint")).withColumn("_grams", windows)
    measured = measured.withColumn(
        "_pairs", F.when(F.size("_grams") > F.size(F.array_distinct("_grams")), pairs)
    ).withColumn("_starts", starts)
    columns = {
        "word_chars": F.length(blank),
        "n_symbols": _count(text, SYMBOLS),
        "n_lines": F.size("_lines"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_exclaims": _count(text, "!"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
    }
    # through a generator no later filter is pushed down, to be evaluated apart and again
    record = F.struct("n_words", *(column.cast("bigint").alias(name) for name, column in columns.items()))
    names = [name for name in docs.columns if name not in ("n_words", *columns)]
    measured = measured.select(*names, F.explode(F.array(record)).alias("_record"))
    return measured.select(*names, "_record.*")


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measurements, and ``fail_bits``: bit i is set where rule i fails."""
    bits = F.lit(0).cast("bigint")
    for bit, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.test), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return measure(docs).withColumn("fail_bits", bits)


def apply_policy(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES, column: str = "kept") -> DataFrame:
    return entries.withColumn(column, F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("bigint")) == 0)


def ablation(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and
    that the policy would keep without it."""
    mask = F.lit(policy.mask(rules)).cast("bigint")
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    named = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, r in enumerate(rules) if r.name in policy.rules]
    return (
        patterns.select("bits", "n", F.explode(F.array(*named)).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
            F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not("r.bit")) == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        )
    )
