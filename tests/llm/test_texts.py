"""Operators on documents against plain versions, over given tables and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from riverlog.llm import catalog, fingerprints, mixing, near_dedup, quality_rules, substring_dedup, toxicity
from riverlog.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, words string"

_words = [f"w{i}" for i in range(400)]
_long = random.Random(5)
LONG = " ".join(_long.choice(_words) for _ in range(30_000))
ODD = [
    (1, None, "en", "a", 0, "x", None),
    (2, "", "en", None, 0, None, None),
    (3, " \t\n ", None, "a", 4, "x", None),
    (4, "one two three", "en", "a", 13, "x", "y"),
    (5, "One two THREE", "en", "b", 13, "x", "y"),
    (6, "one two three", "en", "b", 13, "x", "y"),
    (6, "one two three", "en", "b", 13, "x", "y"),
    (7, LONG, "en", "a", len(LONG), "x", "y"),
    (8, LONG + " end", "en", "b", len(LONG) + 4, "x", "y"),
    (9, "the " * 60, "en", "b", 240, "x", "y"),
    (10, LONG[:900], "en", None, 900, "x", "y"),
    (None, "a row without a name " * 8, "en", "a", 168, "x", "y"),
    (11, "ünï ©ödé\x0b漢字 \x00 🎉 " * 9, "de", "b", 150, "x", "y"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return [(row["doc_id"], row["text"]) for row in df.select("doc_id", "text").collect()]


def words(text):
    return WORD.findall(text or "")


def plain_components(rows):
    sets = []
    for doc, text in rows:
        own = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        shingles = {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else ({tuple(own)} if own else set())
        sets.append((doc, shingles))
    parent = {doc: doc for doc, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, left) in enumerate(sets):
        for b, right in sets[:i]:
            if None not in (a, b) and left and right and 100 * len(left & right) >= 75 * len(left | right):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return collections.Counter((doc, len(own), doc if doc is None else find(doc)) for doc, own in sets)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_near_dedup(table, request):
    df = request.getfixturevalue(table)
    got = near_dedup.link_components(df).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows_of(df))
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_near_copies_that_no_hub_links(spark):
    """A chain in which neighbours are near copies and the ends are not, and a family
    whose members are all linked, with the blocks of clusters at work."""
    base = [f"x{i}" for i in range(60)]
    rows = []
    for n in range(12):
        text = base[:]
        text[5 * n : 5 * n + 1] = [f"y{n}"]
        rows.append((100 + n, " ".join(text)))
        base = text
    rows += [(200 + n, " ".join([*(f"z{i}" for i in range(100)), f"end{n}"])) for n in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.link_components(df).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)


def test_outsiders_that_link_with_a_late_member_only(spark):
    """Families of near copies and an outsider each, which is a near copy of the family's
    last member and only nearly one of the others, that hold its bands with smaller ids;
    and families of graded truncations."""
    rng = random.Random(31)
    rows = []

    def edited(own, at):
        return [f"e{rng.getrandbits(40)}" if i in at else word for i, word in enumerate(own)]

    for family in range(8):
        outsider = [f"f{family}-{i}" for i in range(160)]
        late = edited(outsider, {5, 40, 75, 110})  # 20 of 156 shingles: 0.77
        for n in range(40):
            rows.append((1000 * family + n, " ".join(edited(late, {rng.choice(range(12, 156, 7)), rng.choice(range(15, 156, 7))}))))
        rows.append((1000 * family + 40, " ".join(late)))
        rows.append((1000 * family + 41, " ".join(outsider)))
    for family in range(8):
        own = [f"g{family}-{i}" for i in range(150)]
        rows += [(1000 * family + 500 + n, " ".join(own[:size])) for n, size in enumerate([*range(96, 110), 111, 145])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = near_dedup.link_components(df).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)


def test_least_matches_rise_with_the_batches():
    least = near_dedup.least_matches(0.75, 1e-6, [32, 64, 128])
    assert least == sorted(least) and least[0] < 24 and least[-1] < 96


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(90, 80), (80, 90), (70, 70)], "u bigint, v bigint")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 80: 80, 90: 80}


def plain_repeats(rows, window):
    seen = {}
    for doc, text in sorted((d, t or "") for d, t in rows if d is not None):
        own = words(text)
        for i in range(len(own) - window + 1):
            seen.setdefault(tuple(own[i : i + window]), (doc, i))
    out = []
    for doc, text in rows:
        own = words(text)
        gone = [False] * len(own)
        for i in range(len(own) - window + 1):
            if doc is not None and seen[tuple(own[i : i + window])] != (doc, i):
                gone[i : i + window] = [True] * window
        kept = " ".join(w for w, out_ in zip(own, gone, strict=True) if not out_)
        out.append((doc, len(own), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("group_runs", [4096, 2])
@pytest.mark.parametrize("table", ["odd", "documents"])
def test_substring_dedup(table, group_runs, request):
    df = request.getfixturevalue(table)
    got = substring_dedup.repeats(df, group_runs=group_runs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows_of(df), 20)


@pytest.mark.parametrize("window", [20, 5])
def test_repeats_of_every_period_inside_one_text(spark, window):
    rows = []
    for period in range(1, 26):
        for times in (2, 3, 4, 6):
            own = [f"p{period}x{times}w{i}" for i in range(60 + period)]
            rows.append((len(rows), " ".join([*own[:30], *own[60:] * times, *own[30:60]])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = substring_dedup.repeats(df, window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows, window)


def test_many_runs_of_few_texts_are_a_large_group(spark, monkeypatch):
    tables = {}

    def keeping(df, name, made=substring_dedup.written):
        tables[name] = made(df, name)
        return tables[name]

    monkeypatch.setattr(substring_dedup, "written", keeping)
    phrase = " ".join(f"q{i}" for i in range(24))
    rows = [(n, " ".join(f"{phrase} " + " ".join(f"d{n}-{k}-{i}" for i in range(25)) for k in range(12))) for n in range(2)]
    df = spark.createDataFrame([*rows, (5, rows[0][1][:200])], "doc_id bigint, text string")
    got = substring_dedup.repeats(df, group_runs=8).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert collections.Counter(map(tuple, got)) == plain_repeats(rows_of(df), 20)
    count = collections.Counter(r.key for r in tables["suffix-runs"].collect())
    large = {r.key for r in tables["large-groups"].collect()}
    assert large == {key for key, n in count.items() if n > 8} and large


def test_substring_rewrite(odd):
    got = substring_dedup.rewrite(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[1] is None and texts[7] == LONG and words(texts[8])[-1:] != [] and len(words(texts[9])) == 1
    assert len(words(texts[10])) <= 1  # its last word may be cut, so only that one differs


def plain_fingerprint_inputs(rows):
    order = sorted((d for d in rows if d[0] is not None), key=lambda d: (-d[0], d[1] or ""))
    out = []
    for at, (doc, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        out.append((doc, len(text), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_fingerprints(table, request):
    df = request.getfixturevalue(table)
    rows = fingerprints.fingerprints(df).collect()
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows if r.doc_id is not None)
    assert got == plain_fingerprint_inputs(rows_of(df))
    assert len(rows) == df.count()
    assert all(r.near_edited is None or 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    by_text = collections.defaultdict(set)
    texts = dict(rows_of(df))
    for r in rows:
        by_text[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(found) == 1 for found in by_text.values())


def test_block_tables_find_all_within_the_radius(spark):
    rng = random.Random(9)
    centre = [rng.getrandbits(64) for _ in range(20)]
    near = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(20)]
    values = [v - (1 << 64) if v >> 63 else v for v in {*centre, *near}]
    df = spark.createDataFrame([(v,) for v in values], "bits bigint")
    got = {(r.bits, r.other) for r in fingerprints.neighbours(df, df).collect()}
    assert got == {(a, b) for a in values for b in values if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= fingerprints.RADIUS}


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_quality_measures(table, request):
    df = request.getfixturevalue(table)
    for r, (_, text) in zip(quality_rules.ledger(df).collect(), [(r.doc_id, r.text) for r in df.collect()], strict=True):
        own = words(text)
        count = collections.Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
        covered = [0] * len(own)
        for i in range(len(own) - 7):
            if count[tuple(own[i : i + 8])] > 1:
                covered[i : i + 8] = [1] * 8
        lines = [line for line in (text or "").split("\n") if WORD.search(line)]
        expected = (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected


def test_policies_and_ablation(documents):
    entries = quality_rules.ledger(documents)
    kept = quality_rules.apply_policy(entries, quality_rules.STRICT).where("kept").count()
    assert kept == entries.where("fail_bits = 0").count()
    for r in quality_rules.ablation(entries, quality_rules.STRICT).collect():
        bit = [rule.name for rule in quality_rules.RULES].index(r.rule)
        assert r.failed == entries.where(F.expr(f"(fail_bits >> {bit}) & 1 = 1")).count()
        assert r.rejected_alone == entries.where(f"fail_bits = {1 << bit}").count()
        assert r.kept_without == kept + r.rejected_alone


@pytest.mark.parametrize("table", ["odd", "documents"])
def test_mixing(table, request):
    df = request.getfixturevalue(table)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        assert r["size"] == len(words(r.text)) and 0 <= r.taken <= 2 * r["size"]
        assert r.copies == len(r.positions) and all(0 <= p <= 1 for p in r.positions)
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    names = sorted(sizes, key=lambda name: (name is None, name))
    weight = {name: (3, 1, 2)[i % 3] for i, name in enumerate(names)}
    full, budget = set(), 1.5 * sum(sizes.values())
    while True:
        left = budget - sum(2 * sizes[name] for name in full)
        share = sum(weight[name] for name in names if name not in full)
        new = {name for name in names if name not in full and weight[name] * left / share > 2 * sizes[name]}
        if not new:
            break
        full |= new
    for name in names:
        goal = 2 * sizes[name] if name in full else weight[name] * left / share
        assert target[name] == pytest.approx(goal) and abs(taken[name] - goal) < 1
    again = {(r.doc_id, r.text, r.taken) for r in mixing.mix(df.repartition(3)).collect()}
    assert again == {(r.doc_id, r.text, r.taken) for r in rows}


def test_positions_follow_the_demand(documents):
    """At any time, each source has been taken about its integrated share."""
    mixed = [r for r in mixing.mix(documents).collect() if r.position is not None]
    by_source = collections.defaultdict(list)
    for r in mixed:
        by_source[r.source].append(r)
    for index, name in enumerate(sorted(by_source)):
        begin, end = mixing.SCHEDULES[index % len(mixing.SCHEDULES)]
        rows = by_source[name]
        largest = max(r["size"] for r in rows)
        for time in (0.25, 0.5, 0.75):
            done = sum(r["size"] for r in rows for p in r.positions if p < time)
            demand = rows[0].target * (begin * time + (end - begin) * time * time / 2) / ((begin + end) / 2)
            assert abs(done - demand) <= 2 * largest + 1


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalog.op7_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_toxicity_without_labels_or_texts(spark, odd):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert all(r.predicted == 0 or r.score == 0.5 for r in toxicity.toxicity(odd, none).collect())
    one = spark.createDataFrame([(4, 1, 0), (7, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.toxicity(odd, one).count() == odd.count()


def test_grades_follow_quality(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalog.op9_quality_grade(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known = [(labels[r.doc_id] == 1, r.kept) for r in rows if r.doc_id in labels]
    assert sum(a == b for a, b in known) / len(known) > 0.95
    assert all(0 <= r.expected_grade <= 2 for r in rows)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    for result in (
        near_dedup.link_components(empty), substring_dedup.repeats(empty), substring_dedup.rewrite(empty),
        fingerprints.fingerprints(empty), quality_rules.ledger(empty), mixing.mix(empty), toxicity.toxicity(empty, labels),
    ):
        assert result.count() == 0
