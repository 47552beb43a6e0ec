"""The prefix trie against a plain version; its queue; odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from riverlog.llm import prefix_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain_trie(rows):
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv_id].append((turn is not None, turn or 0, mark, (role, text)))
    own = {conv_id: [item[-1] for item in sorted(items)] for conv_id, items in own.items()}
    rebuilt = {}
    for conv_id, items in own.items():
        h = zlib.crc32(str(conv_id).encode()) % 6
        rebuilt[conv_id] = tuple(own.get(conv_id - conv_id % 100, [])[:h]) + tuple(items[h:])
    members, children = defaultdict(list), defaultdict(list)
    for conv_id, items in rebuilt.items():
        for depth in range(len(items) + 1):
            members[items[:depth]].append(conv_id)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[child] for child in children[node]]
        own_saving = (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        totals[node] = sum(x[0] for x in below) or 1, sum(x[1] for x in below) + own_saving
    result = []
    for node, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        result.append((min(ids), len(node), parent, len(ids), len(children[node]), *totals[node], digest))
    return sorted(result, key=str)


def sample_rows():
    draw = random.Random(3)
    rows = [
        (conv_id, turn, draw.choice(["user", "assistant"]), draw.choice(["a", "bb", "ccc", "éééé"]))
        for conv_id in [*range(230), 1000, 1001, 5007]
        for turn in range(draw.randint(1, 8))
    ]
    # nulls, ties, repeated rows, one turn, one deep conversation, many equal ones, a very long text
    rows += [(7, None, None, None), (7, None, "x", "y"), (None, 1, "a", "b"), (8, 3, "a", "b"), (8, 3, "a", "b")]
    rows += [(9, 2, None, ""), (5500, 0, "user", "z" * 300_000)]
    rows += [(5600, turn, "user", str(turn % 3)) for turn in range(400)]
    for conv_id in range(6000, 6300):
        rows += [(conv_id, 0, "user", "same"), (conv_id, 1, "assistant", "too")]
    return rows


def nodes_of(spark, rows, extra="", **options):
    turns = spark.createDataFrame(rows, SCHEMA + extra)
    found = prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.conversations(turns)), **options)
    return sorted((tuple(row) for row in found.collect()), key=str)


@pytest.fixture
def many_shards(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nodes_equal_the_plain_version(spark, many_shards):
    rows = sample_rows()
    assert nodes_of(spark, rows) == plain_trie(rows)


def test_shards_meet_in_several_rounds_and_queues_spill(spark, many_shards):
    rows = sample_rows()
    assert nodes_of(spark, rows, fan=2, queue_items=3) == plain_trie(rows)


def test_no_rows_one_row_and_extra_columns(spark):
    assert nodes_of(spark, []) == []
    one = [(3, 0, "user", "hi", "x", 1)]
    assert nodes_of(spark, one, ", node string, depth int") == plain_trie([one[0][:4]])


def test_many_ends_of_one_node_are_digested_in_pieces(spark, many_shards):
    rows = [(conv_id * 100, 0, "user", "same") for conv_id in range(3 * prefix_trie.PIECE_IDS)]
    assert nodes_of(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_queue_gives_items_in_order(most):
    draw = random.Random(most)
    queue, waiting = prefix_trie.SpillingQueue(most), []
    for level in range(20):
        for _ in range(draw.randint(0, 40)):
            item = (draw.randint(level, 20), draw.randint(0, 5), draw.random())
            waiting.append(item)
            queue.push(item)
        for node in range(6):
            got = sorted(queue.pop_all((level, node)))
            assert got == sorted(item for item in waiting if item[:2] == (level, node))
        waiting = [item for item in waiting if item[0] != level]
