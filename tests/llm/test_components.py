"""Components of random graphs against a plain union-find."""

import random

import pytest

from riverlog.llm.components import components, rejoined, roots


def plain(links):
    name = {}

    def find(node):
        while name.setdefault(node, node) != node:
            node = name[node]
        return node

    for u, v in links:
        a, b = find(u), find(v)
        name[max(a, b)] = min(a, b)
    return {node: find(node) for node in list(name)}


def table(spark, links):
    return spark.createDataFrame(links, "u bigint, v bigint")


def found(df):
    rows = df.collect()
    assert len({row["node"] for row in rows}) == len(rows)
    return {row["node"]: row["component"] for row in rows}


@pytest.mark.parametrize("seed", range(3))
def test_any_links(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(50)] + [(200 + n, 201 + n) for n in range(20)]
    links = [(u, v) for u, v in links if u != v]
    assert found(components(table(spark, links))) == plain(links)
    assert found(components(table(spark, []))) == {}


@pytest.mark.parametrize("seed", range(2))
def test_one_link_a_node_and_more_links(spark, seed):
    draw = random.Random(seed)
    pointers = [(u, draw.randrange(u)) for u in range(1, 90) if draw.random() < 0.7] + [(300 + n, 299 + n) for n in range(30)]
    first = roots(table(spark, pointers))
    assert found(first) == plain(pointers)
    more = [(draw.randrange(400), draw.randrange(400)) for _ in range(25)]
    more = [(max(pair), min(pair)) for pair in more if pair[0] != pair[1]]
    assert found(rejoined(first, table(spark, more))) == plain(pointers + more)
    assert found(rejoined(first, table(spark, []))) == plain(pointers)
