"""A group of texts of which many pairs are a little below the threshold: links grow with its members."""

import collections
import random

from riverlog.llm import components, near_dedup
from tests.llm.test_texts import plain_components


def test_links_of_a_group_are_no_more_than_its_members(spark, monkeypatch):
    draw = random.Random(3)
    base = [f"w{n}" for n in range(300)]
    rows = []
    for doc in range(120):
        words = list(base)
        for at in draw.sample(range(0, 300, 5), 6):  # two texts are alike by 0.66 to 0.74: no link, and none that signatures rule out
            words[at] = f"x{doc}_{at}"
        rows.append((doc, " ".join(words)))
    counted = []
    write = components._written

    def counting(edges, name):
        table, sums = write(edges, name)
        counted.append(sums[0])
        return table, sums

    monkeypatch.setattr(components, "_written", counting)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    found = near_dedup.link_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == plain_components(rows)
    assert max(counted) > 20, "the group has possible links"
    assert max(counted) <= len(rows)
