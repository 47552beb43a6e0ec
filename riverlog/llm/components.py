"""Connected components of a table of links.

``components``: alternating stars.  Every round links the larger neighbours of
each node to its smallest one, then the smaller ones; nodes only ever move to
smaller names, and rounds grow with the logarithm of the longest path.

``roots``: where every node has one link, to a smaller one, following links and
halving paths is enough, one join a round.

Nothing is gathered: rounds are grouped minima and joins, written to the shared
folder so that they are never redone; whether a round changed anything is told by
sums that the write itself observes.  Minima go through an exchange of their own
before a join, so that Spark may split a hub's neighbours over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from riverlog.llm.tables import written


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple]:
    """The edges as a table, with their number and a sum of hashes."""
    seen = Observation()
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("total")
    edges = edges.observe(seen, F.count(F.lit(1)).alias("n"), total)
    table = written(edges, name)
    return table, (seen.get["n"], seen.get["total"])


def components(links: DataFrame) -> DataFrame:
    """From links (u, v): (node, component) for every node that has a link; the
    component is the smallest node that can be reached."""
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = _written(edges, "links")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).repartition("u")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m")).repartition("u")
        joined = large.join(least, "u")
        small = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges, after = _written(small.distinct(), "stars")
        if after == before:
            break
        before = after
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select("v", "v").distinct())


def roots(links: DataFrame) -> DataFrame:
    """``components`` of links (u, v) in which no u comes twice and v < u."""
    edges, before = _written(links, "links")
    while True:
        above = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
        further = edges.join(above, "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        edges, after = _written(further, "pointers")
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def rejoined(first: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what ``first`` (node, component) knows and more links between
    nodes: only the components that the links join are looked at again."""
    at = first.select(F.col("node").alias("u"), F.col("component").alias("cu"))
    to = first.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    between = links.join(at, "u", "left").join(to, "v", "left")
    between = between.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    moved = components(between).withColumnRenamed("component", "moved")
    known = first.join(moved.withColumnRenamed("node", "component"), "component", "left")
    known = known.select("node", F.coalesce("moved", "component").alias("component"))
    # nodes without a component before are named by themselves
    fresh = moved.join(first.select("node"), "node", "left_anti").select("node", F.col("moved").alias("component"))
    return known.union(fresh)
