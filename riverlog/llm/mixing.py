"""Mixing sources to target weights along a training run.

Every source has a target in words and a schedule: its rate at the begin and at
the end of the run, linear between.  The rate integrated over time is the
source's cumulative demand; a document lies in its source's own order at a
cumulative supply, and the time at which demand reaches that supply is its
training position.  All sources' documents, range-sorted by position, are the
mix: at any time each source has given its share so far.

The order inside a source is that of a hash of the row.  Supply is a running
sum in two steps, over the words of hash slots and inside each slot, so the
rows of one source, however hot, are never together in one task.

Results for odd input: a null or blank text has size 0, no words are taken from
it and its position is that of its place; a null source is a source of its own,
last in order; equal rows share their place and are treated alike but for the
order among them, which does not show; an empty table gives an empty result.
Extra columns stay; those the operator adds replace columns of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverlog.llm.tables import word_count

# Fixed values of the contract: weights in turn, the share of all words, the cap.
WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_TIMES = 2
# Slots a source's rows are dealt into by hash; a power of two.
SLOTS = 1 << 14
# Rates at the begin and the end of the run, in turn over the sources.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))


def targets(sources: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES) -> DataFrame:
    """Per source (source, source_size): its weight and its target in words.

    The budget is shared by weight; what exceeds a source's cap is shared among
    the others until none is above.  Taken in the order of cap by weight, the
    capped sources come first, so one pass of running sums finds them: a source
    is capped if its part of what the ones before it leave is above its cap.
    The table has a row per source, not per document.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.col("rank") % len(weights)).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    total = F.sum("source_size").over(W.partitionBy()) * share_percent / 100.0
    upward = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    from_here = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(0, W.unboundedFollowing)
    left = total - F.coalesce(F.sum("cap").over(upward), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(from_here))
    ranked = ranked.withColumn("full", F.col("weight") * F.col("level") >= F.col("cap"))
    level = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(W.partitionBy())
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * level["level"])
    return ranked.withColumn("target", target).drop("cap", "level", "full")


def _position(part: Column, begin: Column, end: Column) -> Column:
    """The time at which a demand of rates begin..end has run through ``part`` of its whole.

    Demand up to t is (begin t + (end - begin) t^2 / 2) / ((begin + end) / 2);
    the form of the root without a difference in the numerator also holds for
    even rates.
    """
    area = part * (begin + end) / 2
    return 2 * area / (begin + F.sqrt(F.greatest(begin * begin + 2 * (end - begin) * area, F.lit(0.0))))


def mix(docs: DataFrame, weights=WEIGHTS, share_percent: int = SHARE_PERCENT, most: int = MOST_TIMES, schedules=SCHEDULES, slots: int = SLOTS) -> DataFrame:
    """All rows and columns with ``size``, ``source_size``, ``target``, ``taken``
    (words the mix takes, repeats counted), ``copies`` (``taken`` in whole
    documents, a part of half or more counted as one), ``positions`` (of those copies,
    0 to 1) and ``position`` (where the first word taken is; null if none is)."""
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))
    place = F.xxhash64("doc_id", "source", "text", F.lit(7))
    sized = docs.withColumns({"size": word_count(F.col("text")), "_key": key, "_place": place})
    sized = sized.withColumn("_slot", F.pmod("_place", F.lit(slots)))
    by_slot = sized.groupBy("_key", "_slot").agg(F.sum("size").alias("_sum"), F.first("source").alias("source"))
    running = W.partitionBy("_key").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    goals = by_slot.groupBy("_key").agg(F.sum("_sum").alias("source_size"), F.first("source").alias("source"))
    goals = targets(goals, weights, share_percent, most).drop("source")
    by_slot = by_slot.select("_key", "_slot", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_before"))
    joined = sized.drop("source_size", "target", "rank").join(by_slot.join(goals, "_key"), ["_key", "_slot"])
    inside = W.partitionBy("_key", "_slot").orderBy("_place", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = joined.withColumn("_start", start)
    # pass k of a source begins at k times its size
    goal = F.floor("target")
    taken = sum(
        (F.least(F.greatest(goal - F.col("source_size") * k - F.col("_start"), F.lit(0)), F.col("size")) for k in range(most)),
        F.lit(0),
    )
    copies = F.floor((F.col("taken") * 2 + F.col("size")) / (F.col("size") * 2))
    rates = F.get(F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in schedules)), F.col("rank") % len(schedules))
    # the times at which each pass reaches the document, of the passes that do
    reached = F.array(
        *(
            F.when((supply <= F.col("target")) & ((goal > supply) | (F.col("size") == 0)), _position(supply / F.greatest(F.col("target"), F.lit(1.0)), rates["a"], rates["b"]))
            for supply in (F.col("_start") + F.col("source_size") * k for k in range(most))
        )
    )
    placed = placed.withColumn("taken", taken.cast("bigint")).withColumn("_reached", F.filter(reached, lambda time: time.isNotNull()))
    once = F.when(F.size("_reached") > 0, 1).otherwise(0)
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(once).cast("int"))
    placed = placed.withColumn("positions", F.slice("_reached", F.lit(1), F.col("copies")))
    placed = placed.withColumn("position", F.get("_reached", F.lit(0))).drop("_reached")
    return placed.drop("_key", "_place", "_slot", "_before", "_start", "rank", "weight")


def copies_in_order(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document once per copy, dealt and sorted by position."""
    rows = mixed.select(*columns, F.explode("positions").alias("_position"))
    rows = rows.repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id")
    return rows.drop("_position")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """Rows dealt by ranges of position and sorted inside them."""
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
