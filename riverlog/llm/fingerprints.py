"""SimHash fingerprints and all neighbours within a Hamming radius.

The terms of a text are its words and its pairs of neighbouring words, counted
as often as they occur.  Every term's 64-bit hash votes on each bit, for a set
one or against a clear one, pairs with ``PAIR_VOTES`` votes; the sign of the sum
is the bit.  Votes are counted many bits at a time: four 16-bit counters lie in
a long, so 16 sums over masked hashes count all bits.  Texts are counted in
pieces of so many words that no counter overflows, and the pieces are added.

``neighbours`` finds every pair within ``radius`` by permuted block tables: the
64 bits are cut into ``radius + SPARE`` blocks; two fingerprints that differ in
at most ``radius`` bits agree in ``SPARE`` whole blocks, so they meet in the
table that has those in front.  Equal fingerprints are one entry, whatever the
number of documents that have it.

All of it is built-in expressions; no Python runs on the executors.

Results for odd input: a null text is an empty one; a text without words has
the fingerprint of all zeros; equal texts have equal fingerprints; rows without
a doc_id have a fingerprint but no next document, and null in all columns that
need one; rows that share a doc_id follow one another in the order of their
texts; repeated rows are each returned; extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riverlog.llm.tables import word_list, written

BITS = 64
LANES = 16  # longs of four counters each
PAIR_VOTES = 3
# Words of one piece: their votes fit in a 16-bit counter.
PIECE_WORDS = (1 << 15) // (1 + PAIR_VOTES) - 1
RADIUS = 3
SPARE = 2
ID_BITS = 8  # texts are dealt out in groups of 2**ID_BITS neighbouring doc_ids

_MASK = 0x0001000100010001


def _lane(hashed: Column, lane: int) -> Column:
    return F.shiftrightunsigned(hashed, lane).bitwiseAND(F.lit(_MASK))


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per row of ``texts``, which ``keys`` name: the keys and ``bits``, a long.
    Rows that are dealt by some of the keys are not shuffled."""
    words = texts.select(*keys, word_list(F.col(text)).alias("words"))
    pairs = F.arrays_zip(F.col("words").alias("word"), F.expr("slice(words, 2, size(words))").alias("after"))
    words = words.select(*keys, F.posexplode_outer(pairs).alias("at", "term"))
    word, after = F.col("term.word"), F.col("term.after")
    hashed = words.select(
        *keys,
        F.coalesce(F.expr(f"at div {PIECE_WORDS}"), F.lit(0)).alias("piece"),
        F.when(word.isNotNull(), F.xxhash64(word)).alias("h"),
        F.when(after.isNotNull(), F.xxhash64(word, after)).alias("p"),
    )
    sums = [
        F.sum(
            F.when(F.col("h").isNotNull(), _lane(F.col("h"), lane)).otherwise(F.lit(0))
            + F.when(F.col("p").isNotNull(), _lane(F.col("p"), lane) * PAIR_VOTES).otherwise(F.lit(0))
        ).alias(f"s{lane}")
        for lane in range(LANES)
    ]
    votes = (F.count("h") + F.count("p") * PAIR_VOTES).alias("votes")
    pieces = hashed.groupBy(*keys, "piece").agg(votes, *sums)
    # bit 16 q + lane is counted in quarter q of lane's long
    counts = [
        F.sum(F.shiftrightunsigned(F.col(f"s{lane}"), 16 * q).bitwiseAND(F.lit(0xFFFF))).alias(f"c{16 * q + lane}")
        for q in range(BITS // LANES)
        for lane in range(LANES)
    ]
    totals = pieces.groupBy(*keys).agg(F.sum("votes").alias("votes"), *counts)
    bits = F.lit(0).cast("bigint")
    for bit in range(BITS):
        value = (1 << bit) if bit < 63 else -(1 << 63)
        vote = F.when(F.col(f"c{bit}") * 2 > F.col("votes"), F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        bits = bits.bitwiseOR(vote)
    return totals.select(*keys, bits.alias("bits"))


def as_text(bits: Column) -> Column:
    return F.lpad(F.hex(bits), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next_id) for distinct ids: the next smaller one, after the smallest the
    largest.  Ids are range-partitioned once; inside a partition a window finds the
    next, and for the last of each one row per partition is looked at."""
    ranged = written(ids.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id()), "ranged-ids")
    inside = ranged.select("id", F.lead("id").over(W.partitionBy("part").orderBy(F.col("id").desc())).alias("next_id"))
    ends = ranged.groupBy("part").agg(F.min("id").alias("id"), F.max("id").alias("high"))
    order = W.orderBy(F.col("id").desc())
    last = ends.select("id", F.coalesce(F.lead("high").over(order), F.max("high").over(W.partitionBy())).alias("next_id"))
    return inside.where("next_id IS NOT NULL").union(last)


def edited_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (group, nth, doc_id, text, edited), dealt by group: the last half of the code
    points replaced by as many of the next document; and (group, high): the next
    document of a group's last.

    Neighbours of one id group get each other's texts by a window, so texts are
    shuffled once.  The last row of a group needs the first text of the next group;
    first texts, one in 2**ID_BITS of dense ids, are found in the map tasks.
    """
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("group", F.shiftright("doc_id", ID_BITS))
    # the greatest doc_id, and of its rows the first text
    head = F.min(F.struct(F.bitwise_not("doc_id").alias("down"), "text")).alias("head")
    ends = written(texts.groupBy("group").agg(F.max("doc_id").alias("high"), head), "id-groups")
    names = next_ids(ends.select(F.col("group").alias("id")))
    heads = ends.select(F.col("group").alias("next_id"), "high", F.col("head.text").alias("given"))
    gives = written(names.join(heads, "next_id").select(F.col("id").alias("group"), "high", "given"), "next-groups")
    given = gives.select("group", "given")
    order = W.partitionBy("group").orderBy(F.col("doc_id").desc(), "text")
    after = F.coalesce(F.lead("text").over(order), F.col("given"))
    half = F.floor(F.length("text") / 2).cast("int")
    taken = F.substring(F.col("after"), F.lit(1), half)
    # a next document that is too short gives all it has
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), taken)
    rows = texts.join(given, "group", "left").withColumns({"after": after, "nth": F.row_number().over(order)})
    return rows.select("group", "nth", "doc_id", "text", edited.alias("edited")), gives.select("group", "high")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (doubles), and the fingerprint as a long, ``bits``."""
    rows, gives = edited_texts(docs)
    sides = F.posexplode(F.array(F.struct("text"), F.struct(F.col("edited").alias("text")))).alias("side", "one")
    names = ["group", "nth", "doc_id", "n_chars", "edited_sha256"]
    sided = rows.select(
        "group", "nth", "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), sides
    ).select(*names, "side", F.col("one.text").alias("text"))
    bits = fingerprint(sided, [*names, "side"])
    both = bits.groupBy(*names).agg(
        F.max(F.when(F.col("side") == 0, F.col("bits"))).alias("bits"), F.max(F.when(F.col("side") == 1, F.col("bits"))).alias("edited_bits")
    )
    both = written(both, "fingerprints")
    firsts = both.groupBy("doc_id").agg(F.min("bits").alias("given"))
    ends = gives.join(firsts, gives["high"] == firsts["doc_id"]).select("group", "given")
    order = W.partitionBy("group").orderBy("nth")
    after = F.coalesce(F.lead("bits").over(order), F.col("given"))
    result = both.join(ends, "group", "left").withColumn("after", after)
    named = result.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("bits")).alias("fingerprint"),
        as_text(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"), likeness(F.col("bits"), F.col("after")).alias("near_next"), "bits",
    )
    nameless = docs.where("doc_id IS NULL").select(
        F.lit(None).cast("bigint").alias("doc_id"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    nameless = fingerprint(nameless, ["doc_id", "n_chars", "row"])
    nothing = F.lit(None)
    nameless = nameless.select(
        "doc_id", "n_chars", nothing.cast("string").alias("edited_sha256"), as_text(F.col("bits")).alias("fingerprint"),
        nothing.cast("string").alias("edited_fingerprint"), nothing.cast("double").alias("near_edited"),
        nothing.cast("double").alias("near_next"), "bits",
    )
    return named.unionByName(nameless)


def _tables(radius: int, spare: int) -> list[int]:
    """The mask of every table: the bits of the blocks in front."""
    count = radius + spare
    edges = [round(i * BITS / count) for i in range(count + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(count)]
    masks = [sum(chosen) for chosen in combinations(blocks, spare)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in masks]


def neighbours(queries: DataFrame, entries: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """Pairs (bits, other, distance) of distinct fingerprints of ``queries`` and
    ``entries`` within ``radius``, each once, equal ones included."""
    masks = F.array(*(F.lit(mask).cast("bigint") for mask in _tables(radius, spare)))
    asked = queries.select("bits").distinct().select("bits", F.posexplode(masks).alias("table", "mask"))
    asked = asked.select("bits", "table", F.col("bits").bitwiseAND(F.col("mask")).alias("front"))
    held = entries.select(F.col("bits").alias("other")).distinct().select("other", F.posexplode(masks).alias("table", "mask"))
    held = held.select("other", "table", F.col("other").bitwiseAND(F.col("mask")).alias("front"))
    met = asked.join(held, ["table", "front"])
    distance = F.bit_count(F.col("bits").bitwiseXOR(F.col("other")))
    return met.withColumn("distance", distance).where(F.col("distance") <= radius).select("bits", "other", "distance").distinct()
