"""Near-duplicates by MinHash, verified in sequence.

A document is the set of its distinct shingles of five words.  Equal sets are
reduced to one representative (the smallest doc_id).  Representatives with an
equal band of their signatures are candidates; a true pair at the threshold of
0.75 shares none of the 32 bands of 4 with a probability of 5e-6.  Candidates
are compared signature batch by signature batch: after each, the posterior of
the similarity (uniform prior) tells whether it may still reach the threshold,
and the pair is dropped once that is less likely than ``miss``.  What survives
is decided on the full sets.

No bucket is expanded into all its pairs at once.  First every member is
compared with its buckets' smallest members, the hubs, and verified with the
hub it agrees with most; so a group of near copies becomes one component by as
many comparisons as it has members.  Then only pairs of one bucket that are in
different components so far are looked at, in blocks of bounded size.  What may
still be linked falls into clusters, every member by its own possible links: first
by one with a hub each, then a block of a bucket emits a spanning forest of those
between clusters so far, never the pairs.  The texts of a cluster are dealt into blocks again, pairs of different components are decided on the full sets
there, and the links found, a forest too, complete the components.  So every
candidate pair is either in one component anyway or was decided: components are
exact up to the two stated probabilities.

Results for odd input: null, empty and blank texts have no shingles, are linked
with nothing and kept; a text of one to four words is one shingle, the whole
sequence; doc_id is taken as unique - rows that share one are each returned with
the component of their own text, and a link of one may stand for the others; a
row without doc_id is linked with nothing, has no component and is kept;
repeated rows are all returned; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverlog.llm.components import components, rejoined, roots
from riverlog.llm.tables import written
from riverlog.llm.words import gram_hashes, mix, slices, span_hashes, words_of

SHINGLE = 5
PERCENT = 75
HASHES = 128
BANDS = 32
BATCH = 32
MISS = 1e-6
BLOCK = 1024  # members compared in one step, in two such blocks at most
BLOCK_SHINGLES = 1_000_000  # shingles of a block's full sets, beyond its largest one
HUB_TEXTS = 256  # texts verified against one copy of a hub's text

_seed = np.random.default_rng(75)
_FACTOR = _seed.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _seed.integers(0, 1 << 32, HASHES, dtype=np.uint32)


def least_matches(threshold: float, miss: float, sizes: list[int]) -> list[int]:
    """Per number of compared hashes: the fewest agreeing ones with which the
    similarity may still reach the threshold.

    With a uniform prior and m of n agreeing, the chance of a similarity of p or
    more is that of at most m successes in n + 1 draws of chance p.  Hashes are
    compared by one byte, so unequal ones agree by chance once in 256.
    """
    p = threshold + (1 - threshold) / 256
    found = []
    for n in sizes:
        tail = 0.0
        for m in range(n + 1):
            tail += comb(n + 1, m) * p**m * (1 - p) ** (n + 1 - m)
            if tail >= miss:
                break
        found.append(m)
    return found


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and where each text's begin and end."""
    words = words_of(column, lower=True)
    grams = gram_hashes(words.hash, SHINGLE)
    short = span_hashes(words.hash, words.first)
    counts = np.diff(words.first)
    out, bounds = [], np.zeros(len(column) + 1, dtype=np.int64)
    for row, n in enumerate(counts):
        if n >= SHINGLE:
            values = np.unique(grams[words.first[row] : words.first[row] + n - SHINGLE + 1])
        else:
            values = short[row : row + 1] if n else grams[:0]
        out.append(values)
        bounds[row + 1] = bounds[row] + len(values)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), bounds


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """HASHES minima of each non-empty set, as rows of 32-bit numbers."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    signature = np.empty((HASHES, len(bounds) - 1), dtype=np.uint32)
    for i in range(HASHES):
        signature[i] = np.minimum.reduceat(x * _FACTOR[i] + _ADD[i], bounds[:-1])
    return signature.T


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = HASHES // BANDS
    parts = signature.reshape(len(signature), BANDS, rows).astype(np.uint64)
    key = np.full((len(signature), BANDS), np.uint64(0)) + mix(np.arange(BANDS).astype(np.uint64) + np.uint64(1))
    for i in range(rows):
        key = mix(key ^ parts[:, :, i])
    return key.view(np.int64)


_FEATURES = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary, bands array<bigint>"


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            values, bounds = shingle_sets(part.column("text"))
            counts = np.diff(bounds)
            full = np.flatnonzero(counts)
            k1, k2 = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64)
            sig: list = [None] * len(counts)
            bands: list = [None] * len(counts)
            if len(full):
                edges = np.append(bounds[:-1][full], len(values))
                k1[full] = np.add.reduceat(mix(values), edges[:-1])
                k2[full] = np.add.reduceat(mix(values ^ np.uint64(0x5BD1E995)), edges[:-1])
                signature = signatures(values, edges)
                low = np.ascontiguousarray(signature & np.uint32(255)).astype(np.uint8)
                for row, one, keys in zip(full, low, band_keys(signature), strict=True):
                    sig[row], bands[row] = one.tobytes(), keys
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                 pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
            )


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), HASHES)


_STEPS = list(range(BATCH, HASHES + 1, BATCH))


def _scored_rows(least: list[int]):
    """Pairs that may reach the threshold, with the number of agreeing hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _matrix(batch.column("left")), _matrix(batch.column("right"))
            alive = np.arange(len(left))
            agree = np.zeros(len(left), dtype=np.int64)
            for stop, most in zip(_STEPS, least, strict=True):
                agree[alive] += (left[alive, stop - BATCH : stop] == right[alive, stop - BATCH : stop]).sum(axis=1)
                alive = alive[agree[alive] >= most]
            yield pa.RecordBatch.from_arrays(
                [batch.column("u").take(pa.array(alive)), batch.column("v").take(pa.array(alive)), pa.array(agree[alive])],
                names=["u", "v", "agree"],
            )

    return rows


def _agreeing(matrix: np.ndarray, row: int, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Those of ``others`` that may reach the threshold with ``row``."""
    agree = np.zeros(len(others), dtype=np.int64)
    for stop, most in zip(_STEPS, least, strict=True):
        if not len(others):
            break
        agree = agree + (matrix[others, stop - BATCH : stop] == matrix[row, stop - BATCH : stop]).sum(axis=1)
        keep = agree >= most
        others, agree = others[keep], agree[keep]
    return others


def _forest(node: np.ndarray, label: np.ndarray, comp: np.ndarray, chunk: np.ndarray, linked) -> pa.RecordBatch:
    """A spanning forest, begun at ``label``, of the links between members of different
    ``comp``; ``linked(row, others)`` gives those of ``others`` that ``row`` links with.
    Blocks of two chunks leave the pairs inside a chunk to that chunk's own block."""
    label = label.copy()
    across = len(np.unique(chunk)) > 1
    us, vs = [], []
    for row in range(len(node) - 1):
        others = np.arange(row + 1, len(node))
        others = others[(label[others] != label[row]) & (comp[others] != comp[row])]
        if across:
            others = others[chunk[others] != chunk[row]]
        if not len(others):
            continue
        for other in linked(row, others):
            if label[other] != label[row]:
                us.append(node[row])
                vs.append(node[other])
                label[label == label[other]] = label[row]
    u, v = np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])


def _bucket_block(table: pa.Table, least: list[int]) -> pa.RecordBatch:
    node, label, comp, chunk = (np.asarray(table.column(n)) for n in ("node", "label", "comp", "chunk"))
    column = table.column("sig").combine_chunks()
    matrix = _matrix(pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column)
    # a possible link is not a decided one: it must not stand for those of its components' other members
    return _forest(node, label, comp, chunk, lambda row, others: _agreeing(matrix, row, others, least))


def _cluster_block(table: pa.Table, least: list[int]) -> pa.RecordBatch:
    node, comp, chunk = (np.asarray(table.column(n)) for n in ("node", "comp", "chunk"))
    sets: list[np.ndarray] = []
    for batch in table.to_batches():
        for part in slices(batch):
            values, bounds = shingle_sets(part.column("text"))
            sets.extend(values[a:b] for a, b in zip(bounds, bounds[1:], strict=False))
    size = np.array([len(one) for one in sets])
    full = np.flatnonzero(size)
    node, comp, chunk, size, sets = node[full], comp[full], chunk[full], size[full], [sets[i] for i in full]
    if len(sets) < 2:
        return _forest(node[:0], comp[:0], comp[:0], chunk[:0], None)
    matrix = (signatures(np.concatenate(sets), np.append(0, np.cumsum(size))) & np.uint32(255)).astype(np.uint8)

    def linked(row: int, others: np.ndarray) -> np.ndarray:
        others = _agreeing(matrix, row, others, least)
        if not len(others):
            return others
        own = sets[row]
        values = np.concatenate([sets[i] for i in others])
        hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
        both = np.add.reduceat(hit.astype(np.int64), np.append(0, np.cumsum(size[others])[:-1]))
        return others[100 * both >= PERCENT * (size[row] + size[others] - both)]

    return _forest(node, comp, comp, chunk, linked)


def _block_rows(name_column: str, work, least: list[int]):
    """From members sorted by block: what ``work`` makes of each block, one held at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(n)) for n in (name_column, "i", "j")]
            change = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:], strict=False):
                key = tuple(int(k[a]) for k in keys)
                if held and key != name:
                    yield work(pa.Table.from_batches(held), least)
                    held = []
                name = key
                held.append(batch.slice(a, b - a))
        if held:
            yield work(pa.Table.from_batches(held), least)

    return rows


def _verified_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts sorted by (hub, salt, role), hubs first: links of members with their hub."""
    name, hubs = None, []
    for batch in batches:
        for part in slices(batch):
            values, bounds = shingle_sets(part.column("text"))
            hub, salt, role, doc = (np.asarray(part.column(n)) for n in ("hub", "salt", "role", "doc_id"))
            us, vs = [], []
            for row in range(part.num_rows):
                own = values[bounds[row] : bounds[row + 1]]
                if (hub[row], salt[row]) != name:
                    name, hubs = (hub[row], salt[row]), []
                if role[row] == 0:
                    hubs.append(own)
                    continue
                for other in hubs:
                    if not len(own) or not len(other):
                        continue
                    at = np.minimum(np.searchsorted(other, own), len(other) - 1)
                    both = int((other[at] == own).sum())
                    if 100 * both >= PERCENT * (len(own) + len(other) - both):
                        us.append(doc[row])
                        vs.append(hub[row])
                        break
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold.  A text travels once
    per pair it is ``u`` of; ``v``'s text once per HUB_TEXTS pairs."""
    sizes = pairs.groupBy("v").agg(F.ceil(F.count("*") / HUB_TEXTS).alias("salts"))
    salted = pairs.join(sizes, "v").select(
        F.col("v").alias("hub"), F.pmod(F.xxhash64("u"), "salts").alias("salt"), F.col("u").alias("doc_id"), F.lit(1).alias("role")
    )
    hubs = salted.select("hub", "salt").distinct().select("hub", "salt", F.col("hub").alias("doc_id"), F.lit(0).alias("role"))
    return (
        texts.hint("merge")
        .join(salted.union(hubs), "doc_id")
        .select("hub", "salt", "role", "doc_id", "text")
        .repartition("hub", "salt")
        .sortWithinPartitions("hub", "salt", "role")
        .mapInArrow(_verified_rows, "u bigint, v bigint")
        .distinct()
    )


def _dealt(members: DataFrame, name: str) -> DataFrame:
    """Members of ``name`` with a number of ``chunks``, dealt to the blocks of each two chunks."""
    dealt = members.withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("chunks", "other")
    return dealt.repartition(name, "i", "j").sortWithinPartitions(name, "i", "j")


def link_components(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept (doc_id = component_id)."""
    least = least_matches(PERCENT / 100, miss, _STEPS)
    named = docs.select(F.col("doc_id").cast("bigint"), "text")
    features = written(named.mapInArrow(_feature_rows, _FEATURES), "shingle-sets")
    sets = features.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n_shingles")
    nodes = written(sets.agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "distinct-sets")
    sigs = nodes.select("node", "sig")
    members = nodes.select("node", F.explode("bands").alias("band"))
    hubs = members.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1")
    shared = written(members.join(hubs, "band"), "shared-bands")

    pairs = shared.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    scored = (
        pairs.join(sigs.toDF("u", "left"), "u")
        .join(sigs.toDF("v", "right"), "v")
        .select("u", "v", "left", "right")
        .mapInArrow(_scored_rows(least), "u bigint, v bigint, agree bigint")
    )
    scored = written(scored, "hub-pairs")
    best = scored.groupBy("u").agg(F.max_by("v", F.struct("agree", -F.col("v"))).alias("v"))
    texts = named.where("doc_id IS NOT NULL AND text IS NOT NULL")
    links = written(verified(best, texts), "links-to-hubs")
    first = written(roots(links), "first-components")

    comp = F.coalesce("component", "node")
    late = scored.select("u", "v").join(first.toDF("u", "cu"), "u", "left").join(first.toDF("v", "cv"), "v", "left")
    late = written(late.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v"), "possible-links")
    # members that possible links to hubs join are in one cluster already
    hung = written(roots(late.groupBy("u").agg(F.min("v").alias("v"))), "first-clusters")
    rest = shared.where("n > 2").join(first, "node", "left").join(hung.toDF("node", "label"), "node", "left")
    rest = rest.select("band", "node", "hub", comp.alias("comp"), F.coalesce("label", "node").alias("label"))
    spans = rest.groupBy("band").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("comp", "label")], F.count("*").alias("m"))
    mixed = spans.where("min_comp < max_comp AND min_label < max_label")
    rest = rest.where("node <> hub").join(mixed.select("band", F.ceil(F.col("m") / BLOCK).cast("int").alias("chunks")), "band")
    blocks = _dealt(rest.join(sigs, "node"), "band").mapInArrow(_block_rows("band", _bucket_block, least), "u bigint, v bigint")
    clusters = rejoined(hung, blocks.union(late)).withColumnRenamed("component", "cluster")
    clusters = clusters.join(nodes.select("node", "n_shingles"), "node").join(first, "node", "left")
    clusters = clusters.select("node", "cluster", "n_shingles", comp.alias("comp"))
    sizes = clusters.groupBy("cluster").agg(
        F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("chunks")
    )
    read = texts.withColumnRenamed("doc_id", "node").hint("merge").join(clusters.join(sizes, "cluster"), "node")
    read = _dealt(read.drop("n_shingles"), "cluster")
    more = read.mapInArrow(_block_rows("cluster", _cluster_block, least), "u bigint, v bigint")
    final = rejoined(first, more)

    # a set's own node, then the component its node is in
    named_sets = nodes.select("k1", "k2", "n_shingles", "node").join(final, "node", "left")
    named_sets = named_sets.select("k1", "k2", "n_shingles", comp.alias("component"))
    joined = features.select("doc_id", "n_shingles", "k1", "k2").join(named_sets, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    joined = joined.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return joined.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """All rows and columns of the documents that stay: the smallest doc_id of each
    component, and rows without a doc_id."""
    gone = link_components(docs, miss).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("bigint") == F.col("_gone"), "left_anti")
