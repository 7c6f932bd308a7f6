"""Near-duplicate classes by consistent weighted sampling.

Words are runs of ASCII letters and digits and of everything beyond ASCII, with
A-Z in lower case. The features of a document are its shingles of five words
(all its words, if fewer), weighted by TF-IDF: the number of times the shingle occurs, times
ln((documents + 1) / (frequency + 1)) + 1. The frequency is the number of documents that
hold the shingle, ``FLOOR`` of all documents at least. So boilerplate weighs little,
all rarer shingles weigh the same, and the table of exact frequencies that every task gets
has at most the mean number of shingles of a document divided by ``FLOOR`` entries.

Improved consistent weighted sampling draws, per hash function and shingle,
r and c from Gamma(2, 1) and b from [0, 1); with t = floor(ln w / r + b) and
ln a = ln c - r (t - b + 1), the shingle of smallest a, together with t, is the
sample. Two documents agree on a sample with probability equal to their weighted
Jaccard similarity. Samples are banded, and documents that share a band are
candidates.

Documents with the same shingles and counts are one node, so copies never make
pairs. Each node of a bucket is paired with the bucket's smallest node. That only saves
work: all nodes of buckets that hold several components after it are joined on the
rarest of their shingles (prefix filtering), so that no pair that could reach the limit
stays untried there. Pairs are verified by their exact weighted Jaccard similarity, and
the classes are the connected components of the links. A class is named by its smallest
doc_id; its first document is the one of the smallest doc_id and, among those, text key.

A document without words, or without a doc_id, is alone; the class of the latter
is null. Rows that share a doc_id are told apart by their texts. An empty table gives an
empty result. Only doc_id and text are read, so columns of other names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm import grams
from cohortry.llm.common import apart, cut, small_enough, stored, text_key, unused

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4

# The least frequency of a shingle, as a share of all documents.
FLOOR = 1 / 256
# Entries of the hashed counts that tell which shingles may be above it.
HASHED_ENTRIES = 1 << 18

# Rounds of contraction by the order of the nodes; later ones use another order each.
PLAIN_ROUNDS = 2

# Bounds on sums of weights are loosened by this share, for the rounding of the sums.
SLACK = 1e-6

TABLE_BITS = 16


def gamma_tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1) and their logarithms, at 2**16 even steps.

    The distribution function 1 - (1 + x) exp(-x) is inverted by Newton steps.
    """
    steps = 1 << TABLE_BITS
    wanted = (np.arange(steps) + 0.5) / steps
    x = np.where(wanted < 0.26, np.sqrt(2 * wanted), 1.0 - np.log1p(-wanted))
    for _ in range(12):
        x -= ((1 - (1 + x) * np.exp(-x)) - wanted) / np.maximum(x * np.exp(-x), 1e-12)
        x = np.maximum(x, 1e-9)
    return x.astype(np.float32), np.log(x).astype(np.float32)


@dataclass
class Rarity:
    """Inverse document frequencies: of some shingles, in order, and of all others."""

    shingles: np.ndarray
    values: np.ndarray
    others: float

    def of(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.full(len(shingles), self.others)
        at = np.minimum(np.searchsorted(self.shingles, shingles), len(self.shingles) - 1)
        return np.where(self.shingles[at] == shingles, self.values[at], self.others)


def distinct_shingles(block: grams.Block, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text index, shingle and count of the distinct shingles of each text."""
    counts = np.diff(block.starts)
    owners = np.repeat(np.arange(len(block)), counts)
    at = np.arange(max(len(block.hashes) - length + 1, 0))
    whole = owners[: len(at)] == owners[length - 1 :] if len(at) else np.zeros(0, bool)
    shingles, owner = grams.runs(block.hashes, length)[whole], owners[at[whole]]
    short = np.flatnonzero((counts > 0) & (counts < length))
    if len(short):
        few = [grams.runs(block.hashes[block.words(i)], int(counts[i])) for i in short]
        shingles = np.concatenate([shingles, *few])
        owner = np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    owner, shingles = owner[order], shingles[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingles[1:] != shingles[:-1])
    first = np.flatnonzero(new)
    return owner[first], shingles[first], np.diff(np.append(first, len(owner)))


def shingle_weights(
    block: grams.Block, rarity: Rarity, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text index, shingle, count and weight of the distinct shingles of each text."""
    owner, shingles, repeats = distinct_shingles(block, length)
    return owner, shingles, repeats, repeats * rarity.of(shingles)


def samples(
    shingles: np.ndarray,
    weights: np.ndarray,
    starts: np.ndarray,
    count: int,
    tables: tuple[np.ndarray, np.ndarray],
) -> np.ndarray:
    """``count`` consistent weighted samples of each text, as 64-bit numbers.

    The upper half orders by a, the lower half tells shingle and t apart.
    """
    rates, logs = tables
    mask = np.uint64((1 << TABLE_BITS) - 1)
    logarithm = np.log(weights).astype(np.float32)
    found = np.empty((len(starts), count), np.uint64)
    for k in range(count):
        drawn = grams.mixed(shingles ^ np.uint64((k + 1) * 0xA24BAED4963EE407 % (1 << 64)))
        r = rates[drawn & mask]
        b = ((drawn >> np.uint64(32)) & mask).astype(np.float32) / np.float32(1 << TABLE_BITS)
        t = np.floor(logarithm / r + b)
        a = logs[(drawn >> np.uint64(16)) & mask] - r * (t - b + np.float32(1))
        bits = a.view(np.uint32)
        ordered = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        name = (drawn >> np.uint64(32)) + t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)
        key = (ordered.astype(np.uint64) << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF))
        found[:, k] = np.minimum.reduceat(key, starts)
    return found


def band_keys(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.empty((len(found), bands), np.uint64)
    for band in range(bands):
        total = np.full(len(found), band + 1, np.uint64)
        for row in range(rows):
            total = grams.mixed(total * np.uint64(0xD1B54A32D192ED03) + found[:, band * rows + row])
        keys[:, band] = total
    return keys.view(np.int64)


def document_counts(
    docs: DataFrame, features: Callable[[grams.Block], tuple[np.ndarray, np.ndarray]], entries: int
) -> np.ndarray:
    """Documents per hashed entry of their features, and at the end all documents.

    ``features`` gives text index and hash. Each task sends one number per entry at
    most; the driver gets ``entries``.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(entries + 1, np.int64)
        for batch in batches:
            for block in grams.blocks(batch.column(0), grams.LETTERS):
                owner, hashes = features(block)
                pairs = owner * entries + (hashes % np.uint64(entries)).astype(np.int64)
                held[:entries] += np.bincount(np.unique(pairs) % entries, minlength=entries)
                held[entries] += len(block)
        used = np.flatnonzero(held)
        yield pa.record_batch({"entry": used, "held": held[used]})

    rows = (
        docs.select("text")
        .mapInArrow(counted, "entry long, held long")
        .groupBy("entry")
        .agg(F.sum("held").alias("held"))
        .toPandas()
    )
    held = np.zeros(entries + 1)
    held[rows["entry"].to_numpy(np.int64)] = rows["held"].to_numpy()
    return held


def rarities(docs: DataFrame, length: int, floor: float, entries: int) -> Rarity:
    """Exact document frequencies of the shingles in more than ``floor`` of the documents.

    Hashed counts are never too low, so they show which shingles may be that frequent;
    only those are counted one by one.
    """
    hashed = document_counts(docs, lambda block: distinct_shingles(block, length)[:2], entries)
    documents, least = hashed[entries], floor * hashed[entries]
    sent = docs.sparkSession.sparkContext.broadcast(hashed[:entries] > least)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for block in grams.blocks(batch.column(0), grams.LETTERS):
                shingles = distinct_shingles(block, length)[1]
                held.append(shingles[sent.value[shingles % np.uint64(entries)]])
            shingles, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            yield pa.record_batch({"shingle": pa.array(shingles.view(np.int64)), "held": pa.array(times)})

    found = (
        docs.select("text")
        .mapInArrow(counted, "shingle long, held long")
        .groupBy("shingle")
        .agg(F.sum("held").alias("held"))
        .where(F.col("held") > least)
        .toPandas()
    )
    shingles = found["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(shingles)

    def rarity(held):
        return np.log((documents + 1) / (held + 1)) + 1

    return Rarity(shingles[order], rarity(found["held"].to_numpy(np.float64)[order]), float(rarity(least)))


def sketched(docs: DataFrame, rarity, length: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text key, identity of the weighted shingles (null without words), bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = gamma_tables()
        for batch in batches:
            for block in grams.blocks(batch.column(2), grams.LETTERS):
                part = batch.slice(block.first, len(block))
                owner, shingles, repeats, weights = shingle_weights(block, rarity.value, length)
                first = np.zeros(len(block), np.int64)
                second = np.zeros(len(block), np.int64)
                keys = np.zeros((len(block), bands), np.int64)
                texts, starts = np.unique(owner, return_index=True)
                if len(texts):
                    seen = shingles + repeats.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
                    for target, salt in ((first, 0x1B873593), (second, 0xCC9E2D51)):
                        named = grams.mixed(seen ^ np.uint64(salt))
                        target[texts] = np.add.reduceat(named, starts).view(np.int64)
                    found = samples(shingles, weights, starts, bands * rows, tables)
                    keys[texts] = band_keys(found, bands, rows)
                empty = np.ones(len(block), bool)
                empty[texts] = False
                listed = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), bands)
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "_text": part.column(1),
                        "first": pa.array(first, mask=empty),
                        "second": pa.array(second, mask=empty),
                        "bands": listed.cast(pa.list_(pa.int64())),
                    }
                )

    return docs.select("doc_id", text_key(F.col("text")).alias("_text"), "text").mapInArrow(
        sketches, f"doc_id {kind}, _text long, first long, second long, bands array<long>"
    )


def similarity(left: tuple, right: tuple) -> float:
    """Weighted Jaccard similarity of (sorted shingles, weights)."""
    _, at, to = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
    shared = np.minimum(left[1][at], right[1][to]).sum()
    total = left[1].sum() + right[1].sum() - shared
    return float(shared / total) if total else 0.0


def verified(pairs: DataFrame, texts: DataFrame, rarity, length: int, least: float) -> DataFrame:
    """The pairs (low, high) whose weighted Jaccard similarity is at least ``least``."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def weighted(text: str) -> tuple:
            block = next(grams.blocks(pa.array([text], pa.string()), grams.LETTERS))
            _, shingles, _, weights = shingle_weights(block, rarity.value, length)
            return shingles, weights

        held_text, held = None, None
        for batch in batches:
            keep = []
            for low, high in zip(batch.column("low_text"), batch.column("high_text"), strict=True):
                low = low.as_py()
                if low != held_text:
                    held_text, held = low, weighted(low)
                keep.append(similarity(held, weighted(high.as_py())) >= least)
            yield batch.select(["low", "high"]).filter(pa.array(keep, pa.bool_()))

    node = texts.schema["node"].dataType.simpleString()
    return (
        pairs.join(texts.select(F.col("node").alias("high"), F.col("text").alias("high_text")), "high")
        .join(texts.select(F.col("node").alias("low"), F.col("text").alias("low_text")), "low")
        .select("low", "high", "low_text", "high_text")
        .mapInArrow(checked, f"low {node}, high {node}")
    )


def components(edges: DataFrame) -> DataFrame:
    """node and label, the smallest node reachable, for every node with an edge.

    Each round moves every node to the smallest of its neighbours and itself, and keeps the
    edges between nodes that are still apart. They shrink from round to round, whatever
    the shape of the graph, as later rounds order the nodes by a hash of their own.
    """
    edges = edges.select("low", "high").where("low <> high")
    steps: list[DataFrame] = []
    while True:
        round_ = len(steps)

        def ordered(node: str):
            drawn = F.xxhash64(F.lit(round_), node) if round_ >= PLAIN_ROUNDS else F.lit(0)  # noqa: B023
            return F.struct(drawn.cast("long").alias("drawn"), F.col(node).alias("node"))

        both = edges.union(edges.select("high", "low"))
        smallest = both.groupBy("low").agg(F.min(ordered("high")).alias("near"))
        step = cut(smallest.select(F.col("low").alias("node"), F.least("near", ordered("low"))["node"].alias("to")))
        steps.append(step)
        moved = edges.join(step.withColumnsRenamed({"node": "low", "to": "left"}), "low").join(
            step.withColumnsRenamed({"node": "high", "to": "right"}), "high"
        )
        edges = cut(
            moved.where("left <> right")
            .select(F.least("left", "right").alias("low"), F.greatest("left", "right").alias("high"))
            .distinct()
        )
        if edges.isEmpty():
            break
    found = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
        found = found.join(later, "to", "left").select("node", F.coalesce("beyond", "to").alias("to"))
    if len(steps) <= PLAIN_ROUNDS:
        # Nodes moved to smaller ones only, so the last is the smallest.
        return cut(found.withColumnRenamed("to", "label"))
    found = cut(found)
    names = found.groupBy("to").agg(F.min("node").alias("label"))
    return cut(found.join(names, "to").select("node", "label"))


def prefixes(texts: DataFrame, rarity, length: int, least: float, entries: int) -> DataFrame:
    """shingle, node, label, total weight of the node and its weight from the shingle on.

    The shingles of a node are put in one order for all nodes, rarest first, and listed
    as long as the weight from there on is ``least`` of the total. Two nodes that are
    similar enough share a listed shingle: from the first shared one on, both
    hold all they share.
    """
    held = document_counts(texts, lambda block: shingle_weights(block, rarity.value, length)[:2], entries)
    counts = texts.sparkSession.sparkContext.broadcast(held[:entries])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in grams.blocks(batch.column("text"), grams.LETTERS):
                part = batch.slice(block.first, len(block))
                owner, shingles, _, weights = shingle_weights(block, rarity.value, length)
                holders = counts.value[shingles % np.uint64(entries)]
                order = np.lexsort((shingles, holders, owner))
                owner, shingles, weights, holders = owner[order], shingles[order], weights[order], holders[order]
                _, starts, times = np.unique(owner, return_index=True, return_counts=True)
                if not len(starts):
                    continue
                size = np.repeat(np.add.reduceat(weights, starts), times)
                before = np.cumsum(weights) - weights
                rest = size - (before - np.repeat(before[starts], times))
                keep = (rest >= least * size * (1 - SLACK)) & (holders > 1)
                at = pa.array(owner[keep])
                yield pa.record_batch(
                    {
                        "shingle": pa.array(shingles[keep].view(np.int64)),
                        "node": part.column("node").take(at),
                        "label": part.column("label").take(at),
                        "size": pa.array(size[keep]),
                        "rest": pa.array(rest[keep]),
                    }
                )

    node = texts.schema["node"].dataType.simpleString()
    return texts.select("node", "label", "text").mapInArrow(
        listed, f"shingle long, node {node}, label {node}, size double, rest double"
    )


def remaining_pairs(listed: DataFrame, least: float) -> DataFrame:
    """All pairs (low, high) of different components that can be similar enough.

    What two nodes share is at least ``least / (1 + least)`` of both totals. For the
    smaller of the two that is more of its own total, so fewer of its shingles do.
    """
    both = least / (1 + least) * (1 - SLACK)
    small = listed.where(F.col("rest") >= 2 * both * F.col("size")).alias("small")
    fits = (
        (F.col("small.shingle") == F.col("large.shingle"))
        & (F.col("small.label") != F.col("large.label"))
        & (F.struct("small.size", "small.node") < F.struct("large.size", "large.node"))
        & (F.col("small.size") >= least * (1 - SLACK) * F.col("large.size"))
        & (F.least("small.rest", "large.rest") >= both * (F.col("small.size") + F.col("large.size")))
    )
    return (
        small.join(listed.alias("large"), fits)
        .select(
            F.least("small.node", "large.node").alias("low"),
            F.greatest("small.node", "large.node").alias("high"),
        )
        .distinct()
    )


def links_of(
    docs: DataFrame, nodes: DataFrame, rarity, length: int, least: float
) -> DataFrame:
    """node and label of the nodes (node, bands) that are linked with another one."""
    buckets = nodes.select(F.explode("bands").alias("key"), "node")
    leaders = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("_size"))
    met = cut(buckets.join(leaders.where("_size > 1"), "key").select("key", "node", "leader"))
    star = met.where("node <> leader").select(F.col("leader").alias("low"), F.col("node").alias("high"))
    star = cut(star.distinct())
    texts = texts_of(docs, met.select("node").distinct())
    labels = components(cut(verified(star, texts, rarity, length, least)))
    labelled = met.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    torn = labelled.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high"))
    rest = cut(labelled.join(torn.where("_low <> _high").select("key"), "key").select("node", "label").distinct())
    if rest.isEmpty():
        return labels
    some = stored(texts.join(rest, "node"))
    listed = cut(prefixes(some, rarity, length, least, HASHED_ENTRIES))
    pairs = cut(remaining_pairs(listed, least).join(star, ["low", "high"], "left_anti"))
    more = verified(pairs, some, rarity, length, least)
    low, high = (
        rest.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")) for side in ("low", "high")
    )
    between = more.join(low, "low").join(high, "high")
    # Edges between components, which are far fewer than those between documents.
    joined = components(cut(between.select(F.col("low_label").alias("low"), F.col("high_label").alias("high")).distinct()))
    joined = joined.select(F.col("node").alias("label"), F.col("label").alias("joined"))
    every = labels.unionByName(rest.select("node", "label")).distinct()
    return cut(every.join(joined, "label", "left").select("node", F.coalesce("joined", "label").alias("label")))


def members(
    docs: DataFrame,
    length: int = SHINGLE,
    least: float = SIMILARITY,
    bands: int = BANDS,
    rows: int = ROWS,
    floor: float = FLOOR,
) -> DataFrame:
    """doc_id and text key of every row, and the (doc_id, text key) that its class is named by.

    The name is null for rows without words or without a doc_id.
    """
    docs = docs.select("doc_id", "text")
    rarity = docs.sparkSession.sparkContext.broadcast(rarities(docs, length, floor, HASHED_ENTRIES))
    sketches = cut(sketched(docs, rarity, length, bands, rows))
    named = sketches.where("doc_id is not null and first is not null")
    node = F.struct("doc_id", "_text")
    nodes = named.groupBy("first", "second").agg(F.min(node).alias("node"), F.any_value("bands").alias("bands"))
    nodes = cut(nodes)
    labels = links_of(docs, nodes, rarity, length, least)
    # Written on its own, so that Spark can split its join with many copies.
    labelled = cut(
        nodes.select("first", "second", "node")
        .join(labels, "node", "left")
        .select("first", "second", F.coalesce("label", "node").alias("name"))
    )
    found = named.select("doc_id", "_text", "first", "second").join(labelled, ["first", "second"])
    alone = sketches.where("doc_id is null or first is null")
    return found.select("doc_id", "_text", "name").unionByName(
        alone.select("doc_id", "_text"), allowMissingColumns=True
    )


def classes(docs: DataFrame, **settings) -> DataFrame:
    """doc_id and class_id of every row."""
    return members(docs, **settings).select("doc_id", F.coalesce("name.doc_id", "doc_id").alias("class_id"))


def texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and text of the given nodes."""
    wanted = small_enough(cut(nodes).select("node.doc_id", "node._text"))
    read = docs.withColumn("_text", text_key(F.col("text"))).join(wanted, ["doc_id", "_text"], "left_semi")
    node = F.struct("doc_id", "_text")
    return stored(read.groupBy(node.alias("node")).agg(F.any_value("text").alias("text")))


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The first document of each class, and of rows with one doc_id and text the first by a hash."""
    found = cut(members(docs, **settings))
    others = found.where("name is not null and name <> struct(doc_id, _text)").select("doc_id", "_text").distinct()
    dropped, its = apart(small_enough(cut(others)), docs)
    key = text_key(docs["text"])
    kept = docs.join(dropped, (docs["doc_id"] == its["doc_id"]) & (key == its["_text"]), "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id", "_text").count().where("count > 1")
    repeated = cut(repeated.select("doc_id", "_text"))
    if repeated.isEmpty():
        return kept.select(docs.columns)
    twice, its = apart(small_enough(repeated), docs)
    same = (docs["doc_id"] == its["doc_id"]) & (key == its["_text"])
    line = Window.partitionBy(docs["doc_id"], key).orderBy(F.xxhash64(*[docs[c] for c in docs.columns]))
    place = unused(docs, "place")
    first = kept.join(twice, same, "left_semi").withColumn(place, F.row_number().over(line)).where(F.col(place) == 1)
    return kept.join(twice, same, "left_anti").select(docs.columns).unionByName(first.select(docs.columns))
