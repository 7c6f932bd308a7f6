"""Document quality by a byte-level convolutional network in numpy.

Learned filters slide over the UTF-8 bytes of the whole document. Overlapping
chunks of two blocks cover it from the first to the last byte; each filter is
max-pooled within each chunk and rectified. The chunks are combined by their
mean and their maximum, and one logistic unit turns both into a probability.

The network is fitted on a sample of labelled rows, bounded per class and in bytes,
that is drawn by a hash of doc_id from all rows outside the held-out fold. Each class
has half of the bytes and what the other leaves; a text above half of them, or one that
does not fit any more, is passed over for the next. Repeated rows count once. Rows are
weighted so that the classes count as in all labels outside the fold. Labels of
the held-out fold, and the columns lang, source and doc_id, are never read for
learning or scoring.

A null or empty text is one chunk of padding and gets the score of that. Without
labels of both classes the score is the share of the class there is, or 0.5.
Labels that repeat a doc_id count once, the highest; null labels do not count.
Rows repeat as given; other columns of any name do no harm. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import text_key

FILTERS = 16
WIDTH = 6
BLOCK = 32
PREDICTED = 0.7

ROWS_PER_CLASS = 1_500
TRAINING_BYTES = 8 << 20
EPOCHS = 8
BATCH = 32
RATE = 0.02
SEED = 5

# Bytes that are convolved at a time; a multiple of the block.
STRETCH = 1 << 14


@dataclass
class Network:
    filters: np.ndarray  # width x 256 x filters
    offsets: np.ndarray  # filters
    mean_weights: np.ndarray
    max_weights: np.ndarray
    bias: float

    @classmethod
    def start(cls, seed: int, prior: float) -> Network:
        draw = np.random.default_rng(seed)
        return cls(
            draw.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32),
            draw.normal(0, 0.1, FILTERS),
            draw.normal(0, 0.1, FILTERS),
            prior,
        )


def padded(text: str | None) -> np.ndarray:
    """The bytes, padded with zeros to whole blocks and a filter's reach."""
    data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    whole = max(-(-len(data) // BLOCK), 1) * BLOCK
    return np.concatenate([data, np.zeros(whole - len(data) + WIDTH - 1, np.uint8)])


def block_maxima(filters: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest response and its place, per block and filter."""
    highest, places = [], []
    count = len(data) - WIDTH + 1
    for start in range(0, count, STRETCH):
        size = min(STRETCH, count - start)
        response = filters[0][data[start : start + size]]
        for j in range(1, WIDTH):
            response += filters[j][data[start + j : start + j + size]]
        blocks = response.reshape(-1, BLOCK, response.shape[1])
        at = blocks.argmax(axis=1)
        highest.append(np.take_along_axis(blocks, at[:, None, :], axis=1)[:, 0, :])
        places.append(at + (start + BLOCK * np.arange(len(blocks)))[:, None])
    return np.concatenate(highest), np.concatenate(places)


def highest_only(filters: np.ndarray, data: np.ndarray) -> np.ndarray:
    parts = []
    count = len(data) - WIDTH + 1
    for start in range(0, count, STRETCH):
        size = min(STRETCH, count - start)
        response = filters[0][data[start : start + size]]
        for j in range(1, WIDTH):
            response += filters[j][data[start + j : start + j + size]]
        parts.append(response.reshape(-1, BLOCK, response.shape[1]).max(axis=1))
    return np.concatenate(parts)


def chunked(blocks: np.ndarray) -> np.ndarray:
    """Maxima of overlapping chunks, each of two neighbouring blocks."""
    return blocks if len(blocks) == 1 else np.maximum(blocks[:-1], blocks[1:])


def logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-x))) if x >= 0 else float(np.exp(x) / (1 + np.exp(x)))


def probability(network: Network, text: str | None) -> float:
    pooled = chunked(highest_only(network.filters, padded(text))) + network.offsets
    pooled = np.maximum(pooled, 0, out=pooled).astype(np.float64)
    return logistic(
        float(pooled.mean(axis=0) @ network.mean_weights + pooled.max(axis=0) @ network.max_weights)
        + network.bias
    )


def gradients(network: Network, data: np.ndarray, label: int, weight: float) -> tuple:
    """Of the weighted log loss of one document; filters sparsely as (places, values)."""
    blocks, places = block_maxima(network.filters, data)
    if len(blocks) > 1:
        left = blocks[:-1] >= blocks[1:]
        pooled = np.where(left, blocks[:-1], blocks[1:])
        places = np.where(left, places[:-1], places[1:])
    else:
        pooled = blocks
    pooled = pooled + network.offsets
    active = pooled > 0
    pooled = np.where(active, pooled, 0).astype(np.float64)
    mean, top = pooled.mean(axis=0), pooled.argmax(axis=0)
    high = pooled[top, np.arange(FILTERS)]
    score = logistic(float(mean @ network.mean_weights + high @ network.max_weights) + network.bias)
    slope = weight * (score - label)
    to_pooled = np.broadcast_to(slope * network.mean_weights / len(pooled), pooled.shape).copy()
    to_pooled[top, np.arange(FILTERS)] += slope * network.max_weights
    to_pooled *= active
    to_filters = np.zeros((WIDTH, FILTERS, 256))
    columns = np.broadcast_to(np.arange(FILTERS) * 256, places.shape)
    for j in range(WIDTH):
        to_filters[j] = np.bincount(
            (columns + data[places + j]).ravel(), to_pooled.ravel(), FILTERS * 256
        ).reshape(FILTERS, 256)
    return to_filters.transpose(0, 2, 1), to_pooled.sum(axis=0), slope * mean, slope * high, slope


def fitted(texts: list[str], labels: list[int], shares: dict[int, float], seed: int = SEED) -> Network:
    """Adam on the weighted log loss; ``shares`` are the true class shares."""
    held = np.bincount(labels, minlength=2) / len(labels)
    weights = [shares[0] / held[0], shares[1] / held[1]]
    network = Network.start(seed, float(np.log(shares[1] / shares[0])))
    values = [network.filters, network.offsets, network.mean_weights, network.max_weights, np.array([network.bias])]
    moments = [(np.zeros_like(v, float), np.zeros_like(v, float)) for v in values]
    data = [padded(text) for text in texts]
    draw = np.random.default_rng(seed)
    step, steps = 0, EPOCHS * -(-len(data) // BATCH)
    for _ in range(EPOCHS):
        order = draw.permutation(len(data))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            each = [gradients(network, data[i], labels[i], weights[labels[i]]) for i in batch]
            sums = [sum(parts) / len(batch) for parts in zip(*each, strict=True)]
            step += 1
            rate = RATE * (1 - (step - 1) / steps)
            for value, gradient, (first, second) in zip(values, sums, moments, strict=True):
                first += 0.1 * (gradient - first)
                second += 0.001 * (gradient**2 - second)
                change = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                value -= (rate * change).astype(value.dtype)
            network.bias = float(values[4][0])
    return network


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def fitting(sizes: pd.DataFrame, most_bytes: int) -> pd.Series:
    """Which rows of ``_label`` and ``bytes``, in their order, fit into the bytes."""
    taken = pd.Series(False, sizes.index)
    left = most_bytes
    for _, each in sizes.groupby("_label"):
        room = most_bytes // 2
        for row, size in each["bytes"].items():
            if size <= room:
                taken[row] = True
                room -= size
                left -= size
    for row, size in sizes.loc[~taken, "bytes"].items():
        if size <= left:
            taken[row] = True
            left -= size
    return taken


def trained(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, most_bytes: int
) -> Network | float:
    """The network, or a constant score where the labels hold less than two classes."""
    known = (
        labels.where(fold(F.col("doc_id")) != 2)
        .where(F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
    )
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return float(counts.get(1, 0) / total) if total else 0.5
    hashed = F.xxhash64("doc_id")
    drawn = [known.where(F.col("_label") == c).orderBy(hashed, "doc_id").limit(rows_per_class) for c in (0, 1)]
    chosen = F.broadcast(drawn[0].union(drawn[1]))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")
    sample = sample.withColumn("_key", text_key(F.col("text")))
    # Long texts leave room for fewer rows, in the order of the hash.
    sized = (
        sample.select("doc_id", "_label", "_key", F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
        .where(F.col("bytes") <= most_bytes // 2)
        .distinct()
    )
    order = [F.xxhash64("doc_id", "_key"), "doc_id", "_key"]
    first = [sized.where(F.col("_label") == c).orderBy(*order).limit(rows_per_class) for c in (0, 1)]
    sizes = first[0].union(first[1]).toPandas()
    sizes["drawn"] = pd.util.hash_array(sizes["doc_id"].to_numpy())
    sizes = sizes.sort_values(["drawn", "doc_id", "_key"], ignore_index=True)
    kept = sizes.loc[fitting(sizes, most_bytes), ["doc_id", "_key"]]
    if kept.empty:
        return float(counts[1] / total)
    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.sparkSession.createDataFrame(
        list(kept.itertuples(index=False, name=None)), f"doc_id {kind}, _key long"
    )
    rows = (
        sample.join(F.broadcast(wanted), ["doc_id", "_key"])
        .groupBy("doc_id", "_label", "_key")
        .agg(F.any_value("text").alias("text"))
        .toPandas()
        .sort_values(["doc_id", "text"])
    )
    found = rows["_label"].tolist()
    if len(set(found)) < 2:
        return float(counts[1] / total)
    return fitted(rows["text"].tolist(), found, {c: counts[c] / total for c in (0, 1)})


def scored(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    predicted: float = PREDICTED,
    rows_per_class: int = ROWS_PER_CLASS,
    most_bytes: int = TRAINING_BYTES,
) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    network = trained(docs, labels, label, rows_per_class, most_bytes)
    if isinstance(network, Network):
        weights = docs.sparkSession.sparkContext.broadcast(
            (network.filters, network.offsets, network.mean_weights, network.max_weights, network.bias)
        )

        @F.pandas_udf("double")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held = Network(*weights.value)
            for texts in batches:
                yield pd.Series([probability(held, text) for text in texts], dtype=float)

        given = score("text")
    else:
        given = F.lit(network)
    return docs.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"),
        given.alias("score"),
    ).withColumn("predicted", (F.col("score") >= predicted).cast("int"))
