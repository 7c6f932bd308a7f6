"""Nearest neighbours by an inverted index with adaptive dimension scanning.

The measure is Euclidean distance in double precision, between vectors of one length. A
vector takes no part if it is null, empty, zero, has a null or non-finite component, or has no
vec_id.

Equal vectors are one entry with the few smallest of their vec_ids, which is all
that any answer can use. Lists are centred by k-means on a sample of entries, bounded in
number and drawn by hash; every entry is put into the list of its nearest centre. The number
of lists grows with the square root of the entries: beyond what the sample can centre, each
list is split again, by k-means on a bounded sample of its own. Lists are stored in
blocks of bounded size. The ``INDEXED_LENGTHS`` commonest lengths get such an index;
vectors of any other length are compared with all of their length.

The number of lists that a query probes is measured on the sample: the smallest number
that finds the wanted share of true neighbours there, up to all lists. A query goes on
beyond it until its lists hold enough entries for a full answer.

Vectors and queries are rotated at random and compared in blocks of columns. After each
block of columns the distance so far is tested: a pair goes on only if its distance, scaled
up from the columns seen, could still be below the query's threshold (ADSampling's test with
bound ``epsilon``). A query's threshold is what its nearest list gave, and is carried into
the others. Pairs that pass all columns are compared again as they were given.

A query's own vec_id is no candidate. Ties go to the smaller vec_id. Repeated rows
count once, as a query too; one vec_id with several vectors asks with each of them. An empty
table gives an empty result. Other columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import cut, small_enough

NEIGHBOURS = 10
SAMPLE = 20_000
# Lists that one sample centres; more come from splitting them.
MOST_LISTS = 512
ENTRIES_PER_LIST = 32
# Lists per square root of the entries.
LISTS_PER_ROOT = 2.0
INDEXED_LENGTHS = 16
SPLIT_SAMPLE = 2_000
CHECKED_QUERIES = 200
WANTED_RECALL = 0.97
ITERATIONS = 12
COLUMNS = 16
EPSILON = 2.1
VECTORS_PER_BLOCK = 1_000
QUERIES_PER_BLOCK = 250
SEED = 3


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding, in double precision, of the rows that take part."""
    plain = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        "vec_id is not null and embedding is not null"
    )
    limit = F.lit(float("inf"))
    fine = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)
    ) & F.exists("embedding", lambda x: x != 0)
    return plain.where(fine)


def entries_of(vectors: DataFrame, most_ids: int) -> DataFrame:
    """Distinct vectors: entry (the smallest vec_id), size, embedding, the smallest ids.

    An entry may share its vec_id with another vector; both are told apart by ``key``.
    """
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    return (
        vectors.withColumn("_place", place)
        .where(F.col("_place") <= most_ids)
        .groupBy("embedding")
        .agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
        .select(
            F.xxhash64("embedding").alias("key"),
            F.col("ids")[0].alias("entry"),
            F.size("embedding").alias("size"),
            "embedding",
            "ids",
        )
    )


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``left`` from all rows of ``right``."""
    found = (left**2).sum(1)[:, None] + (right**2).sum(1)[None] - 2 * left @ right.T
    return np.maximum(found, 0, out=found)


def nearest_centres(values: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of each value, a bounded number of values at a time."""
    parts = np.array_split(values, max(1, -(-len(values) // 2000)))
    return np.concatenate([squared(part, centres).argmin(1) for part in parts])


def centres_of(sample: np.ndarray, lists: int, iterations: int = ITERATIONS) -> np.ndarray:
    """k-means; an empty list takes the vector farthest from its centre."""
    draw = np.random.default_rng(SEED)
    centres = sample[draw.choice(len(sample), lists, replace=False)].copy()
    for _ in range(iterations):
        near = nearest_centres(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        sizes = np.bincount(near, minlength=lists)
        held = sizes > 0
        centres[held] = sums[held] / sizes[held][:, None]
        if not held.all():
            far = ((sample - centres[near]) ** 2).sum(1).argsort()[::-1]
            centres[~held] = sample[far[: (~held).sum()]]
    return centres


def probes_for(sample: np.ndarray, centres: np.ndarray, neighbours: int, wanted: float) -> int:
    """The smallest number of lists that holds the wanted share of true neighbours."""
    draw = np.random.default_rng(SEED + 1)
    asked = np.sort(draw.choice(len(sample), min(CHECKED_QUERIES, len(sample)), replace=False))
    distances = squared(sample[asked], sample)
    distances[np.arange(len(asked)), asked] = np.inf
    count = min(neighbours, len(sample) - 1)
    if count < 1:
        return len(centres)
    true = np.argpartition(distances, count - 1, axis=1)[:, :count]
    near = nearest_centres(sample, centres)
    order = squared(sample[asked], centres).argsort(1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(centres)), order.shape), 1)
    needed = np.sort(np.take_along_axis(rank, near[true], 1).ravel())
    return int(needed[int(np.ceil(wanted * len(needed))) - 1]) + 1


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED + 2).normal(size=(size, size)))[0]


def scan(
    queries: np.ndarray,
    vectors: np.ndarray,
    turn: np.ndarray,
    keep: int,
    limits: np.ndarray | None = None,
    columns: int = COLUMNS,
    epsilon: float = EPSILON,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (query, vector) that may be among a query's ``keep`` nearest, and their distances.

    ``limits`` are distances beyond which a query needs no vector.
    """
    size = vectors.shape[1]
    turned, asked = vectors @ turn, queries @ turn
    limit = np.full(len(queries), np.inf) if limits is None else limits**2
    # What rounding may add to the distances, which are differences of squares.
    slack = 1e-13 * ((queries**2).sum(1) + (vectors**2).sum(1).max(initial=0))
    seen = min(columns, size)
    partial = squared(asked[:, :seen], turned[:, :seen])
    if len(vectors) > keep:
        # The distances of those nearest in the first columns are a limit too.
        tried = np.argpartition(partial, keep - 1, axis=1)[:, :keep]
        known = ((vectors[tried] - queries[:, None]) ** 2).sum(2).max(1)
        limit = np.fmin(limit, known)

    def bound(seen: int) -> np.ndarray:
        scale = seen / size * (1 + epsilon / np.sqrt(seen)) ** 2 if seen < size else 1.0
        return limit * scale * (1 + 1e-9) + slack

    # A distance that is no number is not above any bound, so it goes on.
    at, to = np.nonzero(~(partial > bound(seen)[:, None]))
    so_far = partial[at, to]
    while seen < size:
        end = min(seen + columns, size)
        so_far = so_far + ((asked[at, seen:end] - turned[to, seen:end]) ** 2).sum(1)
        seen = end
        alive = ~(so_far > bound(seen)[at])
        at, to, so_far = at[alive], to[alive], so_far[alive]
    return at, to, np.sqrt(((vectors[to] - queries[at]) ** 2).sum(1))


def first_of(group: np.ndarray, score: np.ndarray, tie: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest scores of each group."""
    order = np.lexsort((tie, score, group))
    sorted_ = group[order]
    since = np.arange(len(order)) - np.searchsorted(sorted_, sorted_)
    return order[since < most]


@dataclass
class Index:
    """Centres of the lists of one length, entries per list, and how many lists a query probes."""

    centres: np.ndarray
    probes: int
    sizes: np.ndarray | None = None

    def lists(self, values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """place and list, nearest first: ``probes`` lists, and more until they hold ``least`` entries."""
        order = squared(values, self.centres).argsort(1, kind="stable")
        held = np.cumsum(self.sizes[order], axis=1)
        count = np.maximum(self.probes, (held < least).sum(1) + 1)
        taken = np.arange(order.shape[1]) < count[:, None]
        return np.nonzero(taken)[0], order[taken]


def rows_by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """size, rows and vectors of a batch, one size and a bounded number of rows at a time."""
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        part = batch.take(pa.array(np.flatnonzero(sizes == size)))
        for start in range(0, len(part), 2000):
            some = part.slice(start, 2000)
            yield int(size), some, matrix(some.column("embedding"))


def matrix(arrays: pa.ListArray) -> np.ndarray:
    return arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1)


def drawn(entries: DataFrame, size: int, most: int) -> np.ndarray:
    """At most ``most`` vectors of one size, the first by a hash."""
    rows = (
        entries.where(F.col("size") == size).select("embedding").orderBy(F.xxhash64("embedding"), "embedding").limit(most)
    )
    found = rows.toArrow().column("embedding").combine_chunks()
    return matrix(found if isinstance(found, pa.Array) else pa.array([], pa.list_(pa.float64())))


def split(entries: DataFrame, indexes: dict[int, Index], parts: dict[int, int]) -> dict[int, Index]:
    """Indexes whose lists are split into ``parts`` by a sample of each list.

    A task gets the sample of one list, whatever the list holds.
    """
    sent = entries.sparkSession.sparkContext.broadcast(indexes)
    first = Window.partitionBy("size", "list").orderBy("_drawn", "key")
    sample = (
        listed(entries.where(F.col("size").isin(list(parts))), sent, None)
        .withColumn("_drawn", F.xxhash64("key"))
        .withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= SPLIT_SAMPLE)
        .groupBy("size", "list")
        .agg(F.collect_list("embedding").alias("held"))
    )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                size = batch.column("size")[row].as_py()
                held = matrix(batch.column("held")[row].values)
                centres = centres_of(held, min(parts[size], len(held)))
                yield pa.record_batch(
                    {
                        "size": pa.array([size] * len(centres), pa.int32()),
                        "centre": pa.array(list(centres), pa.list_(pa.float64())),
                    }
                )

    rows = sample.mapInArrow(fitted, "size int, centre array<double>").toArrow()
    found = dict(indexes)
    sizes = rows.column("size").to_numpy()
    for size in parts:
        held = rows.column("centre").filter(pa.array(sizes == size)).combine_chunks()
        centres = matrix(held)
        # Centres in one order, whatever the order of the tasks.
        found[size] = Index(centres[np.lexsort(centres.T[::-1])], 0)
    return found


def listed(entries: DataFrame, sent, least: int | None) -> DataFrame:
    """size, list, place among the lists of the entry, key, entry and embedding.

    Without ``least`` each entry is in its nearest list; with it, in all that it probes. Vectors
    of a length without an index are in one list.
    """
    kind = entries.schema["entry"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part, values in rows_by_size(batch):
                index = sent.value.get(size)
                if index is None:
                    taken, lists = np.arange(len(part)), np.zeros(len(part), np.int64)
                elif least is None:
                    taken, lists = np.arange(len(part)), nearest_centres(values, index.centres)
                else:
                    taken, lists = index.lists(values, least)
                place = np.arange(len(taken)) - np.searchsorted(taken, taken)
                rows = part.take(pa.array(taken))
                yield pa.record_batch(
                    {
                        "size": rows.column("size"),
                        "list": pa.array(lists.astype(np.int32)),
                        "place": pa.array(place.astype(np.int32)),
                        "key": rows.column("key"),
                        "entry": rows.column("entry"),
                        "embedding": rows.column("embedding"),
                    }
                )

    shape = f"size int, list int, place int, key long, entry {kind}, embedding array<double>"
    return entries.select("size", "key", "entry", "embedding").mapInArrow(each, shape)


def indexed(
    entries: DataFrame, sample_size: int, most_lists: int, neighbours: int, wanted: float
) -> dict[int, Index]:
    """The index of each of the commonest lengths."""
    counts = (
        entries.groupBy("size").count().orderBy(F.col("count").desc(), "size").limit(INDEXED_LENGTHS).collect()
    )
    samples, indexes, parts = {}, {}, {}
    for row in counts:
        size = row["size"]
        samples[size] = drawn(entries, size, sample_size)
        lists = max(1, min(most_lists, len(samples[size]) // ENTRIES_PER_LIST))
        indexes[size] = Index(centres_of(samples[size], lists), 0)
        more = int(np.ceil(LISTS_PER_ROOT * np.sqrt(row["count"]) / lists))
        if more > 1 and lists == most_lists:
            parts[size] = more
    if parts:
        indexes = split(entries, indexes, parts)
    for size, index in indexes.items():
        index.probes = probes_for(samples[size], index.centres, neighbours, wanted)
    return indexes


def nearest(
    vectors: DataFrame,
    every: int,
    neighbours: int = NEIGHBOURS,
    sample_size: int = SAMPLE,
    most_lists: int = MOST_LISTS,
    wanted: float = WANTED_RECALL,
) -> DataFrame:
    """query_id, rank, vec_id and score for rows whose vec_id is divisible by ``every``."""
    context = vectors.sparkSession.sparkContext
    kind = vectors.schema["vec_id"].dataType.simpleString()
    most_ids = neighbours + 1
    valid = usable(vectors)
    entries = cut(entries_of(valid, most_ids))
    indexes = indexed(entries, sample_size, most_lists, neighbours, wanted)
    stored = cut(listed(entries, context.broadcast(indexes), None))
    for row in stored.groupBy("size", "list").count().where(F.col("size").isin(list(indexes))).collect():
        index = indexes[row["size"]]
        if index.sizes is None:
            index.sizes = np.zeros(len(index.centres), np.int64)
        index.sizes[row["list"]] = row["count"]
    sent = context.broadcast(indexes)
    turns = context.broadcast({size: rotation(size) for size in indexes})

    own = valid.where(F.col("vec_id") % every == 0).distinct()
    asking = cut(
        own.join(entries.select("key", "entry", "embedding"), "embedding").select(
            F.col("vec_id").alias("query_id"), "key", "entry", F.size("embedding").alias("size"), "embedding"
        )
    )
    queries = asking.groupBy("key", "entry", "size").agg(F.any_value("embedding").alias("embedding"))
    # A list holds every vector once, and the query itself is one of them.
    asked = cut(listed(queries, sent, most_ids).withColumn("limit", F.lit(float("inf"))))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                held, given = (batch.column(name)[i].values for name in ("vector_held", "query_held"))
                vectors_, questions = matrix(held.field("embedding")), matrix(given.field("embedding"))
                turn = turns.value.get(vectors_.shape[1])
                at, to, scores = scan(
                    questions,
                    vectors_,
                    rotation(vectors_.shape[1]) if turn is None else turn,
                    most_ids,
                    given.field("limit").to_numpy(),
                )
                order = held.field("entry").to_numpy(zero_copy_only=False)[to]
                best = first_of(at, scores, np.unique(order, return_inverse=True)[1], most_ids)
                yield pa.record_batch(
                    {
                        "query": given.field("key").take(pa.array(at[best])),
                        "asked_by": given.field("entry").take(pa.array(at[best])),
                        "key": held.field("key").take(pa.array(to[best])),
                        "entry": held.field("entry").take(pa.array(to[best])),
                        "score": pa.array(scores[best]),
                    }
                )

    def met(some: DataFrame) -> DataFrame:
        pairs = vector_blocks.join(blocked(some, QUERIES_PER_BLOCK, "query"), ["size", "list"])
        return pairs.select("vector_held", "query_held").mapInArrow(
            compared, f"query long, asked_by {kind}, key long, entry {kind}, score double"
        )

    vector_blocks = blocked(stored.withColumn("limit", F.lit(None).cast("double")), VECTORS_PER_BLOCK, "vector")
    near = cut(met(asked.where("place = 0")))
    best = Window.partitionBy("query", "asked_by").orderBy("score", "entry")
    limits = (
        near.withColumn("_place", F.row_number().over(best))
        .where(F.col("_place") == most_ids)
        .select(F.col("query").alias("key"), F.col("asked_by").alias("entry"), F.col("score").alias("known"))
    )
    others = asked.where("place > 0").join(limits, ["key", "entry"], "left")
    far = met(others.withColumn("limit", F.least("limit", "known")).drop("known"))
    top = near.unionByName(far).withColumn("_place", F.row_number().over(best)).where(F.col("_place") <= most_ids)
    found = (
        top.join(entries.select("key", "entry", "ids"), ["key", "entry"])
        .select("query", "asked_by", "score", F.explode("ids").alias("vec_id"))
        .groupBy("query", "asked_by")
        .agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    )
    found = small_enough(cut(found))
    rest = F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))
    same = (asking["key"] == found["query"]) & (asking["entry"] == found["asked_by"])
    return (
        asking.join(found, same)
        .select("query_id", F.posexplode(F.slice(rest, 1, neighbours)).alias("_at", "_one"))
        .select(
            "query_id",
            (F.col("_at") + 1).cast("int").alias("rank"),
            F.col("_one.vec_id").alias("vec_id"),
            F.col("_one.score").alias("score"),
        )
    )


def blocked(rows: DataFrame, most: int, name: str) -> DataFrame:
    """The rows of each list, in blocks of about ``most``."""
    parts = rows.groupBy("size", "list").agg(F.ceil(F.count("*") / most).alias("_parts"))
    return (
        rows.join(parts, ["size", "list"])
        .groupBy("size", "list", F.pmod("key", F.col("_parts")).alias("_part"))
        .agg(F.collect_list(F.struct("key", "entry", "embedding", "limit")).alias(f"{name}_held"))
        .drop("_part")
    )
