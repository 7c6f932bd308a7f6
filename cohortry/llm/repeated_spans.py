"""Repeated word spans, found on a De Bruijn graph and cut from later documents.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Each run of ``span`` words of one
document is an edge of the graph. An edge that also starts in a document with a
smaller doc_id has a source: its place in the smallest such document. The words
of every edge with a source are removed; edges are judged on the input.

Equal edges hold the same smallest gram of ``gram`` words; neighbouring edges with the same
gram are one row. First only (gram, doc_id, number of the row) are shuffled, to find the
grams that several documents hold. What comes back is one bit per row and document. Then
the rows so marked are made again with the hashes of their edges and shuffled by gram, and
each edge finds its source. Grams that a sample shows in a large share of the documents
would fill one task each; they are taken as marked, and their edges are salted and aggregated
before the shuffle. The sample, bounded as a share, decides on the way only.

Edges that follow each other in the document and in its source form a path
without branches. Paths are compacted piece by piece, and each is verified: the
source document is read at the source coordinates, and a hash of every edge there, made of
other word hashes, is joined to the document and compared with the edge itself.

A null or empty text has no words. A row without a doc_id is neither cut nor a
source. Rows that share a doc_id count as one document for the comparison, and
each is cut by its own text. An empty table gives an empty result. Only doc_id
and text are read, so columns of other names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm import grams
from cohortry.llm.common import cut, small_enough

SPAN = 13
GRAM = 5
# Edges of one row; their places in it fit the bits of an integer.
MOST_IN_ROW = 31
# Source places asked for together.
REQUESTS_TOGETHER = 500

# One document in so many is looked at for frequent grams.
LOOKED_AT = 64
FREQUENT_SHARE = 1 / 1000
FREQUENT_AT_LEAST = 32

# Parts that the edges of a frequent gram are dealt to.
SALTS = 256

EDGE_SEED, CHECK_SEED = 1, 2


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    best, reach = values, 1
    while 2 * reach <= width:
        best = np.minimum(best[: len(best) - reach], best[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(best[: len(best) - rest], best[rest:]) if rest else best


def edges_of(block: grams.Block, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """text index, place in the text, smallest gram and 64-bit hash of each edge."""
    count = len(block.hashes) - span + 1
    if count <= 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    owners = np.repeat(np.arange(len(block)), np.diff(block.starts))
    whole = np.flatnonzero(owners[:count] == owners[span - 1 :])
    smallest = sliding_minimum(grams.runs(block.hashes, gram), span - gram + 1)[whole]
    hashes = grams.runs(block.hashes, span, EDGE_SEED)[whole]
    owner = owners[whole]
    return owner, whole - block.starts[owner], smallest.view(np.int64), hashes.view(np.int64)


def _low_half(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)


def rows_of(owner: np.ndarray, place: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Where a new row of neighbouring edges with one gram begins."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1]) | (place[1:] != place[:-1] + 1)
    first = np.flatnonzero(new)
    since = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    return np.flatnonzero(since % MOST_IN_ROW == 0)


def known_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where("doc_id is not null")


def frequent_grams(docs: DataFrame, span: int, gram: int) -> np.ndarray:
    """Grams that many of the documents looked at hold.

    A document holds a bounded number of grams per word, so at most the mean
    number of them divided by the share can be frequent.
    """

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in grams.blocks(batch.column(0), grams.SPACED):
                owner, _, smallest, _ = edges_of(block, span, gram)
                pairs = np.unique(np.stack([owner, smallest]), axis=1)
                yield pa.record_batch({"gram": pa.array(pairs[1])})

    looked_at = known_documents(docs).where(F.pmod(F.xxhash64("doc_id"), F.lit(LOOKED_AT)) == 0)
    enough = max(FREQUENT_AT_LEAST, int(looked_at.count() * FREQUENT_SHARE))
    rows = (
        looked_at.select("text").mapInArrow(held, "gram long").groupBy("gram").count().where(F.col("count") >= enough)
    )
    return np.sort(rows.select("gram").toPandas()["gram"].to_numpy(np.int64))


@dataclass
class Rows:
    """Rows of neighbouring edges with one gram, in the texts of a block."""

    owner: np.ndarray
    gram: np.ndarray
    place: np.ndarray
    hashes: np.ndarray  # of all edges,
    begins: np.ndarray  # and where those of each row begin.

    @classmethod
    def of(cls, block: grams.Block, span: int, gram: int) -> Rows:
        owner, place, smallest, hashes = edges_of(block, span, gram)
        begins = rows_of(owner, place, smallest)
        return cls(owner[begins], smallest[begins], place[begins], hashes, np.append(begins, len(owner)))

    @property
    def numbers(self) -> np.ndarray:
        """The number of each row within its text."""
        first = np.searchsorted(self.owner, self.owner)
        return np.arange(len(self.owner)) - first

    def listed(self, taken: np.ndarray, block: grams.Block, doc_ids: pa.Array) -> pa.RecordBatch:
        """The rows ``taken``, with their edges."""
        sizes = np.diff(self.begins)[taken]
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        each = np.repeat(self.begins[taken] - ends[:-1], sizes) + np.arange(ends[-1])
        return pa.record_batch(
            {
                "gram": pa.array(self.gram[taken]),
                "doc_id": doc_ids.take(pa.array(self.owner[taken] + block.first)),
                "place": pa.array(self.place[taken].astype(np.int32)),
                "edges": pa.ListArray.from_arrays(pa.array(ends), pa.array(self.hashes[each])),
            }
        )


def shared_rows(docs: DataFrame, frequent, span: int, gram: int) -> DataFrame:
    """_id and the bits of the rows whose gram another document holds too.

    Grams known to be frequent are left out. Rows of several texts of one doc_id
    share their bits, which marks too many rows, never too few.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in grams.blocks(batch.column(1), grams.SPACED):
                rows = Rows.of(block, span, gram)
                taken = np.flatnonzero(~np.isin(rows.gram, frequent.value))
                yield pa.record_batch(
                    {
                        "gram": pa.array(rows.gram[taken]),
                        "doc_id": batch.column(0).take(pa.array(rows.owner[taken] + block.first)),
                        "row": pa.array(rows.numbers[taken].astype(np.int32)),
                    }
                )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for numbers in batch.column(1):
                some = numbers.values.to_numpy()
                marks = np.zeros(some.max() + 1, bool)
                marks[some] = True
                bits.append(np.packbits(marks, bitorder="little").tobytes())
            yield pa.record_batch({"_id": batch.column(0), "bits": pa.array(bits, pa.binary())})

    within = Window.partitionBy("gram")
    shared = (
        known_documents(docs)
        .mapInArrow(held, f"gram long, doc_id {kind}, row int")
        .withColumn("_first", F.min("doc_id").over(within))
        .withColumn("_last", F.max("doc_id").over(within))
        .where("_first < _last")
    )
    numbers = shared.groupBy("doc_id").agg(F.collect_set("row").alias("rows"))
    return cut(numbers.mapInArrow(packed, f"_id {kind}, bits binary"))


def edge_rows(marked: DataFrame, frequent, span: int, gram: int, wanted: bool) -> DataFrame:
    """gram, doc_id, place and the edges from there on, of frequent grams or of the rows with a bit."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in grams.blocks(batch.column(1), grams.SPACED):
                rows = Rows.of(block, span, gram)
                common = np.isin(rows.gram, frequent.value)
                if wanted:
                    taken = common
                else:
                    taken = ~common & held_bits(rows, batch.column(2).slice(block.first, len(block)))
                taken = np.flatnonzero(taken)
                if len(taken):
                    yield rows.listed(taken, block, batch.column(0))

    kind = marked.schema["doc_id"].dataType.simpleString()
    return marked.mapInArrow(
        listed, f"gram long, doc_id {kind}, place int, edges array<long>"
    )


def held_bits(rows: Rows, bits: pa.Array) -> np.ndarray:
    """Which rows have their bit set; a text without bits has none."""
    each = [b.as_py() or b"" for b in bits]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in each])]).astype(np.int64)
    data = np.frombuffer(b"".join(each) + b"\0", np.uint8)
    at = starts[rows.owner] + (rows.numbers >> 3)
    fits = at < starts[rows.owner + 1]
    return fits & ((data[np.where(fits, at, 0)] >> (rows.numbers & 7)) & 1).astype(bool)


def opened(rows: DataFrame) -> DataFrame:
    """One row per edge; ``at`` is its number within its row."""
    return rows.select("gram", "doc_id", "place", F.posexplode("edges").alias("at", "edge"))


def pieces(with_source: DataFrame) -> DataFrame:
    """Edges of one row whose sources follow each other, as the bits of ``held``."""
    return (
        with_source.where(F.col("source.doc_id") < F.col("doc_id"))
        .groupBy(
            "gram",
            "doc_id",
            "place",
            F.col("source.doc_id").alias("source"),
            (F.col("source.spot") - F.col("place") - F.col("at")).alias("shift"),
        )
        .agg(F.bit_or(F.expr("shiftleft(1, at)")).alias("held"))
        .select("doc_id", "place", "source", "shift", "held")
    )


def sourced_pieces(docs: DataFrame, span: int, gram: int) -> DataFrame:
    spot = (F.col("place") + F.col("at")).alias("spot")
    sent = docs.sparkSession.sparkContext.broadcast
    frequent = frequent_grams(docs, span, gram)
    marked = sent(frequent)
    texts = known_documents(docs)
    bits = small_enough(shared_rows(docs, marked, span, gram))
    with_bits = texts.join(bits, texts["doc_id"] == bits["_id"]).select("doc_id", "text", "bits")
    # Shuffled by gram while several edges still are one row; what follows needs no other shuffle.
    shared = edge_rows(with_bits, marked, span, gram, wanted=False).repartition("gram")
    # Edges with one hash share their gram, so this needs no second shuffle.
    same = Window.partitionBy("gram", "edge")
    found = pieces(opened(shared).withColumn("source", F.min(F.struct("doc_id", spot)).over(same)))
    if len(frequent):
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
        often = cut(opened(edge_rows(texts, marked, span, gram, wanted=True)).select("*", salt))
        # The first place per salt, then of all salts, of which an edge has few; it
        # meets the edges of its salt again, so no task holds all of one edge.
        first = often.groupBy("gram", "edge", "salt").agg(F.min(F.struct("doc_id", spot)).alias("source"))
        first = first.withColumn("source", F.min("source").over(same))
        each = often.unionByName(first, allowMissingColumns=True)
        salted = Window.partitionBy("gram", "edge", "salt")
        sourced = each.withColumn("source", F.min("source").over(salted)).where("doc_id is not null")
        found = found.unionByName(pieces(sourced))
    return found


def paths(found: DataFrame) -> DataFrame:
    """doc_id, start and count of the edges of each path, and where its source starts.

    The pieces of a document meet, and those that follow each other both there
    and in the source become one path.
    """
    bits = F.filter(
        F.sequence(F.lit(0), F.lit(MOST_IN_ROW - 1)),
        lambda bit: F.expr("held").bitwiseAND(F.call_function("shiftleft", F.lit(1), bit)) != 0,
    )
    line = Window.partitionBy("doc_id", "source", "shift").orderBy("spot")
    return (
        found.repartition("doc_id")
        .select("doc_id", "source", "shift", "place", F.explode(bits).alias("bit"))
        .select("doc_id", "source", "shift", (F.col("place") + F.col("bit")).alias("spot"))
        .withColumn("_island", F.col("spot") - F.row_number().over(line))
        .groupBy("doc_id", "source", "shift", "_island")
        .agg(F.min("spot").alias("start"), F.count("*").cast("int").alias("edges"))
        .select("doc_id", "start", "edges", "source", (F.col("start") + F.col("shift")).alias("source_start"))
    )


def check_hashes(block: grams.Block, i: int, span: int) -> np.ndarray:
    """A hash of each edge of text i; the block has other word hashes than the graph."""
    return _low_half(grams.runs(block.hashes[block.words(i)], span, CHECK_SEED))


def verified_paths(docs: DataFrame, found: DataFrame, span: int) -> DataFrame:
    """Per document its paths: start, and the check hashes read at the source."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Only sources with many requests need parts. They are few, so the requests are dealt out
    # before any shuffle by source; where they are not few, Spark splits the join of a hot one.
    parts = found.groupBy("source").agg(F.ceil(F.count("*") / REQUESTS_TOGETHER).alias("_parts"))
    many = small_enough(cut(parts.where("_parts > 1")))
    part = F.pmod(F.xxhash64("doc_id", "start"), F.coalesce("_parts", F.lit(1))).alias("_part")
    asked = (
        found.join(many, "source", "left")
        .groupBy("source", part)
        .agg(F.collect_list(F.struct("doc_id", "start", "edges", "source_start")).alias("asked"))
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in grams.blocks(batch.column(0), grams.SPACED, seed=CHECK_SEED):
                part = batch.slice(block.first, len(block))
                for i in range(len(block)):
                    hashes = check_hashes(block, i, span)
                    asked = part.column(1)[i].values
                    begins = asked.field("source_start").to_numpy()
                    counts = asked.field("edges").to_numpy()
                    # A place beyond the end belongs to another text of this doc_id.
                    fit = np.flatnonzero(begins + counts <= len(hashes))
                    if len(fit):
                        ends = np.concatenate([[0], np.cumsum(counts[fit])]).astype(np.int32)
                        each = np.repeat(begins[fit] - ends[:-1], counts[fit]) + np.arange(ends[-1])
                        yield pa.record_batch(
                            {
                                "doc_id": asked.field("doc_id").take(pa.array(fit)),
                                "start": pa.array(asked.field("start").to_numpy()[fit].astype(np.int32)),
                                "checks": pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[each])),
                            }
                        )

    sources = known_documents(docs)
    return (
        sources.join(asked, sources["doc_id"] == asked["source"])
        .select("text", "asked")
        .mapInArrow(read, f"doc_id {kind}, start int, checks array<int>")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "checks")).alias("paths"))
    )


def removed_words(block: grams.Block, i: int, found: pa.StructArray | None, span: int) -> np.ndarray:
    """Which words of text i lie on an edge whose check hash equals its source's."""
    words = block.words(i)
    covered = np.zeros(words.stop - words.start + 1, np.int64)
    if found is not None and len(found):
        hashes = check_hashes(block, i, span)
        checks = found.field("checks")
        offsets = checks.offsets.to_numpy().astype(np.int64)
        counts = np.diff(offsets)
        values = checks.values.to_numpy()[offsets[0] : offsets[-1]]
        spots = np.repeat(found.field("start").to_numpy() - (offsets[:-1] - offsets[0]), counts)
        spots = spots + np.arange(len(values))
        right = spots < len(hashes)
        right[right] = hashes[spots[right]] == values[right]
        np.add.at(covered, spots[right], 1)
        np.add.at(covered, spots[right] + span, -1)
    return np.cumsum(covered[:-1]) > 0


def cut_documents(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by one space (null without text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = cut(paths(sourced_pieces(docs, span, gram)))
    each = verified_paths(docs, found, span)
    # The same frame as at the sources, so the texts are shuffled once for both joins.
    texts = known_documents(docs)
    joined = texts.join(each.withColumnRenamed("doc_id", "_id"), texts["doc_id"] == F.col("_id"), "left")
    joined = joined.select("doc_id", "text", "paths").unionByName(
        docs.select("doc_id", "text").where("doc_id is null"), allowMissingColumns=True
    )

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in grams.blocks(batch.column(1), grams.SPACED, seed=CHECK_SEED):
                part = batch.slice(block.first, len(block))
                words, removed, texts = [], [], []
                for i in range(len(block)):
                    at = block.words(i)
                    gone = removed_words(block, i, part.column(2)[i].values, span)
                    stay = np.flatnonzero(~gone) + at.start
                    data = block.data
                    texts.append(
                        b" ".join(
                            data[b:e].tobytes()
                            for b, e in zip(block.begins[stay], block.ends[stay], strict=True)
                        )
                    )
                    words.append(len(gone))
                    removed.append(int(gone.sum()))
                yield pa.record_batch(
                    {
                        "doc_id": part.column(0),
                        "n_words": pa.array(words, pa.int64()),
                        "n_removed": pa.array(removed, pa.int64()),
                        "kept": pa.array(texts, pa.binary()).cast(pa.string()),
                    }
                )

    return joined.mapInArrow(
        kept, f"doc_id {kind}, n_words long, n_removed long, kept string"
    )


def digest(documents: DataFrame) -> DataFrame:
    """The kept text of each document as its SHA-256."""
    return documents.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
