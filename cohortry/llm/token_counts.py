"""Token counts of whole texts, with huge texts encoded as overlapping chunks.

A text of up to ``huge`` code points is encoded as it is. A longer one becomes chunks of
``step`` code points and an overlap with the next, which Spark spreads over the
tasks; copies of a text share their chunks. Each chunk reports the token ends
in its two overlaps that are stable (see ``vocabularies``), with the number of
tokens before each. Neighbouring chunks are spliced at the first place where both
have a token end: left of it the left chunk's tokens are those of the
whole text, right of it the right chunk's. Where two chunks have no such place
in common, their text is encoded again with overlaps and steps four times as wide, until one
chunk holds it all. So the count always is that of the whole text.

A null or empty text has 0 bytes and 0 tokens. Every row gives one row, repeated
rows too, whatever its doc_id. An empty table gives an empty result. Only the
key columns and text are read, so columns of other names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import apart, cut
from cohortry.llm.vocabularies import ByteLevel, Pieces, codes_of

HUGE = 1 << 15
STEP = 1 << 14
OVERLAP = 256
WIDER = 4
LIMIT = 4096

# Stable places that a chunk reports per overlap. Both chunks report the first ones.
REPORTED = 16
# Code points given to the tokenizer together.
TOGETHER = 1 << 18


def groups_of(texts: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, list[str]]]:
    """Row of the first text, and texts of about ``most`` code points together."""
    first, held, size = 0, [], 0
    for row in range(len(texts)):
        text = texts[row].as_py() or ""
        if held and size + len(text) > most:
            yield first, held
            first, held, size = row, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield first, held


def chunks(texts: DataFrame, step: int, overlap: int) -> DataFrame:
    """key, chunk, the number of chunks, where the chunk begins, and its text."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                text = batch.column(1)[row].as_py()
                count = max(1, -(-(len(text) - overlap) // step))
                # A few chunks at a time, so that a text is not held twice.
                for some in range(0, count, 64):
                    numbers = range(some, min(some + 64, count))
                    parts = [
                        text[i * step : (i + 1) * step + overlap if i + 1 < count else len(text)] for i in numbers
                    ]
                    yield pa.record_batch(
                        {
                            "key": batch.column(0).take(pa.array([row] * len(parts))),
                            "chunk": pa.array(list(numbers), pa.int32()),
                            "chunks": pa.array([count] * len(parts), pa.int32()),
                            "text": pa.array(parts, pa.string()),
                        }
                    )

    cut_texts = texts.select("key", "text").mapInArrow(cut_up, "key string, chunk int, chunks int, text string")
    # Spreads the chunks, and leaves one of those that copies have in common.
    return cut_texts.groupBy("key", "chunk", "chunks").agg(F.any_value("text").alias("text"))


def stable_ends(
    vocabulary: Pieces | ByteLevel, text: str, ids: list[int], within: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Stable token ends within a stretch of a text, and the tokens before each."""
    low, high = max(within[0], 1), min(within[1], len(text))
    if low >= high:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids = np.asarray(ids, np.int64)
    places = np.cumsum(vocabulary.characters[ids]) - vocabulary.prefix
    # The end of token k, where token k + 1 begins with a character.
    token = np.flatnonzero((places[:-1] >= low) & (places[:-1] < high) & ~vocabulary.inside[ids[1:]])
    fixed = vocabulary.stable(codes_of(text[low - 1 : high]))
    token = token[fixed[places[token] - low]]
    return places[token], token + 1


def reports(spread: DataFrame, sent, step: int, overlap: int) -> DataFrame:
    """key, joint, and what the chunk before and the chunk after it say there.

    The last chunk of a text says its number of tokens at a joint that no other has.
    """

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = sent.value
        for batch in batches:
            for first, texts in groups_of(batch.column("text")):
                rows, joints, after, places, tokens, totals = [], [], [], [], [], []

                def say(row: int, joint: int, later: bool, ends: tuple, begin: int, total: int | None) -> None:
                    rows.append(row)
                    joints.append(joint)
                    after.append(later)
                    places.append((ends[0][:REPORTED] + begin).tolist())
                    tokens.append(ends[1][:REPORTED].tolist())
                    totals.append(total)

                for i, (text, ids) in enumerate(zip(texts, vocabulary.encode(texts), strict=True)):
                    row = first + i
                    chunk, count = batch.column("chunk")[row].as_py(), batch.column("chunks")[row].as_py()
                    begin = chunk * step
                    if chunk:
                        say(row, chunk - 1, True, stable_ends(vocabulary, text, ids, (1, overlap)), begin, None)
                    if chunk + 1 < count:
                        within = (step + 1, step + overlap)
                        say(row, chunk, False, stable_ends(vocabulary, text, ids, within), begin, None)
                    else:
                        nothing = np.zeros(0, np.int64)
                        say(row, chunk, False, (nothing, nothing), begin, len(ids))
                yield pa.record_batch(
                    {
                        "key": batch.column("key").take(pa.array(rows)),
                        "joint": pa.array(joints, pa.int32()),
                        "later": pa.array(after),
                        "places": pa.array(places, pa.list_(pa.int64())),
                        "tokens": pa.array(tokens, pa.list_(pa.int64())),
                        "total": pa.array(totals, pa.int64()),
                    }
                )

    return spread.mapInArrow(
        said, "key string, joint int, later boolean, places array<long>, tokens array<long>, total long"
    )


def spliced(said: DataFrame) -> DataFrame:
    """key, tokens (null where two neighbours have no stable token end in common)."""
    left, right = F.col("left"), F.col("right")
    joints = said.groupBy("key", "joint").agg(
        F.max("total").alias("total"),
        F.any_value(F.when(~F.col("later"), F.struct("places", "tokens")), True).alias("left"),
        F.any_value(F.when(F.col("later"), F.struct("places", "tokens")), True).alias("right"),
    )
    place = F.get(F.array_intersect(left["places"], right["places"]), F.lit(0))

    def tokens_at(side):
        return F.get(side["tokens"], (F.array_position(side["places"], place) - 1).cast("int"))

    # Tokens up to the joint count on its left, those behind it on its right.
    each = F.coalesce("total", tokens_at(left) - tokens_at(right))
    return (
        joints.select("key", each.alias("each"))
        .groupBy("key")
        .agg(F.when(F.count("*") == F.count("each"), F.sum("each")).alias("tokens"))
    )


def huge_counts(
    texts: DataFrame, sent, step: int, overlap: int
) -> DataFrame:
    """key and tokens of each of the texts (key, text)."""
    found = None
    while True:
        counts = cut(spliced(reports(chunks(texts, step, overlap), sent, step, overlap)))
        done = counts.where("tokens is not null")
        found = done if found is None else found.unionByName(done)
        failed = counts.where("tokens is null").select("key")
        if failed.isEmpty():
            return found
        texts = texts.join(failed, "key", "left_semi")
        step, overlap = step * WIDER, overlap * WIDER


def counted(
    docs: DataFrame,
    vocabulary: Pieces | ByteLevel,
    keys: list[str],
    huge: int = HUGE,
    step: int = STEP,
    overlap: int = OVERLAP,
) -> DataFrame:
    """The key columns, n_bytes and n_tokens of every row's text."""
    if not 2 <= overlap <= step:
        raise ValueError("an overlap needs two code points at least and a step that is as wide")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    text = F.coalesce("text", F.lit(""))
    # Under names of its own, whatever the keys are called.
    listed = docs.select(F.struct(*keys).alias("row"), text.alias("text"))
    n_bytes = F.octet_length("text").cast("long").alias("n_bytes")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(ids) for _, texts in groups_of(batch.column("text")) for ids in sent.value.encode(texts)]
            yield pa.record_batch(
                {
                    "row": batch.column("row"),
                    "n_bytes": batch.column("n_bytes"),
                    "n_tokens": pa.array(sizes, pa.int64()),
                }
            )

    kind = listed.schema["row"].dataType.simpleString()
    plain = (
        listed.where(F.length("text") <= huge)
        .select("row", n_bytes, "text")
        .mapInArrow(encoded, f"row {kind}, n_bytes long, n_tokens long")
    )
    key = F.sha2("text", 256).alias("key")
    long = listed.where(F.length("text") > huge)
    tokens, token = apart(huge_counts(long.select(key, "text"), sent, step, overlap), listed)
    rows = long.select("row", n_bytes, key)
    spread = rows.join(tokens, F.col("key") == token["key"]).select("row", "n_bytes", token["tokens"].alias("n_tokens"))
    return plain.unionByName(spread).select("row.*", "n_bytes", "n_tokens")
