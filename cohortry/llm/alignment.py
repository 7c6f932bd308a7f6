"""Alignment of the tokens of two tokenizers, and how often their ids are linked.

Each text is encoded by a byte-level vocabulary A, behind a space, and by a piece
model B, which puts that space itself. Byte offsets at which tokens of both end cut the
tokens into groups; tokens of a group that overlap are linked. Corpus-wide, a pair
of ids counts its links.

An identity map gives each id of A the id of B with the same bytes. A group of one
token each that the map foresees is regular: its links are counted in one vector as long as
the vocabulary, per task, and their counts come back as two such vectors. Only
groups that the map does not foresee enter the pair shuffle, added up per task before.
Texts are encoded once: ids and counts of each row are written to the shared folder,
and read again to count and to score.

The counts of irregular pairs are looked up in the tasks if all of them fit a bound in bytes,
and joined by shuffle otherwise. Both give the same rows. Texts are cut into units where a
space follows another character, which no token of either vocabulary spans, and a unit
that occurs again is not encoded again; a text without such places is one unit.

A null or empty text has no tokens, nor has one whose tokens of A or B do not give back
its bytes (a text that holds U+2581, for one). Its counts are 0 and its groups ''. Every row
gives one row, repeated rows and null doc_ids too, and repeated rows count repeatedly.
An empty table gives an empty result. Only doc_id and text are read, so columns of
other names do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored, text_key
from cohortry.llm.vocabularies import SPACE_MARK, ByteLevel, Pieces

# Code points that are cut into units together, and of the units aligned together.
PART = 1 << 17
TOGETHER = 1 << 16
# Units whose links a task keeps.
MOST_UNITS = 1 << 18
# Irregular pairs that a task adds up before it sends them on.
PAIRS_TOGETHER = 1 << 20
# A pair, its count and its mark take 17 bytes in a task.
PAIR_BYTES = 17
MOST_BROADCAST_BYTES = 64 << 20

_PAIR_BITS = 32
_CUT = re.compile(rf"(?<=[^\s{SPACE_MARK}]) (?=\S)")


def identity_map(a: ByteLevel, b: Pieces) -> np.ndarray:
    """For each id of A the id of B with the same bytes, or -1.

    Where a piece and a byte of B read the same, B writes the piece.
    """
    named = {}
    for i, held in enumerate(b.token_bytes):
        if held not in named or b.is_byte[named[held]]:
            named[held] = i
    return np.array([named.get(held, -1) if held else -1 for held in a.token_bytes], np.int64)


def parts_of(text: str, most: int = PART) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut at spaces that begin a unit."""
    begin = 0
    while len(text) - begin > most:
        cut = _CUT.search(text, begin + most)
        if not cut:
            break
        yield text[begin : cut.start()]
        begin = cut.end()
    yield text[begin:]


@dataclass
class Tokens:
    """Ids of some texts one after another, and where each token ends in all their bytes."""

    ids: np.ndarray
    ends: np.ndarray
    starts: np.ndarray  # of each text, and the end of the last

    @classmethod
    def of(cls, ids: list[list[int]], lengths: np.ndarray) -> Tokens:
        flat = np.array(list(chain.from_iterable(ids)), np.int64)
        starts = np.concatenate([[0], np.cumsum([len(each) for each in ids])]).astype(np.int64)
        return cls(flat, np.cumsum(lengths[flat]), starts)

    def kept(self, right: np.ndarray, lengths: np.ndarray) -> Tokens:
        """Those of the texts that are right."""
        sizes = np.diff(self.starts)
        ids = self.ids[np.repeat(right, sizes)]
        starts = np.concatenate([[0], np.cumsum(np.where(right, sizes, 0))]).astype(np.int64)
        return Tokens(ids, np.cumsum(lengths[ids]), starts)

    def exact(self, data: np.ndarray, bounds: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Which texts (bytes ``bounds`` of ``data``) the bytes made of their tokens equal."""
        ends = np.concatenate([[0], self.ends])[self.starts]
        right = np.diff(ends) == np.diff(bounds)
        if len(made) == len(data) and np.array_equal(ends, bounds):
            # All lengths fit, so differences can be counted in one go.
            wrong = np.concatenate([[0], np.cumsum(made != data)])
            return wrong[bounds[1:]] == wrong[bounds[:-1]]
        for i in np.flatnonzero(right):
            right[i] = np.array_equal(made[ends[i] : ends[i + 1]], data[bounds[i] : bounds[i + 1]])
        return right


@dataclass
class Links:
    """The links of texts one after another: their numbers, ids and pairs, and written groups."""

    right: np.ndarray  # Whether the tokens give back the text's bytes.
    numbers: np.ndarray  # Tokens of A, tokens of B and groups, a column per text.
    written: list[bytes]  # Each group with its mark behind it.
    regular: np.ndarray  # Ids of A whose group the identity map foresees,
    regular_starts: np.ndarray  # and where those of each text begin.
    pairs: np.ndarray  # Both ids of the other links.
    pairs_starts: np.ndarray

    @classmethod
    def none(cls) -> Links:
        empty, start = np.zeros(0, np.int64), np.zeros(1, np.int64)
        return cls(np.zeros(0, bool), np.zeros((3, 0), np.int64), [], empty, start, empty, start)

    def with_more(self, others: list[Links]) -> Links:
        every = [self, *others]

        def starts(name: str) -> np.ndarray:
            sizes = [np.diff(getattr(x, name)) for x in every]
            return np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

        return Links(
            np.concatenate([x.right for x in every]),
            np.concatenate([x.numbers for x in every], axis=1),
            [w for x in every for w in x.written],
            np.concatenate([x.regular for x in every]),
            starts("regular_starts"),
            np.concatenate([x.pairs for x in every]),
            starts("pairs_starts"),
        )


def decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of all numbers below ``most``, each with one free byte behind it."""
    texts = [f"{i} ".encode() for i in range(most)]
    starts = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), starts


def aligned(
    a: Tokens, b: Tokens, right: np.ndarray, same: np.ndarray, digits: tuple[np.ndarray, np.ndarray]
) -> Links:
    """The links of texts whose bytes are the same for A and B, where they are right."""
    texts = len(a.starts) - 1
    common = np.intersect1d(a.ends, b.ends, assume_unique=True)
    group_a, group_b = np.searchsorted(common, a.ends), np.searchsorted(common, b.ends)
    in_a, in_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
    text_a = np.repeat(np.arange(texts), np.diff(a.starts))
    last_a, last_b = np.searchsorted(a.ends, common), np.searchsorted(b.ends, common)
    text = text_a[last_a]
    numbers = np.stack([np.diff(a.starts), np.diff(b.starts), np.bincount(text, minlength=texts)])

    foreseen = (in_a == 1) & (in_b == 1) & (same[a.ids[last_a]] == b.ids[last_b])
    regular = a.ids[last_a][foreseen]

    # Each end of a token ends one overlap of a token of A with one of B.
    rest_a, rest_b = a.ends[~foreseen[group_a]], b.ends[~foreseen[group_b]]
    ends = np.union1d(rest_a, rest_b)
    at_a, at_b = np.searchsorted(a.ends, ends), np.searchsorted(b.ends, ends)
    pairs = (a.ids[at_a] << _PAIR_BITS) | b.ids[at_b]

    # Tokens in the order of the written form: those of A of a group, then those of B.
    before_a = np.concatenate([[0], np.cumsum(in_a)])
    before_b = np.concatenate([[0], np.cumsum(in_b)])
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    marks = np.full(len(order), ord(","), np.uint8)
    spot_a = np.arange(len(a.ids)) + before_b[group_a]
    spot_b = np.arange(len(b.ids)) + before_a[group_b + 1]
    order[spot_a], order[spot_b] = a.ids, b.ids
    marks[spot_a[last_a]], marks[spot_b[last_b]] = ord("|"), ord(";")
    data, starts = digits
    written, sizes = gathered(data, starts, order)
    ends = np.cumsum(sizes)
    written[ends - 1] = marks
    whole, cuts = written.tobytes(), np.concatenate([[0], ends])[a.starts + b.starts].tolist()
    each = np.arange(texts + 1)
    return Links(
        right,
        numbers,
        [whole[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)],
        regular,
        np.searchsorted(text[foreseen], each),
        pairs,
        np.searchsorted(text_a[at_a], each),
    )


def gathered(values: np.ndarray, starts: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``values`` that ``order`` names one after another, and their sizes."""
    sizes = starts[order + 1] - starts[order]
    ends = np.cumsum(sizes)
    shift = np.repeat(starts[order] - (ends - sizes), sizes)
    return values[shift + np.arange(len(shift))], sizes


def listed(owner: np.ndarray, value: np.ndarray, times: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """The distinct values of each row, and how often it holds each, as list arrays."""
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    sums = np.add.reduceat(times[order], first) if len(first) else times[:0]
    ends = pa.array(np.searchsorted(owner[first], np.arange(rows + 1)).astype(np.int32))
    kept = pa.ListArray.from_arrays(ends, pa.array(value[first]))
    return kept, pa.ListArray.from_arrays(ends, pa.array(sums))


class Aligner:
    """Both vocabularies in a task, and the links of the units it has met.

    A unit is what lies between two places of a text where a space follows another
    character. Its links are the same in every text, so they are made once, as
    long as the units held stay within a bound.
    """

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.same = identity_map(a, b)
        self.digits = decimals(max(len(a.token_bytes), len(b.token_bytes)))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = Links.none()

    def learn(self, units: list[str]) -> Links:
        """The links of new units."""
        a = Tokens.of(self.a.encode([f" {u}" for u in units]), self.a.lengths)
        # B writes the space before each unit itself.
        b = Tokens.of(self.b.encode(units), self.b.lengths)
        encoded = [f" {u}".encode() for u in units]
        data = np.frombuffer(b"".join(encoded), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(t) for t in encoded])]).astype(np.int64)
        right = a.exact(data, bounds, self.a.bytes_of(a.ids)) & b.exact(data, bounds, self.b.bytes_of(b.ids))
        if not right.all():
            a, b = a.kept(right, self.a.lengths), b.kept(right, self.b.lengths)
        return aligned(a, b, right, self.same, self.digits)

    def numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the units of all texts, and how many each text has."""
        known, found, sizes = self.known, [], np.zeros(len(texts), np.int64)
        before = len(known)
        for row in range(len(texts)):
            text = texts[row].as_py()
            for part in parts_of(text) if text else ():
                numbers = [known.setdefault(u, len(known)) for u in _CUT.split(part)]
                found.append(np.array(numbers, np.int64))
                sizes[row] += len(numbers)
        fresh, size, learned = [], 0, []
        for unit in islice(known, before, None):
            fresh.append(unit)
            size += len(unit)
            if size >= TOGETHER:
                learned.append(self.learn(fresh))
                fresh, size = [], 0
        if fresh:
            learned.append(self.learn(fresh))
        if learned:
            self.held = self.held.with_more(learned)
        return np.concatenate([np.zeros(0, np.int64), *found]), sizes

    def rows(self, texts: pa.Array) -> dict[str, pa.Array]:
        """Numbers, digest, regular ids and irregular pairs of each text."""
        if len(self.known) > MOST_UNITS:
            self.forget()
        units, sizes = self.numbered(texts)
        held, count = self.held, len(texts)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        wrong = np.concatenate([[0], np.cumsum(~held.right[units])])[starts]
        whole = (np.diff(wrong) == 0) & (sizes > 0)
        columns = {}
        for name, number in zip(("n_a", "n_b", "n_groups"), held.numbers, strict=True):
            sums = np.diff(np.concatenate([[0], np.cumsum(number[units])])[starts])
            columns[name] = pa.array(np.where(whole, sums, 0))
        written = held.written
        digests = []
        for row in range(count):
            text = b"".join([written[u] for u in units[starts[row] : starts[row + 1]].tolist()])
            # The last group has no mark behind it.
            digests.append(hashlib.sha256(text[:-1]).hexdigest() if whole[row] else "")
        columns["groups_sha256"] = pa.array(digests, pa.string())
        span = max(len(self.known), 1)
        keep = np.repeat(whole, sizes)
        met, times = np.unique(
            np.repeat(np.arange(count), sizes)[keep] * span + units[keep], return_counts=True
        )
        owner, unit = met // span, met % span
        for name in ("regular", "pairs"):
            values, lengths = gathered(getattr(held, name), getattr(held, f"{name}_starts"), unit)
            ids, sums = listed(np.repeat(owner, lengths), values, np.repeat(times, lengths), count)
            columns[name] = ids.cast(pa.list_(pa.int32())) if name == "regular" else ids
            columns[f"{name}_times"] = sums
        return columns


ROW_NUMBERS = "n_a long, n_b long, n_groups long, groups_sha256 string"
ROW_LINKS = "regular array<int>, regular_times array<long>, pairs array<long>, pairs_times array<long>"


def encoded(docs: DataFrame, a: ByteLevel, b: Pieces) -> DataFrame:
    """doc_id, a key of the text, the numbers of each row and its distinct links; written once."""
    sent = docs.sparkSession.sparkContext.broadcast((a, b))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*sent.value)
        for batch in batches:
            columns = {"doc_id": batch.column(0), "_text": batch.column(1)} | aligner.rows(batch.column(2))
            yield pa.record_batch(columns)

    schema = f"doc_id {kind}, _text long, {ROW_NUMBERS}, {ROW_LINKS}"
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_text"), "text").mapInArrow(encode, schema)
    return stored(rows)


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def pair_counts(rows: DataFrame, same: np.ndarray) -> DataFrame:
    """a, b, the links of the pair and whether no other id of A has more links with b."""
    sent = rows.sparkSession.sparkContext.broadcast(same)

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = np.zeros(len(sent.value), np.int64)
        for batch in batches:
            np.add.at(vector, _flat(batch.column(0)), _flat(batch.column(1)))
        used = np.flatnonzero(vector)
        pairs = (used << _PAIR_BITS) | sent.value[used]
        yield pa.record_batch({"pair": pa.array(pairs), "times": pa.array(vector[used])})

    def irregular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, times, size = [], [], 0

        def added_up() -> pa.RecordBatch:
            pairs, at = np.unique(np.concatenate(held), return_inverse=True)
            # Counts of links stay far below 2**53.
            sums = np.bincount(at, np.concatenate(times), len(pairs)).astype(np.int64)
            return pa.record_batch({"pair": pa.array(pairs), "times": pa.array(sums)})

        for batch in batches:
            held.append(_flat(batch.column(0)))
            times.append(_flat(batch.column(1)))
            size += len(held[-1])
            if size >= PAIRS_TOGETHER:
                yield added_up()
                held, times, size = [], [], 0
        if size:
            yield added_up()

    shape = "pair long, times long"
    counts = (
        rows.select("regular", "regular_times")
        .mapInArrow(regular, shape)
        .unionByName(rows.select("pairs", "pairs_times").mapInArrow(irregular, shape))
        .groupBy("pair")
        .agg(F.sum("times").alias("links"))
    )
    b = F.col("pair").bitwiseAND((1 << _PAIR_BITS) - 1)
    counts = counts.select(F.shiftright("pair", _PAIR_BITS).alias("a"), b.alias("b"), "pair", "links")
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("a", "b", "pair", "links", (F.col("links") == F.col("most")).alias("best"))


def scored_in_tasks(rows: DataFrame, counts: DataFrame, same: np.ndarray) -> DataFrame:
    """n_best and count_sum of each row, where the counts of all pairs fit a task."""
    table = counts.select("pair", "links", "best").toPandas().sort_values("pair")
    pairs, pair_links, pair_best = (
        table["pair"].to_numpy(np.int64),
        table["links"].to_numpy(np.int64),
        table["best"].to_numpy(bool),
    )
    expected = (np.arange(len(same)) << _PAIR_BITS) | same
    vectors = np.zeros(len(same), np.int64), np.zeros(len(same), bool)
    _, at, of = np.intersect1d(expected[same >= 0], pairs, assume_unique=True, return_indices=True)
    ids = np.flatnonzero(same >= 0)[at]
    vectors[0][ids], vectors[1][ids] = pair_links[of], pair_best[of]
    sent = rows.sparkSession.sparkContext.broadcast((*vectors, pairs, pair_links, pair_best))
    kept = ["doc_id", "_text", "n_a", "n_b", "n_groups", "groups_sha256"]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(kept).schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, best, pairs, pair_links, pair_best = sent.value
        for batch in batches:
            ids = _flat(batch.column("regular"))
            at = np.searchsorted(pairs, _flat(batch.column("pairs")))
            n_best, total = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for name, count, top in (("regular", links[ids], best[ids]), ("pairs", pair_links[at], pair_best[at])):
                times = _flat(batch.column(f"{name}_times"))
                ends = np.concatenate([[0], np.cumsum(batch.column(name).value_lengths().to_numpy())])
                for sums, each in ((n_best, times * top), (total, times * count)):
                    sums += np.diff(np.concatenate([[0], np.cumsum(each)])[ends])
            columns = {name: batch.column(name) for name in kept}
            yield pa.record_batch(columns | {"n_best": pa.array(n_best), "count_sum": pa.array(total)})

    return rows.mapInArrow(score, f"{shape}, n_best long, count_sum long")


def regular_vectors(counts: DataFrame, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links and mark of the pair that the identity map gives for each id of A."""
    expected = counts.sparkSession.createDataFrame(
        [(int(a), int(same[a])) for a in np.flatnonzero(same >= 0)], "a long, b long"
    )
    found = counts.join(F.broadcast(expected), ["a", "b"]).select("a", "links", "best").toPandas()
    links, best = np.zeros(len(same), np.int64), np.zeros(len(same), bool)
    at = found["a"].to_numpy(np.int64)
    links[at], best[at] = found["links"].to_numpy(), found["best"].to_numpy()
    return links, best


def scored_by_join(rows: DataFrame, counts: DataFrame, same: np.ndarray) -> DataFrame:
    """n_best and count_sum of each row by a join of its irregular pairs."""
    numbers = ["doc_id", "_text", "n_a", "n_b", "n_groups", "groups_sha256"]
    sent = rows.sparkSession.sparkContext.broadcast(regular_vectors(counts, same))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def regular(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, best = sent.value
        for batch in batches:
            ids, times = _flat(batch.column("regular")), _flat(batch.column("regular_times"))
            ends = np.concatenate([[0], np.cumsum(batch.column("regular").value_lengths().to_numpy())])
            sums = [
                np.diff(np.concatenate([[0], np.cumsum(each)])[ends]) for each in (times * best[ids], times * links[ids])
            ]
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"),
                    "_text": batch.column("_text"),
                    "n_best": pa.array(sums[0]),
                    "count_sum": pa.array(sums[1]),
                }
            )

    # Repeated rows are the same, and need their sums once.
    distinct = rows.dropDuplicates(["doc_id", "_text"])
    plain = distinct.select("doc_id", "_text", "regular", "regular_times").mapInArrow(
        regular, f"doc_id {kind}, _text long, n_best long, count_sum long"
    )
    each = F.explode(F.arrays_zip("pairs", "pairs_times")).alias("_each")
    opened = distinct.select("doc_id", "_text", each).select(
        "doc_id", "_text", F.col("_each.pairs").alias("pair"), F.col("_each.pairs_times").alias("times")
    )
    met = opened.join(counts.select("pair", "links", "best"), "pair").select(
        "doc_id",
        "_text",
        F.when(F.col("best"), F.col("times")).otherwise(0).cast("long").alias("n_best"),
        (F.col("times") * F.col("links")).alias("count_sum"),
    )
    sums = (
        plain.unionByName(met)
        .groupBy(F.col("doc_id").alias("_id"), F.col("_text").alias("_key"))
        .agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    same_row = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key"))
    return rows.select(numbers).join(sums, same_row).select(*numbers, "n_best", "count_sum")


def links(
    docs: DataFrame, a: ByteLevel, b: Pieces, most_bytes: int = MOST_BROADCAST_BYTES
) -> tuple[DataFrame, DataFrame]:
    """The rows with their numbers, and the corpus-wide counts of the pairs of ids."""
    same = identity_map(a, b)
    rows = encoded(docs, a, b)
    counts = stored(pair_counts(rows, same))
    if counts.count() * PAIR_BYTES <= most_bytes:
        scored = scored_in_tasks(rows, counts, same)
    else:
        scored = scored_by_join(rows, counts, same)
    n_links = (F.col("n_a") + F.col("n_b") - F.col("n_groups")).alias("n_links")
    scored = scored.select(
        "doc_id", "n_a", "n_b", "n_groups", n_links, "n_best", "count_sum", "groups_sha256"
    )
    return scored, counts.select("a", "b", "links", "best")
