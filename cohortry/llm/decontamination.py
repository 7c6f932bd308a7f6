"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower
case; a null text has none. A window is ``span`` consecutive words of a benchmark
item; an item with fewer words, but at least one, is one window by itself, and
an item without words has none.

Every run of ``span`` words holds ``span - gram + 1`` grams of ``gram`` words.
Winnowing keeps the smallest gram hash of every such run, so a document that
shares a run with an item shares that smallest hash, wherever the run lies: no
shared run of ``span`` words is missed. Items shorter than ``span`` are
fingerprinted by the hash of all their words, and documents are for each such
length that occurs.

Fingerprints of documents and benchmark are joined. Each hit is then extended
to the windows whose smallest hash it is, and these are compared word for word.

Rows that repeat a doc_id with the same text repeat its result; with different
texts each row is judged by its own. A benchmark row without an item_id counts,
with an empty string for its id. Empty tables are allowed on either side. Only doc_id, text and
item_id are read, so columns of other names do no harm.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import apart, ascii_lower, cut, small_enough, text_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN = 13
GRAM = 5
# A document is contaminated if at least one word in so many is hit.
ONE_WORD_IN = 20



def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once even if lambdas use it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def over_starts(items: Column, length: int, body: Callable[[Column], Column]) -> Column:
    """``body`` for each 1-based start of ``length`` consecutive items."""
    starts = F.size(items) - (length - 1)
    return F.when(
        starts > 0, F.transform(F.sequence(F.lit(1), F.greatest(starts, F.lit(1))), body)
    ).otherwise(F.array().cast("array<bigint>"))


def winnowed(words: Column, span: int, gram: int) -> Column:
    """The smallest gram hash of each run of ``span`` words."""

    def smallest(grams: Column) -> Column:
        width = span - gram + 1
        return over_starts(grams, width, lambda i: F.array_min(F.slice(grams, i, width)))

    def of_hashes(hashes: Column) -> Column:
        return bound(
            over_starts(hashes, gram, lambda i: F.xxhash64(F.slice(hashes, i, gram))), smallest
        )

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def fingerprints(words: Column, length: int, span: int, gram: int) -> Column:
    """A number for each run of ``length`` words, from its first word on."""
    if length == span:
        return winnowed(words, span, gram)
    return over_starts(words, length, lambda i: F.xxhash64(F.lit(length), F.slice(words, i, length)))


def benchmark_windows(benchmark: DataFrame, span: int, gram: int) -> DataFrame:
    """length, window, fingerprint, and the set of items that hold the window.

    A set is named by the smallest window it holds, and has its items under ``items`` there
    only, so items that share many windows are not listed with each of them.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
        words_of(F.col("text")).alias("words"),
    ).where(F.size("words") > 0)
    cases = F.lit(None).cast("array<bigint>")
    for length in range(1, span + 1):
        cases = F.when(
            F.col("length") == length, fingerprints(F.col("words"), length, span, gram)
        ).otherwise(cases)
    marked = items.withColumn("length", F.least(F.size("words"), F.lit(span))).withColumn("marks", cases)
    windows = marked.select(
        "item", "length", "words", F.posexplode("marks").alias("start", "mark")
    ).select(
        "item",
        "length",
        "mark",
        F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ").alias("window"),
    )
    held = windows.groupBy("length", "window", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    sets = (
        held.groupBy("items")
        .agg(F.min(F.struct("window", "length")).alias("set"), F.collect_list(F.struct("length", "window", "mark")).alias("all"))
        .select("items", "set", F.explode("all").alias("each"))
    )
    named = (F.col("each.window") == F.col("set.window")) & (F.col("each.length") == F.col("set.length"))
    return sets.select(
        "each.length", "each.window", "each.mark", F.col("set.window").alias("set"), F.when(named, F.col("items")).alias("items")
    )


def judged(
    docs: DataFrame,
    benchmark: DataFrame,
    span: int = SPAN,
    gram: int = GRAM,
    one_word_in: int = ONE_WORD_IN,
) -> DataFrame:
    """One row per document: word and hit counts, the items hit, the verdict."""
    windows = cut(benchmark_windows(benchmark, span, gram))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())
    marked = cut(marked_documents(docs, lengths, span, gram))
    hits = hit_documents(docs, marked, windows, lengths, span, gram)
    found = (F.col("n_hit") > 0) & (F.col("n_hit") * one_word_in >= F.col("n_words"))
    return (
        marked.join(hits.withColumnsRenamed({"doc_id": "_id", "_text": "_hit_text"}), _same(marked), "left")
        .select(
            "doc_id",
            "_text",
            F.col("n_words").cast("long").alias("n_words"),
            F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        )
        .withColumn("contaminated", found)
    )


def _same(left: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(F.col("_id")) & (left["_text"] == F.col("_hit_text"))


def marked_documents(docs: DataFrame, lengths: Sequence[int], span: int, gram: int) -> DataFrame:
    """Each document's word count and distinct fingerprints."""

    def marks(words: Column) -> Column:
        found = [fingerprints(words, length, span, gram) for length in lengths]
        every = F.concat(*found) if found else F.array().cast("array<bigint>")
        return F.struct(F.size(words).alias("n_words"), F.array_distinct(every).alias("marks"))

    return docs.select(
        "doc_id",
        text_key(F.col("text")).alias("_text"),
        bound(words_of(F.col("text")), marks).alias("_found"),
    ).select("doc_id", "_text", "_found.n_words", "_found.marks")


def hit_documents(
    docs: DataFrame,
    marked: DataFrame,
    windows: DataFrame,
    lengths: Sequence[int],
    span: int,
    gram: int,
) -> DataFrame:
    """n_hit and the sorted items of each document that holds a window."""
    known = small_enough(windows.select("mark").distinct())
    candidates = cut(
        marked.select("doc_id", "_text", F.explode("marks").alias("mark"))
        .join(known, "mark", "left_semi")
        .groupBy("doc_id", "_text")
        .agg(F.collect_set("mark").alias("_marks"))
    )
    met = candidates.withColumnsRenamed({"doc_id": "_id", "_text": "_hit_text"})
    read = docs.select("doc_id", "text", text_key(F.col("text")).alias("_text")).join(
        small_enough(met), _candidate(docs)
    )

    def starts(words: Column) -> Column:
        found = [_extended(words, length, span, gram) for length in lengths]
        empty = F.array().cast("array<struct<start:int,length:int,window:string>>")
        return F.concat(empty, *found)

    spans = (
        read.dropDuplicates(["doc_id", "_text"])
        .select("doc_id", "_text", F.explode(bound(words_of(F.col("text")), starts)).alias("_span"))
        .select("doc_id", "_text", "_span.start", "_span.window", "_span.length")
        .join(small_enough(windows.select("window", "set")), "window")
    )
    spans = cut(spans)
    before = (
        Window.partitionBy("doc_id", "_text")
        .orderBy("start", "length")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    end = F.col("start") + F.col("length")
    covered = F.greatest(
        F.lit(0), end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(before), F.lit(0)))
    )
    counts = spans.withColumn("_covered", covered).groupBy("doc_id", "_text").agg(F.sum("_covered").alias("n_hit"))
    sets = small_enough(windows.where("items is not null").select("set", "items"))
    items = (
        spans.select("doc_id", "_text", "set")
        .distinct()
        .join(sets, "set")
        .select("doc_id", "_text", F.explode("items").alias("item"))
        .groupBy("doc_id", "_text")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    met, its = apart(items, counts)
    same = counts["doc_id"].eqNullSafe(its["doc_id"]) & (counts["_text"] == its["_text"])
    return counts.join(met, same).select("doc_id", "_text", "n_hit", its["items"].alias("items"))


def _candidate(docs: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hit_text"))


def _extended(words: Column, length: int, span: int, gram: int) -> Column:
    """The windows of one length whose fingerprint is among the document's hits."""

    def of_marks(marks: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(marks)),
            lambda i: F.array_contains(F.col("_marks"), F.get(marks, i)),
        )
        return F.transform(
            places,
            lambda i: F.struct(
                i.cast("int").alias("start"),
                F.lit(length).alias("length"),
                F.array_join(F.slice(words, i + 1, length), " ").alias("window"),
            ),
        )

    return bound(fingerprints(words, length, span, gram), of_marks)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents, without those that are contaminated."""
    found = (
        judged(docs, benchmark, **settings)
        .where("contaminated")
        .select(F.col("doc_id").alias("_id"), F.col("_text").alias("_hit_text"))
        .distinct()
    )
    rejected, its = apart(small_enough(cut(found)), docs)
    same = docs["doc_id"].eqNullSafe(its["_id"]) & (text_key(docs["text"]) == its["_hit_text"])
    return docs.join(rejected, same, "left_anti")
