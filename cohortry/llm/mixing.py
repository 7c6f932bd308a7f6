"""Mixing sources to target weights by whole-document repetition.

The size of a document is its number of words ``[^\\x20\\x09-\\x0D]+``; a null or
empty text has size 0. Each source weighs ``weights[rank % len(weights)]``, its
rank being its place among the sources by code point, a null source last. The
sources share the size of the whole corpus by weight; a target stops at
``most_repeats`` times its source's size, and the excess is shared again by
weight among the others until none is above.

A source repeats its documents at the rate target / size: every document
floor(rate) times, plus one more copy with probability equal to the fraction,
decided by a hash of seed, doc_id and text. Reruns and any partitioning decide
alike; rows that repeat doc_id and text are decided alike. A source without words
has target 0 and takes nothing. An empty table gives an empty result. Only
doc_id, text and source are read for the decision, so columns of other names do
no harm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import apart, cut, small_enough

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = 11


WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(docs: DataFrame, seed: int) -> Column:
    """A uniform number in [0, 1) from the seed, doc_id and text."""
    named = F.concat_ws(
        ":",
        F.lit(str(seed)),
        F.coalesce(docs["doc_id"].cast("string"), F.lit("")),
        F.md5(F.coalesce(docs["text"], F.lit(""))),
    )
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most_repeats: int = MOST_REPEATS
) -> DataFrame:
    """Target and rate of each source; ``sizes`` is (source, size), one row per source.

    With the sources in order of cap / weight, the capped ones come first. For
    each source, ``level`` is the size that one unit of weight would get if
    exactly the sources before it were capped. It rises along the capped
    sources and falls after the first one that is not, so the highest level is
    the one at which everything is shared.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    weighted = sizes.withColumn(
        "_weight",
        F.element_at(
            F.array(*[F.lit(int(w)) for w in weights]),
            ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"),
        ),
    ).withColumn("_cap", F.col("size") * most_repeats)
    before = Window.orderBy(
        F.col("_cap") / F.col("_weight"), F.col("source").isNull(), F.col("source")
    ).rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))
    ) / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    levelled = weighted.withColumn("_level", level)
    target = F.when(
        F.col("_cap") > F.col("_weight") * F.col("_final"), F.col("_weight") * F.col("_final")
    ).otherwise(F.col("_cap").cast("double"))
    return (
        levelled.withColumn("_final", F.max("_level").over(everything))
        .select("source", F.col("size").alias("source_size"), target.alias("target"))
        .withColumn(
            "_rate",
            F.when(
                F.col("source_size") > 0,
                F.least(F.col("target") / F.col("source_size"), F.lit(float(most_repeats))),
            ).otherwise(F.lit(0.0)),
        )
    )


def copies(rate: Column, uniform: Column) -> Column:
    return (F.floor(rate) + (uniform < rate - F.floor(rate)).cast("int")).cast("int")


def planned(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target and the words taken, per document."""
    sized = cut(
        docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), draw(docs, seed).alias("_draw"))
    )
    rates = rates_of(sized.groupBy("source").agg(F.sum("size").alias("size")), weights, most_repeats)
    return sized.join(rates, sized["source"].eqNullSafe(rates["_source"])).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies(F.col("_rate"), F.col("_draw"))).alias("taken"),
    )


def rates_of(sizes: DataFrame, weights: Sequence[int], most_repeats: int) -> DataFrame:
    found = cut(targets(sizes, weights, most_repeats)).withColumnRenamed("source", "_source")
    return small_enough(found)


def mixed(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """The documents themselves, each as often as the mix takes it."""
    sizes = docs.select("source", size_of(F.col("text")).alias("size"))
    rates = rates_of(sizes.groupBy("source").agg(F.sum("size").alias("size")), weights, most_repeats)
    sides, its = apart(rates, docs)
    times = F.array_repeat(F.lit(0), copies(its["_rate"], draw(docs, seed)))
    joined = docs.join(sides, docs["source"].eqNullSafe(its["_source"]))
    row = F.struct(*[docs[c] for c in docs.columns])
    return joined.select(F.explode(F.transform(times, lambda _: row)).alias("row")).select("row.*")
