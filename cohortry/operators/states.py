"""Distinct counts over rolling days from one small state per day.

An archive of many days is read once per day, not once per day and window: each
day leaves a state, and the states of a window are merged. Bitmaps give
the exact count of integer ids, and are no more than the ids seen on a day; a sketch gives
an estimate in a few kilobytes per group, for ids of any kind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 30
# The ids of a bucket are the bits of one long.
BUCKET_BITS = 6
# Entries of a sketch are 2 ** SKETCH_BITS; its standard error is 1.04 / sqrt(entries).
SKETCH_BITS = 12


def daily_bitmaps(rows: DataFrame, groups: Sequence[str], day: str, entity: str) -> DataFrame:
    """Groups, day, bucket and a bitmap of the entities seen; one row per 64 ids.

    Rows without the entity count for none. Repeated rows set the same bit, and
    combine before the shuffle. A bitmap is one number, so ids that lie far apart
    take no more than a row each.
    """
    kind = dict(rows.dtypes)[entity]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{entity} is {kind}; bitmaps need integers, use daily_sketches")
    known = rows.where(F.col(entity).isNotNull())
    number = F.col(entity).cast("bigint")
    place = number.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    bucket = F.shiftright(number, BUCKET_BITS).alias("bucket")
    return known.groupBy(*groups, day, bucket).agg(F.bit_or(bit).alias("members"))


def daily_sketches(
    rows: DataFrame, groups: Sequence[str], day: str, entity: str, bits: int = SKETCH_BITS
) -> DataFrame:
    """Groups, day and a sketch of the entities seen."""
    return rows.groupBy(*groups, day).agg(F.hll_sketch_agg(entity, bits).alias("members"))


def _windows(states: DataFrame, day: str, days: int, until: Column | None) -> DataFrame:
    """Each state under every day whose window holds it, as ``as_of``."""
    last = F.date_add(day, days - 1)
    each = states.withColumn("as_of", F.explode(F.sequence(F.col(day), last)))
    return each if until is None else each.where(F.col("as_of") <= until)


def rolling_count(
    states: DataFrame, groups: Sequence[str], day: str, days: int = DAYS, until: Column | None = None
) -> DataFrame:
    """Groups, as_of and the exact number of entities of its last ``days`` days.

    No bitmap is copied into its windows. A day adds the bits that the ``days`` before
    it lack, and takes away, once it has left the window, those that the ``days`` after
    it lack; the counts are the running sums of these changes. States of one day that
    are still apart are taken together.
    """
    key = (*groups, "bucket")
    dated = states.where(F.col(day).isNotNull()).withColumn("_day", F.unix_date(day))
    in_bucket = Window.partitionBy(*key).orderBy("_day")

    def seen(first: int, last: int) -> Column:
        return F.coalesce(F.bit_or("members").over(in_bucket.rangeBetween(first, last)), F.lit(0))

    def lacking(others: str) -> Column:
        return F.when(F.col("_first"), F.bit_count(F.col("_seen").bitwiseAND(F.bitwise_not(others)))).otherwise(0)

    moved = dated.select(
        *groups,
        "_day",
        (~F.lag("_day").over(in_bucket).eqNullSafe(F.col("_day"))).alias("_first"),
        seen(0, 0).alias("_seen"),
        seen(-days, -1).alias("_before"),
        seen(1, days).alias("_after"),
    )
    changes = moved.select(
        *groups,
        F.inline(
            F.array(
                F.struct(F.col("_day"), lacking("_before").alias("_change")),
                F.struct((F.col("_day") + days).alias("_day"), (-lacking("_after")).alias("_change")),
            )
        ),
    )
    in_group = Window.partitionBy(*groups).orderBy("_day")
    counted = (
        changes.groupBy(*groups, "_day")
        .agg(F.sum("_change").alias("_change"))
        .withColumns({"entities": F.sum("_change").over(in_group), "_next": F.lead("_day").over(in_group)})
        .where(F.col("entities") > 0)
    )
    held = F.sequence(F.date_from_unix_date("_day"), F.date_from_unix_date(F.col("_next") - 1))
    each = counted.select(*groups, F.explode(held).alias("as_of"), "entities")
    return each if until is None else each.where(F.col("as_of") <= until)


def rolling_estimate(
    states: DataFrame, groups: Sequence[str], day: str, days: int = DAYS, until: Column | None = None
) -> DataFrame:
    """Groups, as_of and an estimate of the entities of its last ``days`` days."""
    return (
        _windows(states, day, days, until)
        .groupBy(*groups, "as_of")
        .agg(F.hll_sketch_estimate(F.hll_union_agg("members")).alias("entities"))
    )
