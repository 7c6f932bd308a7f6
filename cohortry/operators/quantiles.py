"""Exact quantiles of a column, however many rows it has."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# An approximate quantile errs by at most one in so many rows.
ACCURACY = 10_000
# Rows around one quantile that may be left to count one by one.
MOST_LEFT = 200_000


@dataclass
class Stretch:
    """Where one quantile lies: a closed range of values, and the rows in front of it."""

    rank: int
    low: object = None
    high: object = None
    below: int = 0
    rows: int = 0

    def holds(self, value: Column) -> Column:
        if self.low is None:
            return F.lit(True)
        return (value >= F.lit(self.low)) & (value <= F.lit(self.high))

    def shares(self, accuracy: int) -> list[float]:
        """Shares of its rows that enclose the rank, whatever the error of the sketch."""
        at, margin = (self.rank - self.below) / self.rows, 2 / accuracy
        return [max(0.0, at - margin), min(1.0, at + margin)]


def exact_quantiles(
    df: DataFrame, column: str, shares: Sequence[float], accuracy: int = ACCURACY, most_left: int = MOST_LEFT
) -> DataFrame:
    """share and the value at rank ceil(share * rows); nulls are left out.

    One aggregation makes a mergeable sketch, which gives for all shares a range of
    values that holds the wanted one. While the ranges hold many rows, one more
    aggregation narrows all of them. The last one counts the values inside the ranges,
    and the rows between them. So the number of jobs does not depend on the number of
    shares: two, and one more for every factor of ``accuracy / 4`` beyond ``most_left`` rows.
    """
    if not shares:
        raise ValueError("no share given")
    value = F.col("value")
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value"))
    # For any share, whatever the number of rows: the margins cover the rounding of the rank.
    first = _enclosing(value, [[max(0.0, s - 2 / accuracy), min(1.0, s + 2 / accuracy)] for s in shares], accuracy)
    seen = values.agg(F.count(F.lit(1)).alias("rows"), *first).first()
    total = seen["rows"]
    stretches = [Stretch(max(1, math.ceil(s * total))) for s in shares]
    for i, stretch in enumerate(stretches):
        stretch.rows = total
        if total:
            stretch.low, stretch.high = seen[f"cuts_{i}"]
    left = min(total, 4 * total / accuracy + 1)
    while total and left > most_left:
        counts = []
        for i, s in enumerate(stretches):
            counts.append(F.count_if(value < F.lit(s.low)).alias(f"below_{i}"))
            counts.append(F.count_if(s.holds(value)).alias(f"rows_{i}"))
        found = values.agg(*counts).first()
        for i, s in enumerate(stretches):
            s.below, s.rows = found[f"below_{i}"], found[f"rows_{i}"]
        left = max(s.rows for s in stretches)
        if left <= most_left or all(s.low == s.high for s in stretches):
            break
        inner = [F.when(s.holds(value), value) for s in stretches]
        cuts = values.agg(*_enclosing(inner, [s.shares(accuracy) for s in stretches], accuracy)).first()
        before = [(s.low, s.high) for s in stretches]
        for i, s in enumerate(stretches):
            s.low, s.high = cuts[f"cuts_{i}"]
        if before == [(s.low, s.high) for s in stretches]:
            # Few values hold nearly all of the rows, and counting them is cheap.
            break
        left = 4 * left / accuracy + 1
    return _counted(values, column, shares, stretches)


def _enclosing(value, shares: Sequence[Sequence[float]], accuracy: int) -> list[Column]:
    values = value if isinstance(value, list) else [value] * len(shares)
    return [
        F.percentile_approx(v, list(pair), accuracy).alias(f"cuts_{i}")
        for i, (v, pair) in enumerate(zip(values, shares, strict=True))
    ]


def _counted(values: DataFrame, column: str, shares: Sequence[float], stretches: Sequence[Stretch]) -> DataFrame:
    """The values at the ranks, from the counts inside the ranges and between them."""
    ranges: list[list] = []
    for s in sorted((s for s in stretches if s.low is not None), key=lambda s: s.low):
        if ranges and s.low <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], s.high)
        else:
            ranges.append([s.low, s.high])
    value = F.col("value")
    inside, passed = F.lit(False), F.lit(0)
    for low, high in ranges:
        within = (value >= F.lit(low)) & (value <= F.lit(high))
        inside = inside | within
        passed = passed + F.when(value > F.lit(high), F.lit(2)).when(within, F.lit(1)).otherwise(F.lit(0))
    # A row per value inside a range, and one for all rows between two ranges.
    counted = values.groupBy(passed.alias("spot"), F.when(inside, value).alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    line = Window.orderBy("spot", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = F.array(
        *[F.struct(F.lit(float(p)).alias("share"), F.lit(s.rank).alias("rank")) for p, s in zip(shares, stretches, strict=True)]
    )
    return (
        counted.withColumn("upto", F.sum("rows").over(line))
        .withColumn("asked", F.explode(wanted))
        .where((F.col("upto") >= F.col("asked.rank")) & (F.col("upto") - F.col("rows") < F.col("asked.rank")))
        .select("asked.share", value.alias(column))
    )
