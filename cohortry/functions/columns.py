"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

__all__ = [
    "any_like",
    "any_true",
    "bucket_floor",
    "cancelled_difference",
    "compound_cost",
    "first_match",
    "flag",
    "hours_between",
    "matching_lines",
    "month_label",
    "month_start",
    "occurrences",
    "ratio",
    "ratio_if_positive",
    "rounded_mean",
    "row_bytes",
    "square",
]


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null where the denominator is zero (ANSI mode would raise)."""
    return F.try_divide(numerator, denominator)


def ratio_if_positive(numerator: Column, denominator: Column) -> Column:
    """Quotient where the denominator is above zero, else null."""
    return F.when(denominator > 0, F.try_divide(numerator, denominator))


def square(value: Column) -> Column:
    return value * value


def cancelled_difference(minuend: Column, subtrahend: Column) -> Column:
    """Difference of two terms, zero where only their rounding error is left.

    Never negative; null stays null. Without it a square root would blow up
    noise that depends on the order of addition.
    """
    difference = minuend - subtrahend
    return F.when(difference < minuend * F.lit(1e-12), F.lit(0.0)).otherwise(difference)


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or null."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def any_true(names: Iterable[str]) -> Column:
    """OR over boolean-like columns, counting null as false."""
    return reduce(or_, [F.coalesce(F.col(n).cast("boolean"), F.lit(False)) for n in names])


def first_match(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Label of the first rule that holds."""
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, F.lit(label))
    return chain if default is None else chain.otherwise(F.lit(default))


def any_like(text: Column, patterns: Sequence[str]) -> Column:
    """Case-sensitive LIKE against any of the patterns."""
    return reduce(or_, [text.like(p) for p in patterns])


def occurrences(text: Column, pattern: str) -> Column:
    """Number of non-overlapping matches in the whole text."""
    return F.regexp_count(text, F.lit(pattern))


def matching_lines(text: Column, pattern: str) -> Column:
    """Number of newline-separated lines in which the pattern is found."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern)))


def rounded_mean(value: Column, scale: int, places: int, factor: int = 1) -> Column:
    """Mean of a ``scale``-decimal value times ``factor``, rounded half up.

    The sum is exact decimal arithmetic, so a mean that ends on a tie rounds
    the same way whatever order the tasks finish in.
    """
    mean = F.avg(value.cast(f"decimal(18,{scale})"))
    return F.round(mean * F.lit(factor), places).cast("double")


def month_start(value: Column) -> Column:
    return F.date_trunc("month", value).cast("date")


def month_label(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM")


def hours_between(start: Column, end: Column, scale: int) -> Column:
    """Elapsed hours rounded to ``scale`` decimals."""
    seconds = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    return F.round(seconds / F.lit(3600), scale)


def compound_cost(principal: Column, periodic_rate: Column, periods: Column) -> Column:
    """Principal grown at a periodic rate over a number of periods."""
    return principal * F.pow(F.lit(1) + periodic_rate, periods)


def bucket_floor(value: Column, width: int) -> Column:
    """Lower edge of the equal-width bucket the value falls in."""
    return F.floor(value / F.lit(width)) * F.lit(width)


def _value_bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.ArrayType):
        start = F.lit(16).cast("long")
        return F.coalesce(F.aggregate(value, start, lambda held, x: held + _value_bytes(x, kind.elementType)), start)
    if isinstance(kind, T.StructType):
        return sum((_value_bytes(value[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def row_bytes(schema: T.StructType) -> Column:
    """About how many bytes a row of the schema takes in memory."""
    each = (_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in schema)
    return sum(each, F.lit(16)).cast("long")
