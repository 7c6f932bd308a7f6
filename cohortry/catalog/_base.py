"""Registration of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import configure
from cohortry.sources.standins import Standins


@dataclass(frozen=True)
class Entry:
    """A registered query. ``rounded`` maps result columns to decimals.

    Floating sums depend on the order of addition, so both engines round the
    listed columns before their results are compared.
    """

    build: Callable[[Standins], DataFrame]
    sql: str | None
    rounded: Mapping[str, int]

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        result = self.build(Standins(configure(spark), directory))
        return result.withColumns({c: F.round(F.col(c), d) for c, d in self.rounded.items()})

    def oracle(self) -> str | None:
        if self.sql is None or not self.rounded:
            return self.sql
        # Adding zero turns a rounded -0.0 into 0.0.
        replaced = ", ".join(f'ROUND("{c}", {d}) + 0.0 AS "{c}"' for c, d in self.rounded.items())
        return f"SELECT * REPLACE ({replaced}) FROM (\n{self.sql}\n)"


CATALOG: dict[str, Entry] = {}


def digits(**by_count: Iterable[str]) -> dict[str, int]:
    """``digits(d2=[...], d6=[...])`` as a column-to-decimals mapping."""
    return {column: int(key[1:]) for key, columns in by_count.items() for column in columns}


def mean_sql(column: str, scale: int, places: int, factor: int = 1) -> str:
    """Mean of a non-negative ``scale``-decimal column, rounded half up in integers."""
    unit = 10**scale
    total = f"SUM(CAST(ROUND({column} * {unit}) AS BIGINT))"
    rounded = (
        f"(2 * {total} * {factor * 10**places} + COUNT({column}) * {unit})"
        f" // (2 * COUNT({column}) * {unit})"
    )
    return f"CAST({rounded} AS DOUBLE) / {10**places}"


def query(sql: str | None = None, rounded: Mapping[str, int] | None = None):
    """Register a function of the input relations under its own name."""

    def register(build: Callable[[Standins], DataFrame]):
        name = build.__name__
        if name in CATALOG:
            raise ValueError(f"query registered twice: {name}")
        CATALOG[name] = Entry(build, sql, dict(rounded or {}))
        return build

    return register
