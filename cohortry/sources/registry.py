"""Datasets by logical name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession


class Registry:
    """Maps logical names to parquet locations, or catalog tables.

    A location may hold placeholders: with ``"eligibility-{journey}"``
    registered, ``dataset("eligibility-{journey}", journey="a")`` fills both
    the name and the path.
    """

    def __init__(self, spark: SparkSession, locations: Mapping[str, str]):
        self.spark = spark
        self.locations = dict(locations)

    @classmethod
    def of_directory(cls, spark: SparkSession, directory: str, names: Iterable[str]) -> Registry:
        return cls(spark, {n: f"{directory}/{n}.parquet" for n in names})

    def table(self, name: str) -> DataFrame:
        """A table of the session catalog."""
        return self.spark.table(name)

    def dataset(self, name: str, **parameters: str) -> DataFrame:
        if name not in self.locations:
            raise KeyError(f"no dataset named {name!r}")
        return self.spark.read.parquet(self.locations[name].format(**parameters))

    def union(
        self, names: Iterable[str], prepare: Callable[[DataFrame], DataFrame] = lambda df: df
    ) -> DataFrame:
        """Several datasets, each prepared alike, unioned by column name."""
        return reduce(DataFrame.unionByName, (prepare(self.dataset(n)) for n in names))


def adapted(
    df: DataFrame, rename: Mapping[str, str] | None = None, constants: Mapping[str, Column] | None = None
) -> DataFrame:
    """Rename columns and add constant ones on read."""
    return df.withColumnsRenamed(dict(rename or {})).withColumns(dict(constants or {}))
