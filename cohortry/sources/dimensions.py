"""Dimensions staged once and shared by the joins that need them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions import row_bytes
from cohortry.sources.sinks import Stage, materialise

# What one dimension may take in every executor.
MOST_BROADCAST_BYTES = 64 << 20


def byte_size(df: DataFrame) -> int:
    """About how many bytes the rows take in memory, from one aggregation."""
    return df.agg(F.sum(row_bytes(df.schema))).first()[0] or 0


class StagedDimensions:
    """Lookup tables by name, each built and written once.

    Every join reads the written copy instead of building the dimension anew. Its
    rows are measured when it is staged, and a join broadcasts it only below the bound;
    a larger one is left to the optimizer, which shuffles it and splits hot keys.
    """

    def __init__(self, stage: Stage = materialise, most_bytes: int = MOST_BROADCAST_BYTES) -> None:
        self.stage = stage
        self.most_bytes = most_bytes
        self.held: dict[str, tuple[DataFrame, int]] = {}

    def add(self, name: str, dimension: DataFrame, key: Sequence[str]) -> DataFrame:
        """Stage a dimension under a name; a key that occurs twice stops the job.

        A name that is held already keeps its first dimension.
        """
        if name not in self.held:
            staged = self.stage(dimension, name)
            twice = staged.groupBy(*key).count().where("count > 1")
            if not twice.isEmpty():
                raise ValueError(f"{name} holds a key ({', '.join(key)}) more than once")
            self.held[name] = staged, byte_size(staged)
        return self.held[name][0]

    def __getitem__(self, name: str) -> DataFrame:
        """The staged rows, marked for broadcast if they are few enough."""
        staged, size = self.held[name]
        return F.broadcast(staged) if size <= self.most_bytes else staged

    def looked_up(self, facts: DataFrame, name: str, key: Sequence[str], how: str = "left") -> DataFrame:
        """``facts`` with the columns of a dimension. The key is unique, so no row multiplies."""
        return facts.join(self[name], list(key), how)
