"""Stages in buckets of one key, joined and folded by it without another shuffle."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.sources.sinks import materialise, new_table_name

# A key with more rows than so many mean buckets is hot,
HOT_BUCKETS = 2
# unless a task reads that many rows without trouble.
FEW_ROWS = 1_000_000


class BucketedStages:
    """Frames written once in equally many buckets of one key.

    Reports that join and fold the frames by that key read bucket for bucket and shuffle
    nothing. A bucket is read by one task, however, so keys that fill buckets of their own in
    any frame are kept beside the buckets, in files that many tasks read; their joins and folds
    shuffle as usual, combine before the shuffle and are split where a key is too large. A
    frame has fewer hot keys than half its buckets, so the list of them can be broadcast.
    A null key is a key like others, and hot if many rows have it.

    Each frame is read three times; hand in tables or stages, not long plans. The tables are
    dropped at the end of the ``with`` block.
    """

    def __init__(
        self, frames: Mapping[str, DataFrame], key: str, buckets: int | None = None, few_rows: int = FEW_ROWS
    ) -> None:
        self.spark = next(iter(frames.values())).sparkSession
        self.key = key
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: list[str] = []
        hot = reduce(DataFrame.union, [self._hot_keys(df, few_rows) for df in frames.values()]).distinct()
        self.hot_keys = materialise(hot, "hot_keys")
        self.has_hot = not self.hot_keys.isEmpty()
        self.usual = {name: self._bucketed(df, name) for name, df in frames.items()}
        self.hot = {name: materialise(self._part(df, "left_semi"), name) for name, df in frames.items() if self.has_hot}

    def _hot_keys(self, df: DataFrame, few_rows: int) -> DataFrame:
        limit = max(few_rows, HOT_BUCKETS * df.count() / self.buckets)
        return df.groupBy(F.col(self.key).alias("_hot")).count().where(F.col("count") > limit).select("_hot")

    def _part(self, df: DataFrame, how: str) -> DataFrame:
        """The rows of hot keys, or those of all others."""
        return df.join(F.broadcast(self.hot_keys), F.col(self.key).eqNullSafe(F.col("_hot")), how)

    def _bucketed(self, df: DataFrame, name: str) -> DataFrame:
        rows = self._part(df, "left_anti") if self.has_hot else df
        table = new_table_name(name)
        self.tables.append(table)
        # Dealt out as the buckets are, so each bucket is one file.
        rows.repartition(self.buckets, self.key).write.bucketBy(self.buckets, self.key).saveAsTable(table)
        return self.spark.table(table)

    def per_key(self, function: Callable[..., DataFrame], *names: str) -> DataFrame:
        """``function`` of the named frames. It must treat each key on its own, rows of others unseen."""
        usual = function(*[self.usual[name] for name in names])
        if not self.has_hot:
            return usual
        return usual.unionByName(function(*[self.hot[name] for name in names]))

    def drop(self) -> None:
        while self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop()}")

    def __enter__(self) -> BucketedStages:
        return self

    def __exit__(self, *_) -> None:
        self.drop()
