"""Running totals kept as state, and advanced by what a batch adds.

``running`` holds the rows of ``uplift.with_running_totals``, in a folder per period;
``totals`` holds what each customer and variant has reached. A batch reads the totals, the new
rows, and of the past only the periods that late rows belong to or precede; a full
recomputation would read every period again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.uplift import CUSTOMER, PERIOD, VARIANT, with_running_totals
from cohortry.sources.sinks import overwrite_partitions

KEY = (CUSTOMER, VARIANT)


class RunningTotals:
    """Running totals below a path of the shared folder, advanced batch by batch.

    ``periods`` of a batch has one row per customer, period and variant with what the batch
    adds to each metric; a period may come again when late rows arrive. Batches are
    numbered upwards. What a batch changes is computed from the state before it and
    written next to it before anything is replaced, so a batch that failed half-way is run
    again, and one that runs twice ends in the same state.
    """

    def __init__(self, spark: SparkSession, path: str, metrics: Sequence[str]) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.metrics = list(metrics)

    @property
    def cumulative(self) -> list[str]:
        return [f"cum_{m}" for m in self.metrics]

    def _exists(self, path: str) -> bool:
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def _done(self, folder: str) -> bool:
        """Whether a folder has been written to its end."""
        return self._exists(f"{folder}/_SUCCESS")

    def _totals(self, batch: int, like: DataFrame) -> DataFrame:
        """What the batches before this one reached."""
        schema = T.StructType([like.schema[c] for c in (*KEY, *self.metrics)])
        for earlier in range(batch - 1, -1, -1):
            folder = f"{self.path}/batches/{earlier}/totals"
            if self._done(folder):
                return self.spark.read.schema(schema).parquet(folder)
        return self.spark.createDataFrame([], schema)

    def running(self, like: DataFrame | None = None) -> DataFrame:
        """customer, period, variant, the metrics and their running totals."""
        folder = f"{self.path}/running"
        if self._exists(folder):
            return self.spark.read.schema(self._schema()).parquet(folder)
        if like is None:
            raise ValueError("no batch has been added yet")
        return self.spark.createDataFrame([], with_running_totals(like, self.metrics).schema)

    def _schema(self) -> T.StructType:
        """As the first batch wrote it; the types of a folder's name would be guessed."""
        for batch in range(1 << 20):
            folder = f"{self.path}/batches/{batch}/running"
            if self._done(folder):
                return self.spark.read.parquet(folder).schema
        raise ValueError("no batch has been added yet")

    def advance(self, periods: DataFrame, batch: int) -> DataFrame:
        """Add a batch and return all running totals."""
        folder = f"{self.path}/batches/{batch}"
        columns = (CUSTOMER, PERIOD, VARIANT, *self.metrics)
        periods = periods.select(*columns)
        if not (self._done(f"{folder}/running") and self._done(f"{folder}/totals")):
            self._prepare(periods, batch, folder)
        changed = self.spark.read.parquet(f"{folder}/running")
        if not changed.isEmpty():
            overwrite_partitions(changed, f"{self.path}/running", [PERIOD])
        return self.running(periods)

    def _prepare(self, periods: DataFrame, batch: int, folder: str) -> None:
        """Write what the batch changes: the rows of each period it touches, and the new totals.

        The batch itself is written first: what it is made from runs once, however often
        its rows are read here.
        """
        periods.write.mode("overwrite").parquet(f"{folder}/added")
        periods = self.spark.read.schema(periods.schema).parquet(f"{folder}/added")
        before = self._totals(batch, periods)
        first = periods.agg(F.min(PERIOD)).first()[0]
        keys = periods.select(*KEY).distinct()
        past = self.running(periods)
        later = past.where(F.col(PERIOD) >= F.lit(first)) if first is not None else past.limit(0)
        held = later.join(keys, list(KEY), "left_semi").select(*periods.columns)
        # Dealt by the key alone: the sums, the running window and the join shuffle once.
        dealt = held.unionByName(periods).repartition(*[F.col(c) for c in KEY])
        rows = dealt.groupBy(CUSTOMER, PERIOD, VARIANT).agg(*[F.sum(m).alias(m) for m in self.metrics])
        # What the keys had reached before the first period that changes.
        sums = held.groupBy(*KEY).agg(*[F.sum(m).alias(f"_{m}") for m in self.metrics])
        start = before.join(keys, list(KEY), "left_semi").join(sums, list(KEY), "left").select(
            *KEY, *[(F.col(m) - F.coalesce(f"_{m}", F.lit(0))).alias(f"_{m}") for m in self.metrics]
        )
        summed = with_running_totals(rows, self.metrics).join(start, list(KEY), "left")
        shifted = {
            c: F.col(c) + F.coalesce(f"_{m}", F.lit(0)) for c, m in zip(self.cumulative, self.metrics, strict=True)
        }
        names = [*periods.columns, *self.cumulative]
        new = summed.withColumns(shifted).select(*names)
        others = later.join(keys, list(KEY), "left_anti").select(*names)
        others.unionByName(new).write.mode("overwrite").parquet(f"{folder}/running")
        added = before.unionByName(periods.select(*KEY, *self.metrics)).groupBy(*KEY)
        totals = added.agg(*[F.sum(m).alias(m) for m in self.metrics])
        totals.write.mode("overwrite").parquet(f"{folder}/totals")
