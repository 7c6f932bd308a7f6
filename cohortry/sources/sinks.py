"""Writing results, and cutting lineage with written tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Takes a frame and a name, and returns the frame to go on with.
Stage = Callable[[DataFrame, str], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Where the setting is absent, it lies below the warehouse. A cluster whose warehouse is
    a folder of the driver's machine is refused, since its executors do not see that.
    """
    configured = spark.conf.get(CHECKPOINT_SETTING, None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    scheme = warehouse.split(":", 1)[0] if ":" in warehouse else "file"
    if scheme == "file" and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that driver and executors share")
    return f"{warehouse}/_stages"


def new_location(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def new_table_name(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex}"


def without_name(df: DataFrame, name: str) -> DataFrame:
    """Drop the view or table name that ``df`` was read by; ``df`` goes on working.

    Its plan reads the files themselves. A table must have its own path.
    """
    spark = df.sparkSession
    if not spark.catalog.dropTempView(name):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return df


def overwrite_table(
    df: DataFrame, table: str, fmt: str = "parquet", path: str | None = None
) -> DataFrame:
    """Replace a table, schema included, and return it re-read.

    The target must not be a source of ``df``: Spark refuses to overwrite a
    table it is reading.
    """
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "delta":
        writer = writer.option("overwriteSchema", "true")
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


def overwrite_rows(df: DataFrame, table: str) -> DataFrame:
    """Replace the rows of an existing table; a different schema is an error."""
    spark = df.sparkSession
    target = spark.table(table).schema
    expected = [(f.name, f.dataType) for f in target]
    if sorted((f.name, str(f.dataType)) for f in df.schema) != sorted(
        (n, str(t)) for n, t in expected
    ):
        raise ValueError(f"schema of {table} differs from the rows to write")
    df.select(*[n for n, _ in expected]).write.insertInto(table, overwrite=True)
    return spark.table(table)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a stage to the shared folder and read it back.

    What follows starts from files that outlive any executor.
    """
    path = new_location(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class TableStages:
    """Stages as tables of the catalog, which are dropped at the end.

    ``with TableStages() as stage: report(..., stage=stage)`` keeps the tables as
    long as the frames of the report are read.
    """

    def __init__(self) -> None:
        self.tables: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        table = new_table_name(name)
        self.tables.append((df.sparkSession, table))
        df.write.saveAsTable(table)
        return df.sparkSession.table(table)

    def __enter__(self) -> TableStages:
        return self

    def __exit__(self, *_) -> None:
        while self.tables:
            spark, table = self.tables.pop()
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def overwrite_partitions(df: DataFrame, path: str, partition_columns: Sequence[str]) -> DataFrame:
    """Replace only the partitions present in ``df``; a re-run changes nothing.

    The rebalance gives each partition value few files, and splits a value
    that is too large for one task.
    """
    (
        df.hint("rebalance", *[F.col(c) for c in partition_columns])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_columns)
        .parquet(path)
    )
    return df.sparkSession.read.parquet(path)


def merged(current: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``current`` replaced by those of ``updates`` with the same key.

    Two updates of one key stop the job, since either could be meant. A null
    key equals no other: its update is added, and its row in ``current`` stays.
    """
    columns = [c for c in updates.columns if c not in keys]
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    folded = updates.where(known).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_updates"), F.first(F.struct(*columns)).alias("_row")
    )
    refused = F.raise_error(F.lit(f"two updates of one key ({', '.join(keys)})"))
    single = folded.withColumn("_row", F.when(F.col("_updates") == 1, F.col("_row")).otherwise(refused))
    changed = single.select(*keys, "_row.*").unionByName(updates.where(~known))
    untouched = current.join(updates.select(*keys).distinct(), list(keys), "left_anti")
    return untouched.unionByName(changed)


def bounded_sample(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """``limit`` rows from all over the frame: the smallest hashes of the keys.

    Each task keeps its ``limit`` first, so the sample reads the whole table and
    sends little.
    """
    hashed = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    return df.orderBy(hashed, *keys).limit(limit)
