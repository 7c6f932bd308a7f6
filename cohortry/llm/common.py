"""What the operators of this package share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import configure
from cohortry.sources.dimensions import byte_size
from cohortry.sources.sinks import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


# Values that are sent to every executor in one piece.
MOST_BROADCAST_BYTES = 16 << 20

# Rows that go to a Python worker at a time. Texts are long, and a worker holds
# a batch several times over: as Arrow data, as strings, and its results.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings of the library and small Arrow batches.

    They change how a plan is executed, never what it returns.
    """
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return configure(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, read in a prepared session."""
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` in the cluster's shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as compressed columns, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_enough(df: DataFrame, most_bytes: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its values take at most ``most_bytes``.

    Beyond that it comes back as it is, and Spark joins by shuffling. ``df``
    should be checkpointed, since it is read here.
    """
    return F.broadcast(df) if byte_size(df) <= most_bytes else df


def apart(df: DataFrame, other: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` under names that ``other`` does not use, and its columns by their old names."""
    used = {c.lower() for c in other.columns}
    names = {}
    for column in df.columns:
        name = f"{column}_"
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        names[column] = name
    return df.withColumnsRenamed(names), {old: F.col(f"`{new}`") for old, new in names.items()}


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not use."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """A number that tells apart rows of one doc_id with different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))
