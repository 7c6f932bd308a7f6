"""Writes that touch what changed, reads across changing schemas, stages that report."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.sources.sinks import materialise, merged, new_location, overwrite_partitions

# --------------------------------------------------------------------------
# merging into partitions
# --------------------------------------------------------------------------


def _equal(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    return reduce(and_, [left[c].eqNullSafe(right[c]) for c in columns])


def merge_partitions(
    path: str, updates: DataFrame, keys: Sequence[str], partition_columns: Sequence[str]
) -> DataFrame:
    """Merge updates into a partitioned dataset, rewriting only partitions they touch.

    Touched are the partitions that updates go to and those that hold their keys so
    far, since an update may move a key. Updates equal to the row they
    replace do not count, so running the same merge again writes nothing. The new
    rows are staged before anything is replaced; a partition that loses its last row is
    removed. Two updates of one key stop the merge before it writes. Null keys
    equal no other: such updates are added, unless the same row is there.
    """
    spark = updates.sparkSession
    current = spark.read.parquet(path)
    new = updates.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in current.schema])
    known = reduce(and_, [F.col(k).isNotNull() for k in keys])
    if not new.where(known).groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"two updates of one key ({', '.join(keys)})")
    changed = materialise(new.join(current, _equal(new, current, current.columns), "left_anti"), "changed")
    if changed.isEmpty():
        return current
    parts = list(partition_columns)
    held = current.join(changed.select(*keys).distinct(), list(keys), "left_semi").select(*parts)
    touched = materialise(changed.select(*parts).union(held).distinct(), "touched")
    affected = current.join(touched, _equal(current, touched, parts), "left_semi")
    after = materialise(merged(affected, changed, keys), "merged")
    emptied = touched.join(after, _equal(touched, after, parts), "left_anti")
    folders = [
        r["file"].rsplit("/", 1)[0]
        for r in current.select(*parts, F.col("_metadata.file_path").alias("file"))
        .join(emptied, _equal(current, emptied, parts), "left_semi")
        .groupBy(*parts)
        .agg(F.min("file").alias("file"))
        .collect()
    ]
    result = overwrite_partitions(after, path, parts)
    for folder in folders:
        _remove(spark, folder)
    return spark.read.schema(result.schema).parquet(path) if folders else result


def _remove(spark: SparkSession, uri: str) -> None:
    """Remove a folder of a file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# --------------------------------------------------------------------------
# changing schemas
# --------------------------------------------------------------------------

# Types whose values all fit the type they may be widened to.
WIDER: Mapping[type[T.DataType], tuple[type[T.DataType], ...]] = {
    T.ByteType: (T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    T.ShortType: (T.IntegerType, T.LongType, T.FloatType, T.DoubleType),
    T.IntegerType: (T.LongType, T.DoubleType),
    T.FloatType: (T.DoubleType,),
    T.DateType: (T.TimestampNTZType,),
}


def as_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of a later schema: absent ones null, narrower types widened.

    A column the schema does not know, or of a type that does not fit, is an error,
    since either would lose data without a word.
    """
    given = {f.name: f.dataType for f in df.schema}
    unknown = [name for name in given if name not in schema.names]
    if unknown:
        raise ValueError(f"columns that the schema does not hold: {', '.join(unknown)}")
    columns = []
    for target in schema:
        kind = given.get(target.name)
        if kind is None:
            value = F.lit(None)
        elif kind == target.dataType or type(target.dataType) in WIDER.get(type(kind), ()):
            value = F.col(f"`{target.name}`")
        else:
            raise ValueError(
                f"{target.name} is {kind.simpleString()}, which does not fit {target.dataType.simpleString()}"
            )
        columns.append(value.cast(target.dataType).alias(target.name))
    return df.select(columns)


def generations(spark: SparkSession, paths: Iterable[str], schema: T.StructType) -> DataFrame:
    """Files of several generations of one dataset, read by the schema of the latest.

    Spark's own merge of parquet schemas refuses a type that was widened. Each
    generation is read by its own schema instead, so filters and columns still reach its scan.
    """
    frames = [as_schema(spark.read.parquet(path), schema) for path in paths]
    return reduce(DataFrame.unionAll, frames)


# --------------------------------------------------------------------------
# archives by day
# --------------------------------------------------------------------------

MONTH = "archive_month"


def _month_of(day: str) -> Column:
    return F.trunc(F.col(day), "month").alias(MONTH)


def archived(snapshots: Iterable[DataFrame], path: str, day: str) -> DataFrame:
    """Snapshots of several sources as one dataset with a folder per month.

    A folder per day would hold a few small files each over years of days.
    """
    months = reduce(DataFrame.unionByName, snapshots).select("*", _month_of(day))
    return overwrite_partitions(months, path, [MONTH])


def on_days(archive: DataFrame, days: DataFrame, day: str) -> DataFrame:
    """The rows of the listed days; folders of months without any are pruned as the query runs.

    The days of a list are few whatever the archive holds, so the list is broadcast.
    """
    listed = days.select(day, _month_of(day)).distinct()
    return archive.join(F.broadcast(listed), [MONTH, day], "left_semi").drop(MONTH)


# --------------------------------------------------------------------------
# stages that report
# --------------------------------------------------------------------------


def materialise_observed(
    df: DataFrame, name: str, metrics: Mapping[str, Column]
) -> tuple[DataFrame, dict[str, object]]:
    """Write a stage, and the given aggregates of its rows, in one job.

    A guard that would scan the stage again reads its figures from the write.
    """
    seen = Observation(name)
    path = new_location(df.sparkSession, name)
    df.observe(seen, *[value.alias(label) for label, value in metrics.items()]).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def profile_metrics(columns: Sequence[str]) -> dict[str, Column]:
    """Rows, and per column the nulls, as aggregates for ``materialise_observed``."""
    nulls = {f"{c}_nulls": F.count_if(F.col(c).isNull()) for c in columns}
    return {"rows": F.count(F.lit(1))} | nulls
