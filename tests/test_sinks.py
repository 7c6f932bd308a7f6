import types

import pytest
from pyspark.sql import functions as F

from cohortry.sources import sinks
from cohortry.sources.registry import Registry, adapted
from tests.support import rows, same_rows


def test_folder_comes_from_the_session(spark):
    configured = spark.conf.get(sinks.CHECKPOINT_SETTING)
    assert sinks.new_location(spark, "x").startswith(configured + "/x-")


def test_without_the_setting_the_folder_lies_below_the_warehouse():
    settings = {"spark.sql.warehouse.dir": "hdfs://x/warehouse/"}
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, *default: settings.get(key)))
    assert sinks.shared_folder(session) == "hdfs://x/warehouse/_stages"


def test_a_cluster_without_a_shared_folder_is_refused():
    def session(**settings):
        return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda key, *default: settings.get(key, *default)))

    local = {"spark.sql.warehouse.dir": "file:/tmp/w"}
    assert sinks.shared_folder(session(**local, **{"spark.master": "local[4]"})) == "file:/tmp/w/_stages"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="checkpoint"):
            sinks.shared_folder(session(**local, **{"spark.master": master}))
    given = {"spark.checkpoint.dir": "hdfs://x/shared/", "spark.master": "yarn"}
    assert sinks.shared_folder(session(**given)) == "hdfs://x/shared"


def test_overwrite_table_replaces_schema(spark):
    name, path = sinks.new_table_name("t"), sinks.new_location(spark, "t")
    sinks.overwrite_table(spark.range(3), name, path=path)
    again = sinks.overwrite_table(spark.range(2).selectExpr("id AS k", "'x' AS v"), name, path=path)
    assert again.columns == ["k", "v"] and spark.table(name).count() == 2


def test_overwrite_rows_refuses_another_schema(spark):
    name = sinks.new_table_name("t")
    sinks.overwrite_table(spark.range(3), name, path=sinks.new_location(spark, "t"))
    with pytest.raises(ValueError):
        sinks.overwrite_rows(spark.range(2).selectExpr("CAST(id AS string) AS id"), name)
    with pytest.raises(ValueError):
        sinks.overwrite_rows(spark.range(2).selectExpr("id", "id AS more"), name)
    sinks.overwrite_rows(spark.range(9), name)
    assert spark.table(name).count() == 9


def test_partition_overwrite_is_idempotent(spark):
    path = sinks.new_location(spark, "p")
    full = spark.range(100).selectExpr("id", "CAST(id % 4 AS int) AS day")
    sinks.overwrite_partitions(full, path, ["day"])
    for _ in range(2):
        after = sinks.overwrite_partitions(
            full.filter("day = 1").withColumn("id", F.col("id") + 1000), path, ["day"]
        )
    assert after.count() == 100
    assert after.filter("id >= 1000").select("day").distinct().count() == 1


def test_merge(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    updates = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    merged = {(r["k"], r["v"]) for r in rows(sinks.merged(current, updates, ["k"]))}
    assert merged == {(1, "a"), (2, "B"), (3, "C"), (None, "n")}
    added = sinks.merged(current, spark.createDataFrame([(None, "N")], "k int, v string"), ["k"])
    assert {r["v"] for r in rows(added)} == {"a", "b", "n", "N"}


def test_merge_refuses_two_updates_of_one_key(spark):
    current = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(1, "B"), (1, "C")], "k int, v string")
    with pytest.raises(Exception, match="two updates"):
        sinks.merged(current, twice, ["k"]).collect()


def test_materialise_cuts_the_plan(spark):
    df = spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()
    stored = sinks.materialise(df, "m")
    assert same_rows(stored, df)
    assert "Aggregate" not in stored._jdf.queryExecution().executedPlan().toString()


def test_sample_is_bounded(spark):
    sample = [r["id"] for r in sinks.bounded_sample(spark.range(10_000), ["id"], 20).collect()]
    assert len(set(sample)) == 20 and min(sample) < 3_000 and max(sample) > 7_000
    again = sinks.bounded_sample(spark.range(10_000).repartition(5), ["id"], 20).collect()
    assert {r["id"] for r in again} == set(sample)


def test_registry(spark, small):
    registry = small.registry
    with pytest.raises(KeyError):
        registry.dataset("absent")
    nations = registry.union(["nation", "nation"], lambda df: df.filter("n_nationkey = 3"))
    assert nations.count() == 2
    with pytest.raises(Exception):
        registry.union(["nation", "region"]).count()  # no common columns
    renamed = adapted(nations, {"n_name": "name"}, {"since": F.lit("2020-01-01").cast("date")})
    assert "name" in renamed.columns and dict(renamed.dtypes)["since"] == "date"
    directory = registry.locations["nation"].rsplit("/", 1)[0]
    family = Registry(spark, {"x-{n}": directory + "/{n}.parquet"})
    assert family.dataset("x-{n}", n="region").count() == 5
