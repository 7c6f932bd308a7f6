"""Staged dimensions, incremental writes, mergeable states: plans, files and edge cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.catalog import CATALOG, mechanisms, uplift
from cohortry.operators import states
from cohortry.operators.quantiles import exact_quantiles
from cohortry.operators.running import RunningTotals
from cohortry.operators.uplift import customer_periods, with_running_totals
from cohortry.sources import incremental, sinks
from cohortry.sources.buckets import BucketedStages
from cohortry.sources.dimensions import StagedDimensions, byte_size
from tests.conftest import SMALL
from tests.support import rows, same_rows
from tests.test_scale import settings


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def jobs_of(spark, action):
    group = sinks.new_table_name("jobs")
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = action()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


# -- staged dimensions -------------------------------------------------------


def test_a_dimension_is_built_once_for_all_joins(spark, small):
    built = []

    def stage(df, name):
        built.append(name)
        return sinks.materialise(df, name)

    dimensions = StagedDimensions(stage)
    result = mechanisms.shared_dimension(small, dimensions)
    dimensions.add("journey_products", small.journey_products, ["journey_id"])
    plan = plan_of(result)
    assert built == ["journey_products"] and plan.count("journey_products-") >= 1
    assert "BroadcastHashJoin" in plan


def test_a_large_dimension_is_not_broadcast(spark, small):
    few = StagedDimensions(most_bytes=0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        result = mechanisms.shared_dimension(small, few)
        plan = plan_of(result)
        assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
        assert same_rows(result, mechanisms.shared_dimension(small, StagedDimensions()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_dimension_with_a_repeated_key_is_refused(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(ValueError, match="more than once"):
        StagedDimensions().add("twice", twice, ["k"])


def test_byte_size_follows_the_values(spark):
    short = spark.createDataFrame([(1, "a")] * 10, "k int, v string")
    long = spark.createDataFrame([(1, "a" * 1000)] * 10, "k int, v string")
    nested = spark.createDataFrame([([["x" * 100]],)], "v array<array<string>>")
    assert byte_size(long) - byte_size(short) == 9990 and byte_size(nested) > 100
    assert byte_size(short.limit(0)) == 0


# -- bucketed stages ---------------------------------------------------------

NO_BROADCAST = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
SPLITS = NO_BROADCAST | {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def hot_facts(spark, key):
    """30,000 facts, every third of one customer, and one exposure per customer."""
    number = F.col("id")
    facts = spark.range(0, 30000, 1, 12).select(
        F.when(number % 3 == 0, F.lit(key)).otherwise(number % 500).alias("customer_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (number % 60).cast("int")).alias("date"),
        (number % 11).alias("amount"),
    )
    exposure = (
        facts.where("customer_id is not null")
        .select("customer_id", F.lit("a").alias("variant"), F.lit("2020-01-05").cast("date").alias("exposition_date"))
        .distinct()
    )
    return {"facts": facts, "exposure": exposure}


def monthly(facts, exposure):
    periods = customer_periods(facts, exposure, {"m": "amount"}, "2020-01-01", grain="month")
    return with_running_totals(periods, ["m"])


def test_buckets_are_joined_folded_and_windowed_without_an_exchange(spark):
    frames = hot_facts(spark, -1)
    with settings(spark, NO_BROADCAST), BucketedStages(frames, "customer_id", 6) as stages:
        assert not stages.has_hot
        result = stages.per_key(monthly, "facts", "exposure")
        plan = plan_of(result)
        assert "SortMergeJoin" in plan and "Window" in plan and "Exchange" not in plan
        assert same_rows(result, monthly(*frames.values()))


@pytest.mark.parametrize("key", [-1, None])
def test_a_hot_customer_is_kept_beside_the_buckets(spark, key):
    frames = hot_facts(spark, key)
    with BucketedStages(frames, "customer_id", 12, few_rows=1000) as stages:
        assert [r["_hot"] for r in stages.hot_keys.collect()] == [key]
        assert stages.hot["facts"].count() == 10000 and stages.usual["facts"].count() == 20000
        in_files = stages.usual["facts"].groupBy(F.input_file_name()).count()
        assert in_files.count() <= 12 and in_files.agg(F.max("count")).first()[0] < 5000
        assert same_rows(stages.per_key(monthly, "facts", "exposure"), monthly(*frames.values()))


def test_a_hot_customer_is_still_split_in_a_join_of_rows(spark):
    frames = hot_facts(spark, -1)

    def joined(facts, exposure):
        return facts.join(exposure, "customer_id", "left")

    with settings(spark, SPLITS), BucketedStages(frames, "customer_id", 12, few_rows=1000) as stages:
        result = stages.per_key(joined, "facts", "exposure")
        plan = plan_of(result)
        assert "skew=true" in plan and plan.count("SortMergeJoin") >= 2
        assert same_rows(result, joined(*frames.values()))


def test_buckets_of_nothing_are_dropped_with_their_tables(spark):
    frames = {name: df.limit(0) for name, df in hot_facts(spark, -1).items()}
    with BucketedStages(frames, "customer_id", 3) as stages:
        assert stages.per_key(monthly, "facts", "exposure").collect() == []
        tables = list(stages.tables)
        assert all(spark.catalog.tableExists(name) for name in tables)
    assert len(tables) == 2 and not any(spark.catalog.tableExists(name) for name in tables)


# -- merging into partitions -------------------------------------------------


def files(path, spark):
    """File names by folder."""
    listed = spark.read.parquet(path).select("_metadata.file_path").distinct().collect()
    found = {}
    for r in listed:
        folder, name = r[0].rsplit("/", 2)[1:]
        found.setdefault(folder, set()).add(name)
    return found


@pytest.fixture()
def partitioned(spark):
    path = sinks.new_location(spark, "merge")
    rows_ = spark.range(40).selectExpr("id AS k", "concat('v', id) AS v", "CAST(id % 4 AS int) AS day")
    sinks.overwrite_partitions(rows_, path, ["day"])
    return path


def test_only_touched_partitions_are_rewritten(spark, partitioned):
    before = files(partitioned, spark)
    updates = spark.createDataFrame([(5, "new", 1), (100, "added", 1)], "k long, v string, day int")
    after = incremental.merge_partitions(partitioned, updates, ["k"], ["day"])
    assert after.count() == 41 and {r["v"] for r in after.where("k in (5, 100)").collect()} == {"new", "added"}
    now = files(partitioned, spark)
    assert all(now[f"day={d}"] == before[f"day={d}"] for d in (0, 2, 3)) and now["day=1"] != before["day=1"]


def test_a_second_run_of_a_merge_changes_nothing(spark, partitioned):
    updates = spark.createDataFrame([(5, "new", 2), (None, "n", 3)], "k long, v string, day int")
    first = rows(incremental.merge_partitions(partitioned, updates, ["k"], ["day"]), "v")
    before = files(partitioned, spark)
    again = rows(incremental.merge_partitions(partitioned, updates, ["k"], ["day"]), "v")
    assert first == again and files(partitioned, spark) == before
    assert [r["day"] for r in again if r["k"] == 5] == [2]


def test_a_partition_without_rows_is_removed(spark, partitioned):
    moved = spark.range(40).where("id % 4 = 3").selectExpr("id AS k", "'moved' AS v", "CAST(9 AS int) AS day")
    after = incremental.merge_partitions(partitioned, moved, ["k"], ["day"])
    assert after.count() == 40 and set(files(partitioned, spark)) == {"day=0", "day=1", "day=2", "day=9"}


def test_a_refused_merge_writes_nothing(spark, partitioned):
    before = files(partitioned, spark)
    twice = spark.createDataFrame([(5, "a", 1), (5, "v5", 1)], "k long, v string, day int")
    with pytest.raises(ValueError, match="two updates"):
        incremental.merge_partitions(partitioned, twice, ["k"], ["day"])
    assert files(partitioned, spark) == before
    nothing = incremental.merge_partitions(partitioned, twice.limit(0), ["k"], ["day"])
    assert nothing.count() == 40 and files(partitioned, spark) == before


# -- changing schemas --------------------------------------------------------


def test_generations_refuse_what_does_not_fit(spark):
    schema = T.StructType().add("k", "long").add("v", "string")
    widened = incremental.as_schema(spark.createDataFrame([(1,)], "k int"), schema)
    assert widened.dtypes == [("k", "bigint"), ("v", "string")] and rows(widened) == [{"k": 1, "v": None}]
    with pytest.raises(ValueError, match="does not fit"):
        incremental.as_schema(spark.createDataFrame([("1",)], "k string"), schema)
    with pytest.raises(ValueError, match="does not hold"):
        incremental.as_schema(spark.createDataFrame([(1, 2)], "k int, other int"), schema)


def test_filters_reach_each_generation(spark):
    paths = [sinks.new_location(spark, f"g{i}") for i in (1, 2)]
    spark.range(10).selectExpr("CAST(id AS int) AS k").write.parquet(paths[0])
    spark.range(10, 20).selectExpr("id AS k", "'x' AS v").write.parquet(paths[1])
    schema = T.StructType().add("k", "long").add("v", "string")
    found = incremental.generations(spark, paths, schema).where("v = 'x' AND k > 15")
    assert found.count() == 4 and "EqualTo(v,x)" in found._jdf.queryExecution().executedPlan().toString()


# -- archives ----------------------------------------------------------------


def test_folders_of_other_months_are_pruned(spark, small):
    archive = incremental.archived(small.archives.values(), sinks.new_location(spark, "archives"), "target_date")
    result = mechanisms.mondays_of(archive, small)
    plan = plan_of(result)
    assert "dynamicpruning" in plan and incremental.MONTH in plan.split("PartitionFilters")[1][:80]
    assert same_rows(result, CATALOG["src04_partitioned_archives"].run(spark, SMALL))


# -- stages that report ------------------------------------------------------


def test_a_stage_is_written_and_profiled_in_one_job(spark):
    df = spark.createDataFrame([(1, None), (2, "b"), (None, "c")], "k int, v string")
    metrics = incremental.profile_metrics(["k", "v"])
    (stage, seen), jobs = jobs_of(spark, lambda: incremental.materialise_observed(df, "seen", metrics))
    assert seen == {"rows": 3, "k_nulls": 1, "v_nulls": 1} and jobs == 1
    assert same_rows(stage, df)
    empty = incremental.materialise_observed(df.limit(0), "empty", metrics)[1]
    assert empty == {"rows": 0, "k_nulls": 0, "v_nulls": 0}


# -- mergeable states --------------------------------------------------------


def archive(spark, entries):
    return spark.createDataFrame(
        [(g, datetime.date(2020, 1, 1) + datetime.timedelta(d), c) for g, d, c in entries],
        "product string, day date, customer bigint",
    )


def direct(entries, days):
    found = {}
    for g, d, c in entries:
        for later in range(days):
            if c is not None:
                found.setdefault((g, d + later), set()).add(c)
    return {k: len(v) for k, v in found.items()}


def counted(df):
    start = datetime.date(2020, 1, 1)
    return {(r["product"], (r["as_of"] - start).days): r["entities"] for r in df.collect()}


def test_rolling_counts_equal_direct_ones(spark):
    draw = random.Random(4)
    ids = [0, 1, -1, 32767, 32768, 32769, -32768, 2**40, None, *range(100, 140)]
    entries = [(draw.choice(["a", "b", None]), draw.randrange(20), draw.choice(ids)) for _ in range(600)]
    daily = states.daily_bitmaps(archive(spark, entries * 2), ["product"], "day", "customer")
    assert counted(states.rolling_count(daily, ["product"], "day", 7)) == direct(entries, 7)
    parts = [
        states.daily_bitmaps(archive(spark, part), ["product"], "day", "customer")
        for part in (entries[:200], entries[200:])
    ]
    merged = states.rolling_count(parts[0].unionByName(parts[1]), ["product"], "day", 7)
    assert counted(merged) == direct(entries, 7)


def test_bitmaps_of_ids_far_apart_stay_small_and_are_not_copied(spark):
    entries = [("a", d, c * 100_000) for d in range(3) for c in range(200)]
    dated = archive(spark, entries)
    daily = states.daily_bitmaps(dated.unionByName(dated.withColumn("day", F.lit(None))), ["product"], "day", "customer")
    assert byte_size(daily) <= 64 * daily.count()
    found = states.rolling_count(daily, ["product"], "day", 2)
    assert counted(found) == direct(entries, 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan.rsplit("Window", 1)[-1]


def test_sketches_stay_within_their_bound(spark):
    entries = [("a", d, c) for d in range(5) for c in range(d * 500, d * 500 + 2000)]
    daily = states.daily_sketches(archive(spark, entries), ["product"], "day", "customer")
    wanted = direct(entries, 3)
    for key, estimate in counted(states.rolling_estimate(daily, ["product"], "day", 3)).items():
        assert abs(estimate - wanted[key]) <= 5 * 1.04 / 64 * wanted[key]


def test_states_of_nothing_and_of_texts(spark):
    none = archive(spark, [])
    assert states.rolling_count(states.daily_bitmaps(none, ["product"], "day", "customer"), ["product"], "day").count() == 0
    with pytest.raises(ValueError, match="integers"):
        states.daily_bitmaps(none.withColumn("customer", F.lit("x")), ["product"], "day", "customer")


# -- quantiles ---------------------------------------------------------------


@pytest.mark.parametrize("most_left", [10, 200_000])
@pytest.mark.parametrize("spread", [3, 50, 100_000])
def test_quantiles_by_one_sketch(spark, spread, most_left):
    draw = random.Random(spread)
    values = [draw.randrange(spread) / 4 for _ in range(3000)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    shares = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]
    known = sorted(v for v in values if v is not None)
    found = {r["share"]: r["v"] for r in exact_quantiles(df, "v", shares, 200, most_left).collect()}
    assert found == {s: known[max(1, -int(-s * 3000 // 1)) - 1] for s in shares}


def test_quantiles_take_as_many_jobs_for_any_number_of_shares(spark):
    df = sinks.materialise(spark.range(5000).selectExpr("CAST(id AS double) AS v"), "values")
    counts = [
        jobs_of(spark, lambda s=shares: exact_quantiles(df, "v", s).collect())[1]
        for shares in ([0.5], [i / 20 for i in range(21)])
    ]
    assert counts[0] == counts[1]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, "v", [0.5]).collect() == []
    with pytest.raises(ValueError):
        exact_quantiles(df, "v", [])


# -- running totals ----------------------------------------------------------


def random_periods(spark, seed, count=200):
    draw = random.Random(seed)
    start = datetime.date(2020, 1, 1)
    rows_ = {
        (draw.randrange(12), start.replace(month=1 + draw.randrange(6)), draw.choice(["control", "treatment"])): 0
        for _ in range(count)
    }
    return [(c, p, v, draw.randrange(100), draw.randrange(-5, 50)) for c, p, v in rows_]


def frame(spark, rows_):
    return spark.createDataFrame(rows_, "customer_id long, period date, variant string, a long, b long")


def test_state_equals_the_full_recomputation_after_every_batch(spark):
    entries = random_periods(spark, 1)
    by_month = [[e for e in entries if e[1].month == m] for m in range(1, 7)]
    late = [(c, p, v, 7, 1) for c, p, v, _, _ in by_month[1][:4]] + [(99, by_month[2][0][1], "control", 1, 1)]
    batches = [by_month[0] + by_month[1], by_month[2], by_month[3], late, [], by_month[4] + by_month[5]]
    state = RunningTotals(spark, sinks.new_location(spark, "running"), ["a", "b"])
    seen = []
    for number, batch in enumerate(batches):
        found = state.advance(frame(spark, batch), number)
        seen += batch
        sums = frame(spark, seen).groupBy("customer_id", "period", "variant").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        assert same_rows(found, with_running_totals(sums, ["a", "b"]))


def test_a_batch_that_runs_twice_counts_once(spark):
    entries = random_periods(spark, 2)
    state = RunningTotals(spark, sinks.new_location(spark, "running"), ["a", "b"])
    state.advance(frame(spark, entries[:40]), 0)
    once = rows(state.advance(frame(spark, entries[40:]), 1), "customer_id", "period", "variant")
    again = rows(state.advance(frame(spark, entries[40:]), 1), "customer_id", "period", "variant")
    assert once == again


def test_a_new_period_leaves_earlier_ones_alone(spark):
    entries = random_periods(spark, 3)
    path = sinks.new_location(spark, "running")
    state = RunningTotals(spark, path, ["a", "b"])
    state.advance(frame(spark, [e for e in entries if e[1].month < 6]), 0)
    before = files(f"{path}/running", spark)
    state.advance(frame(spark, [e for e in entries if e[1].month == 6]), 1)
    after = files(f"{path}/running", spark)
    assert all(after[folder] == names for folder, names in before.items()) and len(after) == len(before) + 1


def rows_made(spark, df):
    """The frame, and an accumulator of the rows computed for it."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def passed(value):
        made.add(1)
        return value

    return df.withColumn("customer_id", passed("customer_id")), made


def test_a_batch_is_computed_once(spark):
    entries = random_periods(spark, 5)
    state = RunningTotals(spark, sinks.new_location(spark, "running"), ["a", "b"])
    for number, batch in enumerate((entries[:40], entries[40:])):
        periods, made = rows_made(spark, frame(spark, batch))
        found = state.advance(periods, number)
        assert made.value == len(batch)
    sums = frame(spark, entries).groupBy("customer_id", "period", "variant").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    assert same_rows(found, with_running_totals(sums, ["a", "b"]))


def test_the_batches_of_the_query_are_computed_once(spark, small, monkeypatch):
    wanted = uplift.upl05_cumulative(small)
    periods, made = rows_made(spark, uplift._periods(small))
    monkeypatch.setattr(uplift, "_periods", lambda t: periods)
    assert same_rows(uplift.upl05_running_state(small), wanted)
    assert made.value == wanted.count()


def test_a_state_without_batches(spark):
    state = RunningTotals(spark, sinks.new_location(spark, "running"), ["a", "b"])
    with pytest.raises(ValueError, match="no batch"):
        state.running()
    assert state.advance(frame(spark, []), 0).count() == 0


# -- named windows -----------------------------------------------------------


def test_named_window_and_aggregate_agree_and_differ_in_plan(spark):
    window, folded = (CATALOG[name].run(spark, SMALL) for name in ("win02_named_window", "win02_first_value"))
    assert same_rows(window, folded)
    plans = [df._jdf.queryExecution().toString() for df in (window, folded)]
    assert "first_value" in plans[0].lower() and "WindowSpecDefinition" not in plans[1] and "min_by" in plans[1]
