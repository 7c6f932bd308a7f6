"""A third of the rows on one key, with no side small enough to broadcast."""

import contextlib

import pytest
from pyspark.sql import functions as F

from cohortry.catalog import CATALOG
from cohortry.catalog.uplift import TOTAL
from cohortry.operators import experiment as exp
from cohortry.operators import offers as off
from cohortry.operators import uplift as up
from cohortry.sources.standins import BILL_END, BILL_START, ROLLOUT
from tests.support import one, rows, same_rows

N = 120_000
# Thresholds scaled down with the data, so that AQE sees the skew.
SCALED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1KB",
    "spark.sql.shuffle.partitions": "16",
}


@contextlib.contextmanager
def settings(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def executed_plan(df):
    """The plan as it ran, after adaptive changes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def hot_contracts(spark):
    number = F.col("id")
    return spark.range(0, N, 1, 12).select(
        number.alias("contract_id"),
        F.when(number % 3 == 0, F.lit(-1)).otherwise(number % 5000).alias("customer_id"),
        F.lit("personal").alias("product_type"),
        (F.lit(1000.0) + number % 977).alias("principal_amount"),
        F.lit(0.05).alias("interest_rate_monthly"),
        F.lit(12).alias("num_installments"),
        F.date_add(F.lit("2020-01-01").cast("date"), (number % 300).cast("int")).alias("contract_date"),
        F.round((F.lit(1000.0) + number % 977) * F.pow(F.lit(1.05), F.lit(12)), 2).alias("total_debt_cost"),
    )


@pytest.fixture()
def offers(spark):
    return spark.range(-1, 5000, 1, 4).select(
        F.col("id").alias("customer_id"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(p).alias("product_type"),
                        F.lit(r).alias("offered_rate"),
                        F.lit(1e6).alias("max_eligible_amount"),
                    )
                    for p, r in (("backed", 0.01), ("social", 0.02), ("personal", 0.001))
                ]
            )
        ),
    )


def test_hot_customer_is_split_before_the_best_offer(spark, hot_contracts, offers):
    expected = off.best_alternative(off.suboptimal_contracts(hot_contracts, offers))
    with settings(spark, SCALED):
        best = off.best_alternative(off.suboptimal_contracts(hot_contracts, offers))
        plan = executed_plan(best)
        assert "skew=true" in plan
        # Each task keeps its best row per customer before the exchange.
        assert plan.count("WindowGroupLimit") >= 2
        assert same_rows(best, expected)
    hot = one(best.filter("customer_id = -1"))
    assert hot["best_alternative_product"] == "backed"


def test_hot_account_and_customer_fold_before_the_joins(spark):
    number = F.col("id")
    bills = spark.range(0, N, 1, 12).select(
        F.when(number % 3 == 0, F.lit(-1)).otherwise(number % 9000).alias("account_id"),
        F.lit(BILL_START).cast("date").alias("due_date"),
        F.lit(0).alias("bills_after_score"),
        F.lit(True).alias("computable_default"),
        (number % 7 == 0).alias("defaults_now"),
        (number % 100 + 1).cast("double").alias("balance"),
    )
    flags = spark.range(-1, 9000, 1, 4).select(
        number.alias("account_id"),
        F.when(number % 3 == 1, F.lit(-5)).otherwise(number).alias("customer_id"),
    )
    eligible = exp.eligible_bills(bills, BILL_START, BILL_END)
    assigned = flags.select(
        "customer_id", F.lit("s").alias("segment"), F.lit("control").alias("variant")
    ).distinct()
    with settings(spark, SCALED):
        accounts = exp.with_account(exp.folded_bills(eligible), flags)
        # The join carries one row per account, however many bills it has.
        assert accounts.count() == 6001
        got = one(exp.cell_metrics(accounts, assigned, None))
    total = sum(i % 100 + 1 for i in range(N))
    assert got["total_balance"] == float(total)
    # Accounts 2, 5, 8... are their own customers; 1, 4, 7... share one.
    assert got["unique_customers"] == 3002


def test_hot_customer_facts_reach_the_exposure_join_once_per_date(spark):
    number = F.col("id")
    facts = spark.range(0, N, 1, 12).select(
        F.when(number % 3 == 0, F.lit(-1)).otherwise(number % 5000).alias("customer_id"),
        F.date_add(F.lit("2020-01-01").cast("date"), (number % 60).cast("int")).alias("date"),
        F.lit(1.0).alias("total"),
    )
    exposure = facts.select(
        "customer_id",
        F.when(F.col("customer_id") % 2 == 0, "control").otherwise("treatment").alias("variant"),
        F.lit("2020-01-01").cast("date").alias("exposition_date"),
    ).distinct()
    daily = up.daily_totals(facts, {"m": "total"})
    assert one(daily.filter("customer_id = -1").agg(F.count("*").alias("n")))["n"] <= 60
    with settings(spark, SCALED):
        periods = up.with_running_totals(
            up.customer_periods(facts, exposure, {"m": "total"}, "2020-01-01", grain="month"), ["m"]
        )
        hot = rows(periods.filter("customer_id = -1"), "period")
    assert [r["cum_m"] for r in hot][-1] == float(len(range(0, N, 3)))


def test_filters_and_columns_reach_the_scan(spark, small):
    def scan(df):
        with settings(spark, {"spark.sql.maxMetadataStringLength": "2000"}):
            return df._jdf.queryExecution().executedPlan().toString()

    plan = scan(exp.eligible_bills(small.bills, BILL_START, BILL_END, 1))
    pushed = plan[plan.index("PushedFilters") :]
    for part in (
        "EqualTo(l_linenumber,1)",
        "GreaterThanOrEqual(l_shipdate,1996-01-01",
        "GreaterThan(l_extendedprice,0.0)",
    ):
        assert part in pushed, part
    assert "l_comment" not in plan and "l_partkey" not in plan
    plan = scan(small.cut_list)
    assert "GreaterThan(o_totalprice,450000.0)" in plan
    assert "ReadSchema: struct<o_custkey:bigint,o_totalprice:double>" in plan


def test_both_levels_of_the_share_start_from_the_written_clients(spark, small):
    plan = executed_plan(CATALOG["exp14_contribution_share"].build(small))
    assert "clients-" in plan and "lineitem.parquet" not in plan


def test_running_totals_are_left_out_where_only_periods_are_read(spark, small):
    frames = up.metric_uplift(small.exposure, small.facts_between(ROLLOUT), TOTAL, ROLLOUT, grain="month")
    assert "cum_" not in executed_plan(frames.periodic_uplift)
    assert "cum_" in executed_plan(frames.cumulative_uplift)
