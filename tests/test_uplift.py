import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortry.operators import uplift as up
from cohortry.sources.standins import BRANCHES, ROLLOUT
from tests.support import rows, same_rows


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture()
def exposure(spark):
    return spark.createDataFrame(
        [
            ("a", "control", day("2020-01-05")),
            ("a", "control", day("2020-03-01")),
            ("b", "treatment", day("2020-01-01")),
            ("c", "treatment", day("2019-12-01")),  # before roll-out: not exposed
            ("d", "other", day("2020-01-01")),
            ("d", "treatment", day("2020-02-01")),  # in two arms
            ("e", None, day("2020-01-01")),
        ],
        "customer_id string, variant string, exposition_date date",
    )


@pytest.fixture()
def facts(spark):
    return spark.createDataFrame(
        [
            ("a", day("2020-01-01"), 99.0, 1.0),  # before its exposure
            ("a", day("2020-01-05"), 10.0, 2.0),  # exposure day counts
            ("a", day("2020-03-10"), 20.0, None),
            ("b", day("2020-01-20"), 5.0, 5.0),
            ("b", day("2020-01-20"), 6.0, 1.0),
            ("b", day("2020-02-20"), 7.0, 0.0),
            ("c", day("2020-01-20"), 1000.0, 0.0),
            ("d", day("2020-02-10"), 3.0, 3.0),
            ("e", day("2020-01-10"), 4.0, 4.0),
        ],
        "customer_id string, date date, total double, part double",
    )


METRICS = {up.MAIN: "total", "p": "part"}


def test_customer_periods_and_running_totals(exposure, facts):
    periods = up.customer_periods(facts, exposure, METRICS, "2020-01-01", grain="month")
    running = up.with_running_totals(periods, list(METRICS))
    got = [
        (r["customer_id"], r["variant"], str(r["period"]), r["metric_total"], r["cum_metric_total"])
        for r in rows(running, "customer_id", "variant", "period")
    ]
    assert got == [
        ("a", "control", "2020-01-01", 10.0, 10.0),
        ("a", "control", "2020-03-01", 20.0, 30.0),  # nothing is filled for February
        ("b", "treatment", "2020-01-01", 11.0, 11.0),
        ("b", "treatment", "2020-02-01", 7.0, 18.0),
        ("d", "other", "2020-02-01", 3.0, 3.0),
        ("d", "treatment", "2020-02-01", 3.0, 3.0),
        ("e", None, "2020-01-01", 4.0, 4.0),
    ]


def test_end_date_is_inclusive(exposure, facts):
    periods = up.customer_periods(
        facts, exposure, METRICS, "2020-01-01", end="2020-02-10", grain="day"
    )
    assert {str(r["period"]) for r in rows(periods)} == {
        "2020-01-05", "2020-01-10", "2020-01-20", "2020-02-10",
    }


def test_uplift_by_hand_with_two_treatments(spark):
    stats = spark.createDataFrame(
        [
            (1, "control", 4, 10.0, 2.0),
            (1, "treatment", 9, 16.0, 3.0),
            (1, "other", 1, 8.0, None),
            (1, None, 5, 1.0, 1.0),
            (2, "treatment", 9, 16.0, 3.0),  # no control: dropped
            (3, "control", 4, 0.0, 2.0),
            (3, "treatment", 4, -2.0, 2.0),
        ],
        "period int, variant string, n_customers long, avg_metric double, std_metric double",
    )
    got = {(r["period"], r["variant"]): r for r in rows(up.stats_uplift(stats))}
    assert set(got) == {(1, "treatment"), (1, "other"), (3, "treatment")}
    t = got[1, "treatment"]
    se = math.sqrt(9 / 9 + 4 / 4)
    assert t["uplift"] == 6.0 and t["se_uplift"] == pytest.approx(se)
    assert t["uplift_pct"] == pytest.approx(60.0)
    assert t["ci_lower"] == pytest.approx(6 - 1.96 * se) and t["stat_sig"] == "YES"
    single = got[1, "other"]
    assert single["se_uplift"] is None and single["stat_sig"] == "NO"
    assert got[3, "treatment"]["uplift_pct"] is None


def test_window_pairing_equals_self_join(small):
    stats = up.period_stats(
        up.customer_periods(
            small.facts, small.exposure, {up.MAIN: "total"}, ROLLOUT, grain="month"
        )
    )
    control = stats.filter("variant = 'control'").select(
        "period",
        F.col("n_customers").alias("n_c"),
        F.col("avg_metric").alias("avg_c"),
        F.col("std_metric").alias("std_c"),
    )
    joined = (
        stats.filter("variant != 'control'")
        .join(control, "period")
        .withColumn("uplift", F.col("avg_metric") - F.col("avg_c"))
        .select("period", "variant", "n_c", "avg_c", "std_c", "uplift")
    )
    paired = up.stats_uplift(stats).select("period", "variant", "n_c", "avg_c", "std_c", "uplift")
    assert same_rows(paired, joined, 4)


def test_one_pass_equals_a_run_per_metric(small):
    stats = up.hierarchy_stats(small.exposure, small.facts, BRANCHES, ROLLOUT)
    wide = up.drill_down(up.hierarchy_uplift(stats), BRANCHES)
    columns = ["period", "variant", "n_t", "n_c", "uplift", "se_uplift", "stat_sig"]
    for branch in BRANCHES[:2]:
        frames = up.metric_uplift(small.exposure, small.facts, branch, ROLLOUT, grain="month")
        for frame, alone in (
            ("periodic", frames.periodic_uplift),
            ("cumulative", frames.cumulative_uplift),
        ):
            main = wide.filter(
                (F.col("frame") == frame) & (F.col("branch") == branch.name) & (F.col("role") == "main")
            )
            assert same_rows(main.select(columns), alone.select(columns), 2)
            for alias in branch.parts:
                part = wide.filter(
                    (F.col("frame") == frame)
                    & (F.col("branch") == branch.name)
                    & (F.col("alias") == alias)
                    & (F.col("role") == "part")
                ).select("period", "variant", "uplift")
                contribution = alone.select(
                    "period", "variant", F.col(f"uplift_{alias}").alias("uplift")
                )
                assert same_rows(part, contribution, 2)


def test_multi_variant_and_sizes(exposure):
    multi = rows(up.multi_variant_customers(exposure))
    assert [(r["customer_id"], r["variants"]) for r in multi] == [("d", ["other", "treatment"])]
    sizes = {r["variant"]: r["n_customers"] for r in rows(up.variant_sizes(exposure))}
    assert sizes == {"control": 1, "treatment": 3, "other": 1, None: 1}


def test_additive_check_finds_a_gap(spark):
    facts = spark.createDataFrame(
        [("a", day("2020-01-01"), 8.0, 10.0, 2.0), ("a", day("2020-02-01"), 9.0, 10.0, 2.0)],
        "customer_id string, date date, total double, gross double, cost double",
    )
    branch = up.Branch("t", "total", {"gross": "gross", "cost": "cost"}, frozenset({"cost"}))
    got = {str(r["period"]): r["reconciled"] for r in rows(up.additive_check(facts, [branch]))}
    assert got == {"2020-01-01": True, "2020-02-01": False}


def test_pre_period_window_is_half_open(spark, exposure, facts):
    branch = up.Branch("t", "total", {"p": "part"})
    got = rows(up.pre_period_balance(exposure, facts, branch, "2020-01-01", "2020-01-20"))
    # a (control) has facts on the 1st and 5th, and no other arm does; e has no variant.
    assert got == []
    got = rows(up.pre_period_balance(exposure, facts, branch, "2020-01-01", "2020-03-01"))
    assert got == []


def test_unknown_grain_is_refused():
    with pytest.raises(ValueError, match="week"):
        up.period_of(F.col("date"), "week")
