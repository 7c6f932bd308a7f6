import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortry.operators import experiment as exp
from tests.support import one, rows, same_rows

DAY = dt.date(2020, 1, 1)


RULES = (("first_flag", "first"), ("second_flag", "second"), ("third_flag", "third"))


@pytest.fixture()
def bills(spark):
    return spark.createDataFrame(
        [
            # account, due, index, computable, default, balance
            (1, DAY, 0, True, True, 100.0),
            (1, DAY + dt.timedelta(1), 0, True, False, 300.0),
            (2, DAY, 0, True, None, 50.0),
            (3, DAY, 0, True, False, 400.0),
            (3, DAY, 1, True, True, 999.0),  # other index
            (4, DAY, 0, False, True, 999.0),  # not observable
            (4, DAY, 0, None, True, 999.0),
            (5, DAY, 0, True, True, -1.0),  # overpaid
            (5, DAY - dt.timedelta(1), 0, True, True, 999.0),  # before the period
            (6, DAY + dt.timedelta(30), 0, True, True, 10.0),  # last day counts
            (9, DAY, 0, True, True, 999.0),  # account unknown
        ],
        "account_id int, due_date date, bills_after_score int, computable_default boolean, "
        "defaults_now boolean, balance double",
    )


@pytest.fixture()
def flags(spark):
    return spark.createDataFrame(
        [
            (1, "a", True, True, None),
            (2, "a", None, True, False),
            (3, "b", False, None, None),
            (4, "b", False, False, True),
            (5, "b", False, False, True),
            (6, "c", False, False, True),
        ],
        "account_id int, customer_id string, first_flag boolean, second_flag boolean, "
        "third_flag boolean",
    )


def test_population_and_tags(bills, flags):
    base = exp.with_priority_tag(
        exp.base_population(bills, flags, "2020-01-01", "2020-01-31"), RULES
    )
    found = [(r["account_id"], r["balance"], r["account_tag"]) for r in rows(base, "account_id", "balance")]
    assert found == [
        (1, 100.0, "first"),
        (1, 300.0, "first"),
        (2, 50.0, "second"),
        (3, 400.0, "other"),
        (6, 10.0, "third"),
    ]
    assert [r["flag_count"] for r in rows(exp.overlapping_flags(base, RULES))] == [2, 2]


def test_scope_drops_excluded_and_null_segments(spark):
    assigned = spark.createDataFrame(
        [("a", "control", "s"), ("b", "control", "x"), ("c", "control", None)],
        "customer_id string, variant string, segment string",
    )
    assert [r["customer_id"] for r in rows(exp.in_scope(assigned, "x"))] == ["a"]
    assert exp.in_scope(assigned, None).count() == 3


def test_group_metrics_by_hand(spark):
    df = spark.createDataFrame(
        [
            ("a", "s", True, 100.0),
            ("a", "s", False, 300.0),
            ("b", "s", False, 200.0),
            ("c", "s", None, 50.0),
        ],
        "customer_id string, segment string, defaults_now boolean, balance double",
    )
    m = one(exp.group_metrics(df, ["segment"]))
    assert (m["unique_customers"], m["unique_defaulted_customers"]) == (3, 1)
    assert (m["total_outstanding_balance"], m["total_balance"]) == (100.0, 650.0)
    bad, all_ = [100.0, 0.0, 0.0], [400.0, 200.0, 50.0]
    mb, ma = sum(bad) / 3, sum(all_) / 3
    sd = lambda v, m_: math.sqrt(sum((x - m_) ** 2 for x in v) / 2)
    assert m["stddev_outstanding_balance_per_client"] == pytest.approx(sd(bad, mb))
    assert m["stddev_total_balance_per_client"] == pytest.approx(sd(all_, ma))
    cov = sum((x - mb) * (y - ma) for x, y in zip(bad, all_)) / 2
    assert m["cov_outstanding_total_per_client"] == pytest.approx(cov)
    assert m["balance_risk_ratio"] == pytest.approx(100 / 650)


def test_folded_path_equals_row_path(spark, bills, flags):
    """Also when customers have several assignment rows."""
    assigned = spark.createDataFrame(
        [
            ("a", "control", "s"),
            ("a", "control", "s"),
            ("a", "treatment", "s"),
            ("b", "treatment", "s"),
            ("c", "treatment", "r"),
        ],
        "customer_id string, variant string, segment string",
    )
    base = exp.with_priority_tag(
        exp.base_population(bills, flags, "2020-01-01", "2020-01-31"), RULES
    )
    accounts = exp.with_priority_tag(
        exp.with_account(
            exp.folded_bills(exp.eligible_bills(bills, "2020-01-01", "2020-01-31")), flags
        ),
        RULES,
    )
    sizes = exp.holdout_sizes(assigned)
    for extra in ([], [exp.TAG]):
        by_rows = exp.with_unit_rate(
            exp.group_metrics(
                exp.attach_assignment(base, assigned, None), ["segment", "variant", *extra]
            ),
            sizes,
        )
        assert same_rows(exp.cell_metrics(accounts, assigned, None, extra), by_rows)


ARM_SCHEMA = "cell string, variant string, value double, n long, sd double"


def _sig(spark, data, kind="mean", **more):
    df = spark.createDataFrame(data, ARM_SCHEMA)
    metric = exp.Metric("m", "value", "n", kind, stddev="sd", **more)
    return {
        (r["cell"], r["variant"]): r for r in rows(exp.with_significance(df, metric, ["cell"]))
    }


def test_mean_by_hand(spark):
    got = _sig(spark, [("x", "control", 10.0, 25, 5.0), ("x", "treatment", 14.0, 16, 4.0)])
    t = got["x", "treatment"]
    margin = 1.96 * math.sqrt(5**2 / 25 + 4**2 / 16)
    assert t["margin_abs_m"] == pytest.approx(margin)
    assert t["delta_abs_m"] == pytest.approx(4.0)
    assert t["delta_relative_m"] == pytest.approx(0.4)
    assert t["margin_relative_m"] == pytest.approx(margin / 10)
    assert t["IC_lower_abs_m"] == pytest.approx(4 - margin)
    assert t["IC_upper_rel_m"] == pytest.approx((4 + margin) / 10)
    assert t["m_stat_sig"] == "stat-sig"
    c = got["x", "control"]
    assert c["delta_abs_m"] == 0.0 and c["m_stat_sig"] == "non-stat-sig"


def test_sum_and_proportion_by_hand(spark):
    data = [("x", "control", 100.0, 4, 3.0), ("x", "treatment", 90.0, 9, 2.0)]
    got = _sig(spark, data, "sum")["x", "treatment"]
    assert got["margin_abs_m"] == pytest.approx(1.96 * math.sqrt(4 * 9 + 9 * 4))
    data = [("x", "control", 0.2, 100, None), ("x", "treatment", 0.5, 50, None)]
    got = _sig(spark, data, "proportion")["x", "treatment"]
    assert got["margin_abs_m"] == pytest.approx(1.96 * math.sqrt(0.2 * 0.8 / 100 + 0.25 / 50))


def test_ratio_by_hand(spark):
    df = spark.createDataFrame(
        [
            ("x", "control", 0.5, 10, 200.0, 3.0, 5.0, 7.0),
            ("x", "treatment", 0.4, 20, 500.0, 2.0, 6.0, 4.0),
        ],
        "cell string, variant string, r double, n long, den double, sn double, sd double, cov double",
    )
    metric = exp.Metric(
        "m", "r", "n", "ratio", denominator="den", stddev_numerator="sn",
        stddev_denominator="sd", covariance="cov",
    )
    got = {r["variant"]: r for r in rows(exp.with_significance(df, metric, ["cell"]))}

    def se(r, n, den, sn, sd, cov):
        return math.sqrt(n * sn**2 + r * r * n * sd**2 - 2 * r * n * cov) / den

    expected = 1.96 * math.hypot(se(0.5, 10, 200, 3, 5, 7), se(0.4, 20, 500, 2, 6, 4))
    assert got["treatment"]["margin_abs_m"] == pytest.approx(expected)


def test_ratio_cancellation_is_zero_and_missing_spread_is_null(spark):
    schema = "cell string, variant string, r double, n long, den double, sn double, sd double, cov double"
    metric = exp.Metric(
        "m", "r", "n", "ratio", denominator="den", stddev_numerator="sn",
        stddev_denominator="sd", covariance="cov",
    )
    # sn = r * sd and cov = sn * sd, pushed a little below zero.
    df = spark.createDataFrame(
        [("x", "control", 0.5, 10, 200.0, 1.0, 2.0, 2.0000001),
         ("x", "treatment", 0.5, 10, 200.0, 1.0, 2.0, 2.0000001),
         ("y", "control", 0.5, 1, 200.0, None, None, None),
         ("y", "treatment", 0.5, 1, 200.0, None, None, None)],
        schema,
    )
    got = {(r["cell"], r["variant"]): r for r in rows(exp.with_significance(df, metric, ["cell"]))}
    assert got["x", "treatment"]["margin_abs_m"] == 0.0
    assert got["y", "treatment"]["margin_abs_m"] is None
    assert got["y", "treatment"]["m_stat_sig"] == "non-stat-sig"


def test_missing_and_zero_control(spark):
    got = _sig(
        spark,
        [
            ("none", "treatment", 5.0, 10, 1.0),
            ("zero", "control", 0.0, 10, 1.0),
            ("zero", "treatment", 5.0, 10, 1.0),
        ],
    )
    alone = got["none", "treatment"]
    assert alone["delta_abs_m"] is None and alone["m_stat_sig"] == "non-stat-sig"
    zero = got["zero", "treatment"]
    assert zero["delta_relative_m"] is None and zero["IC_upper_rel_m"] is None
    assert zero["delta_abs_m"] == 5.0 and zero["m_stat_sig"] == "stat-sig"


def test_unknown_kind(spark):
    with pytest.raises(ValueError):
        exp.Metric("m", "value", "n", "median").variance()


def test_side_by_side_keeps_cells_without_control(spark, small):
    from cohortry.catalog.experiment import cell_metrics

    metrics = cell_metrics(small).filter(
        (F.col("segment") != "BUILDING") | (F.col("variant") != "control")
    )
    slim = exp.side_by_side(exp.default_rate_significance(metrics, ["segment"]), ["segment"])
    got = {r["segment"]: r for r in rows(slim)}
    assert got["BUILDING"]["unit_risk_rate_control"] is None
    assert got["BUILDING"]["unit_risk_rate_treatment"] is not None
    assert got["FURNITURE"]["unit_risk_rate_control"] is not None


def test_an_account_of_two_customers_counts_once(spark):
    accounts = spark.createDataFrame(
        [("s", 1, 10, 3, 1), ("s", 2, 10, 2, 0), ("s", 2, 11, 1, 0), ("r", 3, None, 1, 0)],
        "segment string, customer_id long, account_id long, bills long, had_default int",
    )
    found = {r["segment"]: r.asDict() for r in exp.funnel(accounts).collect()}
    assert found["s"]["unique_accounts"] == 2 and found["r"]["unique_accounts"] == 0
    assert (found["s"]["total_rows"], found["s"]["unique_customers"]) == (6, 2)
    assert found["s"]["unique_customers_defaulted"] == 1
