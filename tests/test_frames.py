import datetime as dt
import math

import pytest

from cohortry.catalog.uplift import periodic_uplift
from cohortry.operators import frames as frm
from tests.support import one, rows


@pytest.fixture()
def uplift(spark):
    d1, d2 = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    return spark.createDataFrame(
        [
            (d1, "t", 4, 9, 10.0, 8.0, 2.0, 3.0, 2.0, 20.0, 3.0, -2.0, 1.0),
            (d2, "t", 4, 9, 10.0, 9.0, 2.0, 3.0, 1.0, 10.0, -1.0, -1.0, 3.0),
        ],
        "period date, variant string, n_t long, n_c long, avg_t double, avg_c double, std_t double, "
        "std_c double, uplift double, uplift_pct double, uplift_a double, uplift_b double, uplift_c double",
    )


def test_bands(uplift):
    got = rows(frm.arm_bands(uplift), "period", "arm")
    assert got[0]["arm"] == "control" and got[0]["lower"] == pytest.approx(8 - 1.96 * 3 / 3)
    assert got[1]["upper"] == pytest.approx(10 + 1.96 * 2 / math.sqrt(4))


def test_long_and_stacking(uplift):
    assert frm.contribution_columns(uplift) == ["uplift_a", "uplift_b", "uplift_c"]
    stacked = frm.stacked_contributions(frm.contributions_long(uplift), ["a", "b", "c"])
    got = [(str(r["period"]), r["product"], r["base"], r["top"]) for r in rows(stacked, "period", "product")]
    assert got == [
        ("2020-01-01", "a", 0.0, 3.0),
        ("2020-01-01", "b", 0.0, -2.0),
        ("2020-01-01", "c", 3.0, 4.0),
        ("2020-02-01", "a", 0.0, -1.0),
        ("2020-02-01", "b", -1.0, -2.0),
        ("2020-02-01", "c", 0.0, 3.0),
    ]


def test_matrix_has_a_total_row(uplift):
    got = {r["product"]: r for r in rows(frm.contribution_matrix(uplift, "t", ["2020-01-01", "2020-02-01"]))}
    assert set(got) == {"a", "b", "c", "Total"}
    assert got["Total"]["2020-01-01"] == 2.0 and got["b"]["2020-02-01"] == -1.0


def test_grain(spark, uplift):
    assert one(frm.grain_of(uplift)) == {"periods": 2, "avg_gap_days": 31.0, "grain": "month"}
    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (1, 1, 2, 4)], "period date")
    assert one(frm.grain_of(days))["grain"] == "day"
    assert one(frm.grain_of(days.limit(1)))["grain"] == "month"


def test_matrix_refuses_a_period_outside(small):
    uplift = periodic_uplift(small)
    periods = frm.months_between("1998-01-15", "2001-08-01")
    assert periods[0] == "1998-01-01" and periods[-1] == "2001-08-01" and len(periods) == 44
    assert frm.contribution_matrix(uplift, "treatment", periods).count() > 1
    with pytest.raises(Exception, match="outside the matrix"):
        frm.contribution_matrix(uplift, "treatment", periods[:24]).collect()
