import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cohortry.catalog import offers as q
from cohortry.operators import offers as off
from tests.support import rows, same_rows

CONTRACT = (
    "contract_id int, customer_id string, is_renegotiation boolean, is_valid_loan boolean, "
    "line string, program string, created_at_date date, principal double, "
    "interest_rate double, installments int"
)


RULES = (("line", "b", "backed"), ("program", "private", "private"), ("program", "social", "social"))


def test_recent_contracts(spark):
    late, edge, old = dt.date(2020, 5, 1), dt.date(2019, 6, 1), dt.date(2019, 5, 31)
    df = spark.createDataFrame(
        [
            (1, "a", False, True, "b", "private", late, 100.0, 0.1, 2),
            (2, "a", False, True, "x", "social", edge, 100.0, 0.1, 2),
            (3, "a", False, True, "x", "private", old, 100.0, 0.1, 2),
            (4, "a", True, True, "x", "private", late, 100.0, 0.1, 2),
            (5, "a", False, False, "x", "private", late, 100.0, 0.1, 2),
            (6, "a", False, True, "x", "unknown", late, 100.0, 0.1, 2),
            (7, "a", None, True, "x", "private", late, 100.0, 0.1, 2),
        ],
        CONTRACT,
    )
    got = rows(off.recent_contracts(df, "2020-06-01", RULES, 12), "contract_id")
    assert [(r["contract_id"], r["product_type"]) for r in got] == [(1, "backed"), (2, "social")]
    assert got[0]["total_debt_cost"] == 121.0


def _union_form(t):
    """Eligibility as five branches over the base, one join each."""
    base = q.base(t)

    def branch(product, source, flag):
        rates = source.filter("eligible").select("customer_id", "rate", "cap")
        return base.filter(flag).join(rates, "customer_id").select(
            "customer_id",
            F.lit(product).alias("product_type"),
            F.col("rate").alias("offered_rate"),
            F.col("cap").alias("max_eligible_amount"),
        )

    personal = base.filter("personal_eligible").select(
        "customer_id",
        F.lit("personal").alias("product_type"),
        F.col("personal_rate").alias("offered_rate"),
        F.col("personal_cap").alias("max_eligible_amount"),
    )
    return (
        personal.unionByName(branch("backed", t.backed_rates, "backed_eligible"))
        .unionByName(branch("social", t.public_rates, "social_eligible"))
        .unionByName(branch("agreements", t.public_rates, "agreements_eligible"))
        .unionByName(branch("private", t.private_rates, "private_eligible"))
    )


def test_one_pass_eligibility_equals_union(small):
    assert same_rows(q.eligibility(small), _union_form(small), 9)


def test_eligibility_needs_both_flag_and_rate(spark):
    monitoring = spark.createDataFrame(
        [("a", True, 0.1, 10.0, True, False, None, True), ("b", None, 0.1, 10.0, True, True, True, None)],
        "customer_id string, personal_eligible boolean, personal_rate double, personal_cap double, "
        "backed_eligible boolean, provider_social boolean, provider_x boolean, private_eligible boolean",
    )
    schema = "customer_id string, eligible boolean, rate double, cap double"
    backed = spark.createDataFrame([("a", False, 0.2, 5.0), ("b", True, 0.2, 5.0)], schema)
    public = spark.createDataFrame([("b", True, 0.3, 6.0)], schema)
    private = spark.createDataFrame([("b", True, 0.4, 7.0)], schema)
    base = off.monitoring_base(monitoring, "provider_", "provider_social")
    got = rows(off.unified_eligibility(base, backed, public, private), "customer_id", "product_type")
    assert [(r["customer_id"], r["product_type"]) for r in got] == [
        ("a", "personal"),
        ("b", "agreements"),
        ("b", "backed"),
        ("b", "social"),
    ]
    with pytest.raises(ValueError):
        off.monitoring_base(monitoring.drop("provider_x"), "provider_", "provider_social")


def test_suboptimal_against_brute_force(small):
    contracts = rows(q.recent(small))
    offers = rows(q.eligibility(small))
    expected = set()
    for c in contracts:
        for e in offers:
            if e["customer_id"] != c["customer_id"] or e["product_type"] == c["product_type"]:
                continue
            cost = c["principal_amount"] * (1 + e["offered_rate"]) ** c["num_installments"]
            if (
                e["max_eligible_amount"] >= c["principal_amount"]
                and e["offered_rate"] < c["interest_rate_monthly"]
                and c["total_debt_cost"] / cost >= 1.15
            ):
                expected.add((c["contract_id"], e["product_type"], round(c["total_debt_cost"] - cost, 2)))
    got = {
        (r["contract_id"], r["alternative_product"], round(r["saving"], 2))
        for r in rows(q.suboptimal(small))
    }
    assert got and got == expected


def test_best_alternative_ties(spark):
    d1, d2 = dt.date(2020, 1, 1), dt.date(2020, 2, 1)
    df = spark.createDataFrame(
        [
            (1, "a", "p", "z", 0.1, 10.0, 0.2, d1),
            (2, "a", "p", "y", 0.1, 10.0, 0.2, d2),  # later date wins
            (3, "a", "p", "x", 0.1, 10.0, 0.2, d2),  # then the product name
            (5, "b", "p", "x", 0.1, 5.0, 0.2, d1),
            (4, "b", "q", "x", 0.1, 5.0, 0.2, d1),  # then the contract
        ],
        "contract_id int, customer_id string, contracted_product string, alternative_product string, "
        "alternative_rate double, saving double, saving_pct double, contract_date date",
    )
    got = rows(off.best_alternative(df), "customer_id")
    assert [(r["customer_id"], r["best_alternative_product"], r["contracted_product"]) for r in got] == [
        ("a", "x", "p"),
        ("b", "x", "q"),
    ]


def test_mean_rounds_half_up_exactly(spark):
    df = spark.createDataFrame([("s", "b", 0.01, 0.1), ("s", "b", 0.02, 0.1)],
                               "contracted_product string, best_alternative_product string, max_saving double, max_saving_pct double")
    assert rows(off.segment_summary(df))[0]["avg_saving"] == 0.02


@pytest.mark.parametrize("distinct", [1, 7, 40_000])
def test_quartiles_are_exact(spark, distinct):
    """Also with far more distinct values than one approximate pass can tell apart."""
    number = F.col("id")
    value = ((number * 7919 + 13) % distinct).cast("double") / 100
    frame = spark.range(60_001).select(F.when(number % 5 == 0, 1.25).otherwise(value).alias("saving"))
    values = sorted(r["saving"] for r in frame.collect())

    def at(share):
        return round(values[max(1, math.ceil(share * len(values))) - 1], 2)

    (got,) = rows(off.savings_quartiles(frame))
    assert (got["p25_saving"], got["median_saving"], got["p75_saving"]) == (at(0.25), at(0.5), at(0.75))
    assert got["mean_saving"] == pytest.approx(sum(values) / len(values), abs=0.006)


def test_quartiles_of_nothing(spark):
    (got,) = rows(off.savings_quartiles(spark.createDataFrame([(None,)], "saving double")))
    assert set(got.values()) == {None}
