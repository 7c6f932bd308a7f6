"""Every registered query against its SQL, and what no plan may contain."""

import pytest

import __spark_entry__ as entry_module
from cohortry.catalog import CATALOG
from tests.compare import connect, difference
from tests.conftest import SMALL

WITHOUT_SQL: set[str] = set()


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_sql(spark, connection, name):
    item = CATALOG[name]
    result = item.run(spark, SMALL)
    sql = item.oracle()
    if sql is None:
        assert name in WITHOUT_SQL
        assert result.count() > 0
    else:
        assert difference(result, connection, sql) is None


def test_entry_contract(spark):
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    assert set(CATALOG) - set(oracles) == WITHOUT_SQL
    assert set(CATALOG) <= set(queries)
    assert set(oracles) <= set(queries)
    flagship = entry_module.entry(spark)
    assert flagship.columns and flagship.count() > 0


def test_counts_do_not_copy_rows(spark):
    """Several distinct counts in one aggregation would expand every row."""
    for name in ("exp16_funnel", "exp17_bills_per_customer", "act03_monthly_volume", "act04_by_author",
                 "act09_monthly_outputs", "act10_outputs_to_date"):
        plan = CATALOG[name].run(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in plan, name


def test_pre_period_reads_only_its_orders(spark):
    """Line items are reduced to the orders of the period before they are folded."""
    result = CATALOG["upl13_pre_period_balance"].run(spark, SMALL)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_plans_hold_no_cross_join_and_no_python(spark):
    """Also with broadcasting off, as it is for sides too large to send."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, item in CATALOG.items():
            if name.startswith("snk"):
                continue
            result = item.run(spark, SMALL)
            plan = result._jdf.queryExecution().executedPlan().toString()
            for forbidden in ("CartesianProduct", "NestedLoop", "Python", "Pandas"):
                assert forbidden not in plan, (name, forbidden)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
