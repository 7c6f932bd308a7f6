"""Registered queries against their SQL, and all of them on real tables."""

import pytest

import __spark_entry__ as entry_module
from cohortry.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, SMALL), connection, ORACLES[name]) is None


def test_entry_holds_every_query():
    assert set(QUERIES) <= set(entry_module.queries())
    assert set(ORACLES) <= set(entry_module.oracle_sql())
    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} == {n.split("_")[0] for n in QUERIES}


@pytest.mark.parametrize(
    "name",
    ["op2_toxicity", "op3_quality", "op7_personal_data", "op10_near_duplicates", "op11_alignment", "op12_token_counts"],
)
def test_one_row_per_document(spark, name):
    documents = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert QUERIES[name](spark, SMALL).count() == documents.count()


def test_native_plan_holds_no_python(spark):
    result = QUERIES["op5_decontamination"](spark, SMALL)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
