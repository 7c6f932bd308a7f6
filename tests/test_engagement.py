import json

import pytest
from pyspark.sql import functions as F

from cohortry.catalog.engagement import CAMPAIGN_KEPT, normalised_comms
from cohortry.operators import engagement as eng
from cohortry.sources.standins import COMMS_SEGMENT
from tests.support import one, rows, same_rows


def ranking_text(campaigns):
    return json.dumps(
        [{"product": "p", "id": "j1", "score": 0.5,
          "narratives": [{"id": "n", "score": 1, "campaigns": campaigns}]}]
    )


@pytest.fixture()
def ranking(spark):
    return spark.createDataFrame(
        [
            ("ok", ranking_text([{"id": "c1", "score": 0.25}, {"id": "c9", "score": 2}])),
            ("no_campaigns", ranking_text([])),
            ("null_campaigns", ranking_text(None)),
            ("no_narratives", '[{"id": "j1", "narratives": []}]'),
            ("null_narratives", '[{"id": "j1"}]'),
            ("empty", "[]"),
            ("broken", "[{"),
            ("null", None),
        ],
        "customer_id string, rank string",
    )


def test_flatten_keeps_readable_leaves(spark, ranking):
    journeys = spark.createDataFrame(
        [("j1", "P", "J", "on"), ("j1", "P", "J", "on")],
        "id string, product string, name string, status string",
    )
    campaigns = spark.createDataFrame([("c1", "C", "live")], "id string, name string, status string")
    got = rows(eng.flatten_ranking(ranking, journeys, campaigns), "campaign_id")
    assert [(r["customer_id"], r["campaign_id"], r["campaign_score"], r["campaign_name"]) for r in got] == [
        ("ok", "c1", 0.25, "C"),
        ("ok", "c9", 2.0, None),
    ]
    assert all(r["journey_name"] == "J" for r in got)


def test_outer_explode_keeps_every_customer(ranking):
    assert eng.ranking_leaves(ranking, keep_empty=True).select("customer_id").distinct().count() == 8


def test_rejected(ranking):
    assert one(eng.rejected_rankings(ranking)) == {
        "rows": 8, "null_rows": 1, "malformed_rows": 1, "empty_rows": 1,
    }


def test_eligible_keeps_null_keys(spark):
    customers = spark.createDataFrame([("a",), ("b",), (None,)], "customer_id string")
    cut = spark.createDataFrame([("a",), ("a",), (None,)], "customer_id string")
    assert {r["customer_id"] for r in rows(eng.eligible_customers(customers, cut))} == {"b", None}


def test_channel_performance_equals_row_join(spark, small):
    """Also when the dimension lists a campaign twice."""
    comms = normalised_comms(small)
    dimension = eng.campaign_dimension(small.campaign_dim, COMMS_SEGMENT, CAMPAIGN_KEPT)
    doubled = dimension.unionByName(
        dimension.filter("campaign_name = 'campaign-7'").withColumn("duration", F.lit(-1))
    )
    by_row = (
        comms.join(doubled, ["campaign_name", "stage"], "left")
        .groupBy("product", "stage", "channel")
        .agg(
            F.count_distinct("customer_id").alias("impacted_customers"),
            F.count(F.lit(1)).alias("total_requested"),
            (F.sum("delivered") / F.count(F.lit(1))).alias("delivery_rate"),
            F.try_divide(F.sum("engaged"), F.sum("delivered")).alias("engagement_rate"),
        )
    )
    assert same_rows(eng.channel_performance(comms, doubled), by_row, 9)


def test_engagement_of_null_clicks(spark):
    df = spark.createDataFrame(
        [(None, True), (None, False), (None, None), (False, False)], "clicked_primary boolean, clicked_secondary boolean"
    )
    from cohortry.functions import flag

    engaged = flag(F.col("clicked_primary") | F.col("clicked_secondary"))
    assert [r[0] for r in df.select(engaged).collect()] == [1, 0, 0, 0]


def test_assignments_per_day_equals_filter_after_join(small):
    joined = (
        small.assignments.withColumn("assignment_date", F.to_date("assigned_at"))
        .filter(F.col("assignment_date") >= "2024-01-03")
        .join(
            small.journeys.select(F.col("id").alias("journey_id"), "product", "name").dropDuplicates(),
            "journey_id",
            "left",
        )
        .filter("name = 'journey-3'")
        .groupBy("type", "assignment_date")
        .agg(F.count(F.lit(1)).alias("assignments"))
    )
    got = eng.assignments_per_day(small.assignments, small.journeys, "journey-3", "2024-01-03")
    assert same_rows(got, joined)


def test_search_terms_are_taken_as_they_are(spark):
    frame = spark.createDataFrame([("a_",), ("ab",), ("50%",), ("500",)], "text string")
    assert {r["text"] for r in eng.definition_search(frame, "text", ["a_", "50%"]).collect()} == {"a_", "50%"}
