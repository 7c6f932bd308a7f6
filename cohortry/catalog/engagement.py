"""Channel engagement, rankings and eligibility."""

from __future__ import annotations

from cohortry.catalog._base import digits, query
from cohortry.operators import engagement as eng
from cohortry.sources.standins import (
    AS_OF,
    COMMS_END,
    COMMS_SEGMENT,
    COMMS_START,
    Standins,
    with_relations,
)

JOURNEY = "journey-3"
# Columns that pass unchanged from each channel, and from the campaign table.
KEPT = ["campaign_name", "stage", "template_name", "assignment_id"]
CAMPAIGN_KEPT = ["campaign_name", "stage", "product", "duration", "enabled"]


def normalised_comms(t: Standins):
    scope = (COMMS_SEGMENT, COMMS_START, COMMS_END, KEPT)
    return eng.union_all(
        [
            eng.normalise_channel(t.push, eng.push_channel(), *scope),
            eng.normalise_channel(t.email, eng.email_channel(), *scope),
            eng.normalise_channel(t.announcement, eng.announcement_channel(), *scope),
        ]
    )


@query(
    with_relations("ranking_rows", "journeys", "campaigns")
    + """ SELECT r.*, j.product AS journey_product, j.name AS journey_name,
       j.status AS journey_status, c.name AS campaign_name, c.status AS campaign_status
FROM ranking_rows r
LEFT JOIN (SELECT DISTINCT id, product, name, status FROM journeys) j ON r.journey_id = j.id
LEFT JOIN campaigns c ON r.campaign_id = c.id"""
)
def eng01_ranking_flatten(t):
    return eng.flatten_ranking(t.ranking, t.journeys, t.campaigns)


@query(
    """SELECT COUNT(*) AS rows,
       COUNT(*) FILTER (WHERE c_acctbal >= -900 AND c_acctbal < -800) AS null_rows,
       COUNT(*) FILTER (WHERE c_acctbal < -900) AS malformed_rows,
       COUNT(*) FILTER (WHERE c_acctbal >= -800 AND c_acctbal < -700) AS empty_rows
FROM customer"""
)
def eng01_rejected_rankings(t):
    return eng.rejected_rankings(t.ranking)


@query(
    with_relations("customers", "cut_list")
    + """ SELECT * FROM customers c
WHERE NOT EXISTS (SELECT 1 FROM cut_list x WHERE x.customer_id = c.customer_id)"""
)
def eng02_eligible(t):
    return eng.eligible_customers(t.customers, t.cut_list)


@query(
    with_relations("customers", "tiers", "cut_list")
    + """ SELECT c.customer_id, c.name, t.is_top_tier
FROM customers c JOIN tiers t ON c.customer_id = t.customer_id
WHERE NOT t.is_top_tier
  AND NOT EXISTS (SELECT 1 FROM cut_list x WHERE x.customer_id = c.customer_id)"""
)
def eng03_eligible_by_tier(t):
    return eng.eligible_by_tier(t.customers, t.tiers, t.cut_list, "is_top_tier")


@query(
    """SELECT doc_id, lang, source, n_chars FROM documents
WHERE contains(text, 'License') OR contains(text, 'the the')"""
)
def eng04_definition_search(t):
    found = eng.definition_search(t.table("documents"), "text", ("License", "the the"))
    return found.select("doc_id", "lang", "source", "n_chars")


@query(
    """SELECT o_orderpriority AS product, CAST(o_orderdate AS DATE) AS conversion_date,
       COUNT(*) AS conversions, SUM(o_totalprice) AS total_value
FROM orders GROUP BY 1, 2
UNION ALL
SELECT 'line-' || l_returnflag, CAST(l_shipdate AS DATE), COUNT(*), SUM(l_extendedprice)
FROM lineitem GROUP BY 1, 2
UNION ALL
SELECT event_type, CAST(ts AS DATE), COUNT(*), SUM(value) FROM events GROUP BY 1, 2""",
    digits(d2=["total_value"]),
)
def eng05_conversions(t):
    return eng.daily_conversions(t.conversions.values())


@query(with_relations("comms") + " SELECT * FROM comms")
def eng06_normalised_channels(t):
    return normalised_comms(t)


@query(with_relations("core_campaigns") + " SELECT * FROM core_campaigns")
def eng07_campaign_dimension(t):
    return eng.campaign_dimension(t.campaign_dim, COMMS_SEGMENT, CAMPAIGN_KEPT)


@query(
    with_relations("comms", "core_campaigns")
    + """ SELECT d.product, c.stage, c.channel, COUNT(DISTINCT c.customer_id) AS impacted_customers,
       COUNT(*) AS total_requested, SUM(c.delivered) / COUNT(*) AS delivery_rate,
       SUM(c.engaged) / NULLIF(SUM(c.delivered), 0) AS engagement_rate
FROM comms c LEFT JOIN core_campaigns d
  ON c.campaign_name = d.campaign_name AND c.stage = d.stage
GROUP BY d.product, c.stage, c.channel""",
    digits(d8=["delivery_rate", "engagement_rate"]),
)
def eng08_channel_performance(t):
    campaigns = eng.campaign_dimension(t.campaign_dim, COMMS_SEGMENT, CAMPAIGN_KEPT)
    return eng.channel_performance(normalised_comms(t), campaigns)


@query(
    with_relations("assignments", "journeys")
    + f""" SELECT a.type, CAST(a.assigned_at AS DATE) AS assignment_date, COUNT(*) AS assignments
FROM assignments a
LEFT JOIN (SELECT DISTINCT id, product, name FROM journeys) j ON a.journey_id = j.id
WHERE j.name = '{JOURNEY}' AND CAST(a.assigned_at AS DATE) >= DATE '{COMMS_START}'
GROUP BY 1, 2"""
)
def eng09_assignments_per_day(t):
    return eng.assignments_per_day(t.assignments, t.journeys, JOURNEY, COMMS_START)


@query(
    with_relations("campaign_dim")
    + f""" SELECT DISTINCT product, journey_name FROM campaign_dim
WHERE enabled AND segment = '{COMMS_SEGMENT}'"""
)
def eng10_active_journeys(t):
    return eng.active_journeys(t.campaign_dim, COMMS_SEGMENT)


@query(
    with_relations("archives", "journeys")
    + f""" SELECT j.product, COUNT(DISTINCT a.customer_id) AS total_eligibles
FROM archives a
LEFT JOIN (SELECT DISTINCT id, product FROM journeys) j ON a.journey_id = j.id
WHERE a.target_date >= DATE '{AS_OF}' - 30
GROUP BY j.product"""
)
def eng11_archived_eligibility(t):
    return eng.archived_eligibility(t.archives.values(), t.journey_products, AS_OF)
