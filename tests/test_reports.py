import pytest

from cohortry.catalog import CATALOG
from cohortry.operators import engagement as eng
from cohortry.operators.guards import GuardError
from cohortry.plans import reports
from cohortry.sources.sinks import TableStages
from cohortry.sources.standins import (
    AS_OF,
    BILL_END,
    BILL_INDEX,
    BILL_START,
    BRANCHES,
    COMMS_END,
    COMMS_SEGMENT,
    COMMS_START,
    EXCLUDED_SEGMENT,
    FIELDS,
    MERGED_SINCE,
    PRE_START,
    PRODUCT_RULES,
    PRODUCTS,
    ROLLOUT,
    SIGNATURES,
    SINGLE_OUTPUT,
    TAG_RULES,
)
from tests.support import same_rows


def query(small, name):
    return CATALOG[name].build(small)


def test_default_rate_report(small):
    report = reports.default_rate_report(
        small.bills, small.account_flags, small.holdout, BILL_START, BILL_END, TAG_RULES,
        BILL_INDEX, EXCLUDED_SEGMENT,
    )
    assert same_rows(report.by_segment, query(small, "exp12_side_by_side"), 6)
    assert same_rows(report.by_tag, query(small, "exp14_contribution_share"), 6)
    assert same_rows(report.summary, query(small, "exp15_long_summary"), 6)
    assert same_rows(report.funnel, query(small, "exp16_funnel"))
    assert report.forest.count() == report.summary.count()


def test_default_rate_report_needs_one_row_per_arm(small):
    twice = small.holdout.unionByName(small.holdout)
    with pytest.raises(GuardError):
        reports.default_rate_report(
            small.bills, small.account_flags, twice, BILL_START, BILL_END, TAG_RULES
        )


def test_holdout_report(small):
    report = reports.holdout_report(small.facts, small.exposure, BRANCHES, ROLLOUT, PRE_START)
    assert same_rows(report.drill_down, query(small, "upl10_drill_down"), 2)
    assert same_rows(report.additivity, query(small, "upl14_additive_check"))
    assert report.balance.columns[:2] == ["period", "variant"]
    assert same_rows(report.bands, query(small, "frm01_arm_bands"), 0)
    assert same_rows(report.stacked, query(small, "frm03_stacked"), 2)
    nulls = report.null_metrics
    assert nulls.count() > 0 and nulls.where("null_customers > 0").count() == 0


def sources(small, **replaced):
    names = ("contracts", "monitoring", "backed_rates", "public_rates", "private_rates")
    return reports.OfferSources(**{n: replaced.get(n, getattr(small, n)) for n in names})


def test_offer_report(small):
    report = reports.offer_report(sources(small), AS_OF, PRODUCT_RULES)
    for frame, name in (
        (report.segment, "ofr09_best_alternative"),
        (report.pairs, "ofr10_product_pairs"),
        (report.histogram, "ofr11_savings_histogram"),
        (report.summary, "ofr13_segment_summary"),
        (report.expansion, "dq07_join_expansion"),
    ):
        assert same_rows(frame, query(small, name), 6), name
    assert sorted(r["product_type"] for r in report.coverage.collect()) == sorted(PRODUCTS)
    assert report.repeated_contracts.count() == 0
    assert report.scope.first()["rows"] == query(small, "ofr01_recent_contracts").count()


def test_offer_report_fails_fast(small):
    with pytest.raises(GuardError, match="principal"):
        reports.offer_report(sources(small, contracts=small.contracts.drop("principal")), AS_OF, PRODUCT_RULES)
    with pytest.raises(GuardError, match="public_rates"):
        reports.offer_report(
            sources(small, public_rates=small.public_rates.union(small.public_rates)), AS_OF, PRODUCT_RULES
        )


def test_activity_report(small):
    report = reports.activity_report(
        small.change_requests, MERGED_SINCE, SIGNATURES, SINGLE_OUTPUT, FIELDS
    )
    assert same_rows(report.volume, query(small, "act03_monthly_volume"))
    assert same_rows(report.content, query(small, "act11_request_content"))


def test_engagement_report_saves_every_frame(small):
    kept = {}
    channels = [
        (small.push, eng.push_channel()),
        (small.email, eng.email_channel()),
        (small.announcement, eng.announcement_channel()),
    ]
    report = reports.engagement_report(
        small.conversions.values(), channels, small.campaign_dim, small.archives.values(),
        small.journey_products, COMMS_SEGMENT, COMMS_START, COMMS_END, AS_OF,
        save=lambda frame, name: kept.update({name: frame}),
    )
    assert set(kept) == {"conversions", "performance", "journeys", "archived"}
    assert kept["archived"] is report.archived
    assert same_rows(report.performance, query(small, "eng08_channel_performance"), 8)
    assert same_rows(report.archived, query(small, "eng11_archived_eligibility"))


def test_stages_as_tables_are_dropped(small):
    with TableStages() as stage:
        report = reports.activity_report(
            small.change_requests, MERGED_SINCE, SIGNATURES, SINGLE_OUTPUT, FIELDS, stage=stage
        )
        names = [name for _, name in stage.tables]
        assert report.to_date.count() == 1 and all(small.spark.catalog.tableExists(n) for n in names)
    assert names and not any(small.spark.catalog.tableExists(n) for n in names)


def test_rows_on_hand(spark):
    assert len(reports.rows_on_hand(spark.range(5), 5)) == 5
    with pytest.raises(ValueError):
        reports.rows_on_hand(spark.range(6), 5)
