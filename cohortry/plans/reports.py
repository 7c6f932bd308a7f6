"""Whole analyses, from sources to final frames.

Each report writes the stage that several of its frames share, once, and
derives the frames from what was written. ``stage`` takes a frame and a name
and returns the frame to go on with: by default it is written to the shared
folder; ``TableStages`` keeps stages as tables and drops them at the end.
``save`` takes a frame and its name, and is called for every frame of a report.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, fields
from typing import TypeVar

from pyspark.sql import DataFrame

from cohortry.operators import activity as act
from cohortry.operators import engagement as eng
from cohortry.operators import experiment as exp
from cohortry.operators import frames as frm
from cohortry.operators import guards as dq
from cohortry.operators import offers as off
from cohortry.operators import uplift as up
from cohortry.sources.sinks import Stage, materialise

Save = Callable[[DataFrame, str], object]
Report = TypeVar("Report")


def saved(report: Report, save: Save | None) -> Report:
    """Hand every frame of a report to ``save`` under the name of its field."""
    if save is not None:
        for field in fields(report):
            save(getattr(report, field.name), field.name)
    return report


@dataclass(frozen=True)
class DefaultRateReport:
    by_segment: DataFrame
    by_tag: DataFrame
    summary: DataFrame
    forest: DataFrame
    funnel: DataFrame


def default_rate_report(
    bills: DataFrame,
    account_flags: DataFrame,
    assignments: DataFrame,
    start: str,
    end: str,
    tag_rules: exp.TagRules,
    bill_index: int = 0,
    excluded_segment: str | None = None,
    stage: Stage = materialise,
    save: Save | None = None,
) -> DefaultRateReport:
    """Default rates of treatment against control; bills are scanned once."""
    dq.assert_unique(
        exp.in_scope(assignments, excluded_segment), "assignments", [exp.CUSTOMER, exp.VARIANT]
    )
    eligible = exp.eligible_bills(bills, start, end, bill_index)
    accounts = stage(
        exp.with_priority_tag(
            exp.with_account(exp.folded_bills(eligible), account_flags), tag_rules
        ),
        "default_rate_accounts",
    )

    def slim(cell: list[str]) -> DataFrame:
        metrics = exp.cell_metrics(accounts, assignments, excluded_segment, cell[1:])
        return exp.side_by_side(exp.default_rate_significance(metrics, cell), cell)

    by_segment = stage(slim([exp.SEGMENT]), "default_rate_by_segment")
    shares = exp.with_contribution_share(slim([exp.SEGMENT, exp.TAG]), by_segment)
    summary = exp.long_summary(by_segment).orderBy(*exp.summary_order())
    report = DefaultRateReport(
        by_segment=by_segment.orderBy(exp.SEGMENT),
        by_tag=shares.orderBy(exp.SEGMENT, "group"),
        summary=summary,
        forest=frm.forest_rows(summary),
        funnel=exp.funnel(exp.attach_assignment(accounts, assignments, excluded_segment)),
    )
    return saved(report, save)


@dataclass(frozen=True)
class HoldoutReport:
    uplift: DataFrame
    drill_down: DataFrame
    variant_sizes: DataFrame
    multi_variant: DataFrame
    balance: DataFrame
    additivity: DataFrame
    null_metrics: DataFrame
    bands: DataFrame
    contributions: DataFrame
    stacked: DataFrame


def holdout_report(
    facts: DataFrame,
    exposure: DataFrame,
    branches: Sequence[up.Branch],
    rollout_date: str,
    pre_start: str,
    grain: str = "month",
    stage: Stage = materialise,
    save: Save | None = None,
) -> HoldoutReport:
    """Uplift of every metric of a hierarchy, with its sanity frames.

    The facts from roll-out on are scanned once for all metrics, periodic and
    cumulative. ``branches[0]`` is the metric of the pre-period balance and of
    the chart frames.
    """
    stats = stage(
        up.hierarchy_stats(exposure, facts, branches, rollout_date, grain=grain), "holdout_stats"
    )
    uplift = up.hierarchy_uplift(stats)
    main = branches[0]
    top = stage(
        up.metric_uplift(exposure, facts, main, rollout_date, grain=grain).periodic_uplift,
        "holdout_main",
    )
    parts = frm.contributions_long(top)
    report = HoldoutReport(
        uplift=uplift,
        drill_down=up.drill_down(uplift, branches),
        variant_sizes=up.variant_sizes(exposure),
        multi_variant=up.multi_variant_customers(exposure),
        balance=up.pre_period_balance(exposure, facts, branches[0], pre_start, rollout_date),
        additivity=up.additive_check(facts, branches, grain=grain),
        null_metrics=up.null_counts(facts, exposure, branches, rollout_date, grain=grain),
        bands=frm.arm_bands(top),
        contributions=parts,
        stacked=frm.stacked_contributions(parts, list(main.parts)),
    )
    return saved(report, save)


@dataclass(frozen=True)
class OfferSources:
    contracts: DataFrame
    monitoring: DataFrame
    backed_rates: DataFrame
    public_rates: DataFrame
    private_rates: DataFrame


@dataclass(frozen=True)
class OfferReport:
    segment: DataFrame
    volume: DataFrame
    eligible: DataFrame
    pairs: DataFrame
    histogram: DataFrame
    quartiles: DataFrame
    summary: DataFrame
    expansion: DataFrame
    ranges: DataFrame
    scope: DataFrame
    repeated_contracts: DataFrame
    coverage: DataFrame


# Columns each source must have before anything is transformed.
_RATE_COLUMNS = ("customer_id", "eligible", "rate", "cap")
_SOURCE_COLUMNS = {
    "contracts": (
        "contract_id",
        "customer_id",
        "created_at_date",
        "principal",
        "interest_rate",
        "installments",
        "is_valid_loan",
        "is_renegotiation",
    ),
    "monitoring": (
        "customer_id",
        "personal_eligible",
        "personal_rate",
        "personal_cap",
        "backed_eligible",
        "private_eligible",
    ),
    "backed_rates": _RATE_COLUMNS,
    "public_rates": _RATE_COLUMNS,
    "private_rates": _RATE_COLUMNS,
}


def offer_report(
    sources: OfferSources,
    as_of: str,
    rules: Sequence[off.Rule],
    months: int = 12,
    min_cost_gap: float = 0.15,
    provider_prefix: str = "provider_",
    social_provider: str = "provider_social",
    stage: Stage = materialise,
    save: Save | None = None,
) -> OfferReport:
    """Target segment for cheaper offers: guards, stages, then results."""
    for name, columns in _SOURCE_COLUMNS.items():
        dq.require_columns(getattr(sources, name), name, columns)
    dq.require_columns(sources.monitoring, "monitoring", [social_provider])
    dq.require_columns(sources.contracts, "contracts", [column for column, _, _ in rules])

    customer_level = ["monitoring", "backed_rates", "public_rates", "private_rates"]
    dq.assert_passed(
        dq.run_checks(
            [
                dq.key_check(
                    source.filter("eligible") if "eligible" in source.columns else source,
                    name,
                    [off.CUSTOMER],
                )
                for name in customer_level
                for source in [getattr(sources, name)]
            ]
        )
    )

    recent = off.recent_contracts(sources.contracts, as_of, rules, months)
    eligibility = stage(
        off.unified_eligibility(
            off.monitoring_base(sources.monitoring, provider_prefix, social_provider),
            sources.backed_rates,
            sources.public_rates,
            sources.private_rates,
        ),
        "current_eligibility",
    )
    suboptimal = stage(
        off.suboptimal_contracts(recent, eligibility, min_cost_gap), "suboptimal_contracts"
    )
    segment = stage(off.best_alternative(suboptimal), "target_segment")
    dq.assert_unique(segment, "target_segment", [off.CUSTOMER])
    products = list(dict.fromkeys(label for _, _, label in rules))
    report = OfferReport(
        segment=segment,
        volume=off.contract_volume(recent),
        eligible=off.eligible_customers(eligibility),
        pairs=off.product_pair_metrics(suboptimal),
        histogram=off.savings_histogram(segment, "max_saving", "num_customers"),
        quartiles=off.savings_quartiles(suboptimal, stage),
        summary=off.segment_summary(segment),
        expansion=dq.join_expansion(recent, eligibility, [off.CUSTOMER], differ="product_type"),
        ranges=dq.range_profile(segment, off.CUSTOMER, ["max_saving", "max_saving_pct"]),
        scope=dq.scope_profile(recent, off.CUSTOMER, "contract_date", [off.CUSTOMER, "product_type"]),
        repeated_contracts=dq.duplicate_keys(recent, recent.columns, ordered=False),
        coverage=dq.value_coverage(
            products, "product_type", off.CUSTOMER, {"contract": recent, "eligible": eligibility}
        ),
    )
    return saved(report, save)


@dataclass(frozen=True)
class ActivityReport:
    volume: DataFrame
    by_author: DataFrame
    lead_time: DataFrame
    requests: DataFrame
    outputs: DataFrame
    monthly_outputs: DataFrame
    to_date: DataFrame
    content: DataFrame


def activity_report(
    requests: DataFrame,
    since: str,
    signatures: Sequence[act.Signature],
    single_output_labels: Sequence[str],
    text_fields: Sequence[act.Field],
    stage: Stage = materialise,
    save: Save | None = None,
) -> ActivityReport:
    """Every activity frame; each request's text is parsed for its label once."""
    attributed = act.attributed(act.merged_requests(requests, since), signatures)
    estimated = stage(
        act.with_estimated_outputs(attributed, single_output_labels), "attributed_requests"
    )
    report = ActivityReport(
        volume=act.monthly_volume(estimated),
        by_author=act.by_author(estimated),
        lead_time=act.lead_time(estimated),
        requests=act.request_list(estimated, ordered=False),
        outputs=act.output_list(estimated, ordered=False),
        monthly_outputs=act.monthly_outputs(estimated),
        to_date=act.outputs_to_date(estimated),
        content=act.request_content(estimated, text_fields, ordered=False),
    )
    return saved(report, save)


@dataclass(frozen=True)
class EngagementReport:
    conversions: DataFrame
    performance: DataFrame
    journeys: DataFrame
    archived: DataFrame


def engagement_report(
    conversions: Iterable[DataFrame],
    channels: Sequence[tuple[DataFrame, eng.Channel]],
    dimension: DataFrame,
    archives: Iterable[DataFrame],
    journey_products: DataFrame,
    segment: str,
    start: str,
    end: str,
    as_of: str,
    kept: Sequence[str] = ("campaign_name", "stage"),
    save: Save | None = None,
) -> EngagementReport:
    """Conversions, channel performance, active journeys and archived eligibility."""
    comms = eng.union_all(
        eng.normalise_channel(frame, channel, segment, start, end, kept) for frame, channel in channels
    )
    campaigns = eng.campaign_dimension(dimension, segment, ["campaign_name", "stage", "product"])
    report = EngagementReport(
        conversions=eng.daily_conversions(conversions),
        performance=eng.channel_performance(comms, campaigns),
        journeys=eng.active_journeys(dimension, segment),
        archived=eng.archived_eligibility(archives, journey_products, as_of),
    )
    return saved(report, save)


def rows_on_hand(df: DataFrame, most: int = 10_000):
    """A bounded aggregate as pandas, for a chart; raises if it is larger."""
    taken = df.limit(most + 1).toPandas()
    if len(taken) > most:
        raise ValueError(f"more than {most} rows; aggregate before handing over to the driver")
    return taken
