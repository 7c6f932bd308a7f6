"""Cheaper eligible offers."""

from __future__ import annotations

from cohortry.catalog._base import digits, mean_sql, query
from cohortry.operators import offers as off
from cohortry.sources.standins import AS_OF, LOOKBACK_MONTHS, PRODUCT_RULES, Standins, with_relations


def recent(t: Standins):
    return off.recent_contracts(t.contracts, AS_OF, PRODUCT_RULES, LOOKBACK_MONTHS)


def base(t: Standins):
    return off.monitoring_base(t.monitoring, "provider_", "provider_social")


def eligibility(t: Standins):
    return off.unified_eligibility(base(t), t.backed_rates, t.public_rates, t.private_rates)


def suboptimal(t: Standins):
    return off.suboptimal_contracts(recent(t), eligibility(t))


def segment(t: Standins):
    return off.best_alternative(suboptimal(t))


@query(with_relations("recent") + " SELECT * FROM recent", digits(d2=["total_debt_cost"]))
def ofr01_recent_contracts(t):
    return recent(t)


@query(
    with_relations("recent")
    + """ SELECT product_type, COUNT(*) AS contracts, COUNT(DISTINCT customer_id) AS customers
FROM recent GROUP BY product_type"""
)
def ofr02_contract_volume(t):
    return off.contract_volume(recent(t))


@query(with_relations("monitor_base") + " SELECT * FROM monitor_base")
def ofr03_any_of_flags(t):
    return base(t)


@query(
    with_relations("public_rates")
    + """ SELECT customer_id, rate AS public_rate, cap AS public_cap, eligible AS public_found
FROM public_rates WHERE eligible"""
)
def ofr04_rate_source(t):
    return off.rate_source(t.public_rates, "public")


@query(with_relations("eligibility") + " SELECT * FROM eligibility")
def ofr05_unified_eligibility(t):
    return eligibility(t)


@query(
    with_relations("eligibility")
    + """ SELECT product_type, COUNT(DISTINCT customer_id) AS eligible_customers
FROM eligibility GROUP BY product_type"""
)
def ofr06_eligible_customers(t):
    return off.eligible_customers(eligibility(t))


_SUBOPTIMAL_DIGITS = digits(
    d2=["contracted_total_cost", "alternative_total_cost", "saving"], d4=["saving_pct"]
)


@query(with_relations("suboptimal") + " SELECT * FROM suboptimal", _SUBOPTIMAL_DIGITS)
def ofr07_suboptimal(t):
    return suboptimal(t)


@query(
    with_relations("suboptimal")
    + " SELECT COUNT(DISTINCT customer_id) AS suboptimal_customers FROM suboptimal"
)
def ofr08_suboptimal_customers(t):
    return off.suboptimal_customers(suboptimal(t))


@query(
    with_relations("target_segment") + " SELECT * FROM target_segment",
    digits(d2=["max_saving"], d4=["max_saving_pct"]),
)
def ofr09_best_alternative(t):
    return segment(t)


@query(
    with_relations("suboptimal")
    + f""" SELECT contracted_product, alternative_product,
       COUNT(DISTINCT customer_id) AS num_customers, {mean_sql("saving", 2, 2)} AS avg_saving,
       {mean_sql("saving_pct", 4, 1, 100)} AS avg_saving_pct, MIN(saving) AS min_saving,
       MAX(saving) AS max_saving, {mean_sql("principal_amount", 2, 2)} AS avg_ticket
FROM suboptimal GROUP BY contracted_product, alternative_product"""
)
def ofr10_product_pairs(t):
    return off.product_pair_metrics(suboptimal(t))


def _histogram_sql(source: str, value: str, counted: str) -> str:
    return with_relations(source) + f""" SELECT
       CAST(FLOOR({value} / 500) AS BIGINT) * 500 AS saving_bucket, COUNT(*) AS {counted}
FROM {source} GROUP BY 1"""


@query(_histogram_sql("target_segment", "max_saving", "num_customers"))
def ofr11_savings_histogram(t):
    return off.savings_histogram(segment(t), "max_saving", "num_customers")


@query(_histogram_sql("suboptimal", "saving", "num_contracts"))
def ofr11_contract_histogram(t):
    return off.savings_histogram(suboptimal(t), "saving", "num_contracts")


@query(
    with_relations("suboptimal")
    + f""" SELECT ROUND(quantile_disc(saving, 0.50), 2) AS median_saving,
       {mean_sql("saving", 2, 2)} AS mean_saving, ROUND(quantile_disc(saving, 0.25), 2) AS p25_saving,
       ROUND(quantile_disc(saving, 0.75), 2) AS p75_saving
FROM suboptimal"""
)
def ofr12_savings_quartiles(t):
    return off.savings_quartiles(suboptimal(t))


@query(
    with_relations("target_segment")
    + f""" SELECT contracted_product, best_alternative_product, COUNT(*) AS num_customers,
       {mean_sql("max_saving", 2, 2)} AS avg_saving,
       {mean_sql("max_saving_pct", 4, 1, 100)} AS avg_saving_pct
FROM target_segment GROUP BY contracted_product, best_alternative_product"""
)
def ofr13_segment_summary(t):
    return off.segment_summary(segment(t))
