"""Chart-ready frames."""

from __future__ import annotations

from cohortry.catalog import experiment as experiment_queries
from cohortry.catalog import uplift as uplift_queries
from cohortry.catalog._base import digits, query
from cohortry.catalog.uplift import periodic_uplift
from cohortry.operators import experiment as exp
from cohortry.operators import frames as frm
from cohortry.sources.standins import AS_OF, ROLLOUT

PARTS = uplift_queries.PARTS
UPLIFT_SQL = uplift_queries.PERIODIC_SQL + uplift_queries.uplift_sql("stats")
MATRIX_PERIODS = frm.months_between(ROLLOUT, AS_OF)


def _band_sql(arm: str, s: str) -> str:
    return f""" SELECT period, variant, '{arm}' AS arm, n_{s} AS n_customers, avg_{s} AS mean,
       avg_{s} - 1.96 * std_{s} / SQRT(n_{s}) AS lower,
       avg_{s} + 1.96 * std_{s} / SQRT(n_{s}) AS upper
FROM uplift"""


_LONG_SQL = " UNION ALL ".join(
    f" SELECT period, variant, '{a}' AS product, uplift_{a} AS contribution FROM uplift"
    for a in PARTS
)


@query(
    UPLIFT_SQL + _band_sql("treatment", "t") + " UNION ALL " + _band_sql("control", "c"),
    digits(d0=["lower", "upper"]),
)
def frm01_arm_bands(t):
    return frm.arm_bands(periodic_uplift(t))


@query(UPLIFT_SQL + _LONG_SQL)
def frm02_contributions_long(t):
    return frm.contributions_long(periodic_uplift(t))


@query(
    UPLIFT_SQL
    + f""", melted AS ({_LONG_SQL}), placed AS (
    SELECT *, CAST(list_position({PARTS!r}, product) AS BIGINT) AS position FROM melted)
SELECT *, base + contribution AS top FROM (
    SELECT p.*, COALESCE((SELECT SUM(q.contribution) FROM placed q
        WHERE q.period = p.period AND q.variant = p.variant AND q.position < p.position
          AND CASE WHEN p.contribution < 0 THEN q.contribution < 0 ELSE q.contribution > 0 END),
        0) AS base
    FROM placed p)"""
)
def frm03_stacked(t):
    return frm.stacked_contributions(frm.contributions_long(periodic_uplift(t)), PARTS)


@query(
    UPLIFT_SQL
    + f""", cells AS (
    SELECT strftime(period, '%Y-%m-%d') AS period, product, contribution
    FROM ({_LONG_SQL} UNION ALL
          SELECT period, variant, 'Total', uplift FROM uplift)
    WHERE variant = 'treatment')
SELECT product, """
    + ", ".join(
        f"MAX(CASE WHEN period = '{p}' THEN contribution END) AS \"{p}\"" for p in MATRIX_PERIODS
    )
    + " FROM cells GROUP BY product"
)
def frm04_contribution_matrix(t):
    return frm.contribution_matrix(periodic_uplift(t), "treatment", MATRIX_PERIODS)


@query(
    UPLIFT_SQL
    + """ SELECT *, CASE WHEN avg_gap_days < 15 THEN 'day' ELSE 'month' END AS grain
FROM (SELECT COUNT(DISTINCT period) AS periods,
             (MAX(period) - MIN(period)) / NULLIF(COUNT(DISTINCT period) - 1, 0) AS avg_gap_days
      FROM uplift)""",
    digits(d6=["avg_gap_days"]),
)
def frm05_grain(t):
    return frm.grain_of(periodic_uplift(t))


@query(
    experiment_queries.slim_sql(experiment_queries.SEGMENT_CELL)
    + " UNION ALL ".join(
        f""" SELECT segment, '{m}' AS metric_name, delta_relative_{m} * 100 AS delta,
        IC_lower_rel_{m} * 100 AS lower, IC_upper_rel_{m} * 100 AS upper,
        {m}_stat_sig = 'stat-sig' AS significant FROM slim"""
        for m in ("unit_risk_rate", "balance_risk_ratio")
    ),
    digits(d6=["delta", "lower", "upper"]),
)
def frm06_forest_rows(t):
    slim = experiment_queries.slim(t, experiment_queries.SEGMENT_CELL)
    return frm.forest_rows(exp.long_summary(slim))
