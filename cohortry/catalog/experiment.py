"""Default-rate experiment on bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog._base import digits, mean_sql, query
from cohortry.functions import ratio
from cohortry.operators import experiment as exp
from cohortry.sources.sinks import materialise
from cohortry.sources.standins import (
    BILL_END,
    BILL_INDEX,
    BILL_START,
    EXCLUDED_SEGMENT,
    TAG_RULES,
    Standins,
    with_relations,
)

SEGMENT_CELL = ["segment"]
TAG_CELL = ["segment", "account_tag"]


def _population(t: Standins):
    return exp.base_population(t.bills, t.account_flags, BILL_START, BILL_END, BILL_INDEX)


def _base(t: Standins):
    return exp.with_priority_tag(_population(t), TAG_RULES)


def _accounts(t: Standins, keys=("account_id",)):
    """Folded bills with customer and tag."""
    eligible = exp.eligible_bills(t.bills, BILL_START, BILL_END, BILL_INDEX)
    return exp.with_priority_tag(
        exp.with_account(exp.folded_bills(eligible, keys), t.account_flags), TAG_RULES
    )


def _assigned(t: Standins):
    return exp.attach_assignment(_base(t), t.holdout, EXCLUDED_SEGMENT)


def cell_metrics(t: Standins, extra=()):
    return exp.cell_metrics(_accounts(t), t.holdout, EXCLUDED_SEGMENT, extra)


def _significance(t: Standins, cell):
    return exp.default_rate_significance(cell_metrics(t, cell[1:]), cell)


def slim(t: Standins, cell):
    return exp.side_by_side(_significance(t, cell), cell)


# --------------------------------------------------------------------------
# SQL side
# --------------------------------------------------------------------------


def _metrics_sql(keys: str) -> str:
    """CTEs up to ``metrics``: group metrics with holdout sizes and unit rate."""
    return with_relations("assigned", "sizes") + f""",
clients AS (
    SELECT customer_id, {keys}, MAX(CASE WHEN defaults_now THEN 1 ELSE 0 END) AS had_default,
           SUM(CASE WHEN defaults_now THEN balance ELSE 0 END) AS bad, SUM(balance) AS total
    FROM assigned GROUP BY customer_id, {keys}),
grouped AS (
    SELECT {keys}, COUNT(*) AS unique_customers,
           CAST(SUM(had_default) AS BIGINT) AS unique_defaulted_customers,
           SUM(bad) AS total_outstanding_balance, SUM(total) AS total_balance,
           STDDEV_SAMP(bad) AS stddev_outstanding_balance_per_client,
           STDDEV_SAMP(total) AS stddev_total_balance_per_client,
           COVAR_SAMP(bad, total) AS cov_outstanding_total_per_client,
           CASE WHEN SUM(total) > 0 THEN SUM(bad) / SUM(total) END AS balance_risk_ratio
    FROM clients GROUP BY {keys}),
metrics AS (
    SELECT g.*, s.total_holdout,
           g.unique_defaulted_customers / NULLIF(s.total_holdout, 0) AS unit_risk_rate
    FROM grouped g JOIN sizes s ON g.segment = s.segment AND g.variant = s.variant)"""


_SQUARES = """(POW(stddev_outstanding_balance_per_client, 2)
    + POW(balance_risk_ratio, 2) * POW(stddev_total_balance_per_client, 2))"""
_SPREAD = f"({_SQUARES} - 2 * balance_risk_ratio * cov_outstanding_total_per_client)"
_RATIO_VARIANCE = f"""unique_customers
    * CASE WHEN {_SPREAD} < {_SQUARES} * 1e-12 THEN 0 ELSE {_SPREAD} END
    / POW(total_balance, 2)"""
_UNIT_VARIANCE = "unit_risk_rate * (1 - unit_risk_rate) / total_holdout"


def _block_sql(name: str, value: str, variance: str) -> str:
    """Columns of one metric's significance block; t is the row, c its control."""
    margin = f"1.96 * SQRT(t.v_{name} + c.v_{name})"
    delta = f"(t.{value} - c.{value})"
    base = f"NULLIF(c.{value}, 0)"
    return f"""{margin} AS margin_abs_{name}, {margin} / {base} AS margin_relative_{name},
        {delta} AS delta_abs_{name}, {delta} / {base} AS delta_relative_{name},
        {delta} - {margin} AS IC_lower_abs_{name}, {delta} + {margin} AS IC_upper_abs_{name},
        ({delta} - {margin}) / {base} AS IC_lower_rel_{name},
        ({delta} + {margin}) / {base} AS IC_upper_rel_{name},
        CASE WHEN {delta} - {margin} > 0 OR {delta} + {margin} < 0 THEN 'stat-sig'
             ELSE 'non-stat-sig' END AS {name}_stat_sig"""


def _significance_sql(source: str, cell: list[str], metrics: list[tuple[str, str, str]]) -> str:
    """Self-join of a metrics relation with its control rows."""
    variances = ", ".join(f"{variance} AS v_{name}" for name, _, variance in metrics)
    blocks = ",\n".join(_block_sql(*m) for m in metrics)
    dropped = ", ".join(f"v_{name}" for name, _, _ in metrics)
    on = " AND ".join(f"t.{k} = c.{k}" for k in cell)
    return f"""(
    WITH own AS (SELECT *, {variances} FROM {source})
    SELECT t.* EXCLUDE ({dropped}), {blocks}
    FROM own t LEFT JOIN (SELECT * FROM own WHERE variant = 'control') c ON {on})"""


BOTH = [
    ("unit_risk_rate", "unit_risk_rate", _UNIT_VARIANCE),
    ("balance_risk_ratio", "balance_risk_ratio", _RATIO_VARIANCE),
]
KEYS = {1: "segment, variant", 2: "segment, variant, account_tag"}


def _both_sql(cell: list[str]) -> str:
    return (
        _metrics_sql(KEYS[len(cell)])
        + f",\nsignificance AS {_significance_sql('metrics', cell, BOTH)}"
    )


def slim_sql(cell: list[str]) -> str:
    """CTEs up to ``slim``: treatment and control side by side."""
    on = " AND ".join(f"t.{k} = c.{k}" for k in cell)
    arms = ",\n".join(
        f"t.{s} AS {d}_treatment, c.{s} AS {d}_control" for s, d in exp.ARM_COLUMNS.items()
    )
    deltas = ",\n".join(
        ", ".join(f"t.{p}_{m}" for p in exp.DELTA_COLUMNS) + f", t.{m}_stat_sig"
        for m in ("unit_risk_rate", "balance_risk_ratio")
    )
    keys = ", ".join(f"t.{k}" for k in cell)
    return _both_sql(cell) + f""",
slim AS (
    SELECT {keys}, {arms},
           t.unique_defaulted_customers - c.unique_defaulted_customers
               AS delta_defaulted_customers,
           {deltas}
    FROM significance t
    LEFT JOIN (SELECT * FROM significance WHERE variant = 'control') c ON {on}
    WHERE t.variant = 'treatment')"""


MONEY = ("total_outstanding_balance", "total_balance")
SPREAD = (
    "stddev_outstanding_balance_per_client",
    "stddev_total_balance_per_client",
)
METRIC_DIGITS = {
    **digits(d2=MONEY, d4=SPREAD, d8=["balance_risk_ratio"]),
    "cov_outstanding_total_per_client": -2,
}
CELL_DIGITS = {**METRIC_DIGITS, **digits(d8=["unit_risk_rate"])}


def _block_digits(name: str, places: int = 8, absolute: int | None = None) -> dict[str, int]:
    absolute = places if absolute is None else absolute
    out = {}
    for stem in ("margin", "delta"):
        out[f"{stem}_abs_{name}"] = absolute
        out[f"{stem}_relative_{name}"] = places
    for side in ("lower", "upper"):
        out[f"IC_{side}_abs_{name}"] = absolute
        out[f"IC_{side}_rel_{name}"] = places
    return out


BOTH_DIGITS = {
    **CELL_DIGITS,
    **_block_digits("unit_risk_rate"),
    **_block_digits("balance_risk_ratio"),
}
SLIM_DIGITS = digits(
    d2=[f"{c}_{arm}" for c in ("outstanding_balance", "total_balance") for arm in ("treatment", "control")],
    d8=[
        f"{c}_{arm}"
        for c in ("unit_risk_rate", "balance_risk_ratio")
        for arm in ("treatment", "control")
    ]
    + [
        f"{prefix}_{m}"
        for prefix in exp.DELTA_COLUMNS
        for m in ("unit_risk_rate", "balance_risk_ratio")
    ],
)


# --------------------------------------------------------------------------
# queries
# --------------------------------------------------------------------------


@query(with_relations("base") + " SELECT * EXCLUDE (account_tag) FROM base")
def exp01_base_population(t):
    return _population(t)


@query(with_relations("base") + " SELECT * FROM base")
def exp02_priority_tag(t):
    return _base(t)


@query(with_relations("assigned") + " SELECT * FROM assigned")
def exp03_attach_assignment(t):
    return _assigned(t)


@query(with_relations("sizes") + " SELECT * FROM sizes")
def exp04_holdout_sizes(t):
    return exp.holdout_sizes(t.holdout, EXCLUDED_SEGMENT)


@query(_metrics_sql(KEYS[1]) + " SELECT * FROM grouped", METRIC_DIGITS)
def exp05_group_metrics(t):
    return exp.folded_metrics(_accounts(t), t.holdout, EXCLUDED_SEGMENT)


@query(_metrics_sql(KEYS[1]) + " SELECT * FROM metrics", CELL_DIGITS)
def exp06_unit_rate(t):
    return cell_metrics(t)


@query(
    _metrics_sql(KEYS[1])
    + f" SELECT * FROM {_significance_sql('metrics', SEGMENT_CELL, BOTH[:1])}",
    {**CELL_DIGITS, **_block_digits("unit_risk_rate")},
)
def exp07_sig_proportion(t):
    return exp.with_significance(cell_metrics(t), exp.UNIT_RISK, SEGMENT_CELL)


@query(
    _metrics_sql(KEYS[1])
    + " SELECT * FROM "
    + _significance_sql(
        "metrics",
        SEGMENT_CELL,
        [
            (
                "lost",
                "total_outstanding_balance",
                "unique_customers * POW(stddev_outstanding_balance_per_client, 2)",
            )
        ],
    ),
    {**CELL_DIGITS, **_block_digits("lost", absolute=2)},
)
def exp08_sig_sum(t):
    metric = exp.Metric(
        "lost",
        "total_outstanding_balance",
        "unique_customers",
        "sum",
        stddev="stddev_outstanding_balance_per_client",
    )
    return exp.with_significance(cell_metrics(t), metric, SEGMENT_CELL)


@query(
    _metrics_sql(KEYS[1])
    + f" SELECT * FROM {_significance_sql('metrics', SEGMENT_CELL, BOTH[1:])}",
    {**CELL_DIGITS, **_block_digits("balance_risk_ratio")},
)
def exp09_sig_ratio(t):
    return exp.with_significance(cell_metrics(t), exp.BALANCE_RISK, SEGMENT_CELL)


@query(
    _metrics_sql(KEYS[1])
    + """, averaged AS (
    SELECT *, total_balance / NULLIF(unique_customers, 0) AS avg_balance FROM metrics)
    SELECT * FROM """
    + _significance_sql(
        "averaged",
        SEGMENT_CELL,
        [
            (
                "avg_balance",
                "avg_balance",
                "POW(stddev_total_balance_per_client, 2) / unique_customers",
            )
        ],
    ),
    {**CELL_DIGITS, **digits(d7=["avg_balance"]), **_block_digits("avg_balance", absolute=7)},
)
def exp10_sig_mean(t):
    averaged = cell_metrics(t).withColumn(
        "avg_balance", ratio(F.col("total_balance"), F.col("unique_customers"))
    )
    metric = exp.Metric(
        "avg_balance",
        "avg_balance",
        "unique_customers",
        "mean",
        stddev="stddev_total_balance_per_client",
    )
    return exp.with_significance(averaged, metric, SEGMENT_CELL)


@query(_both_sql(SEGMENT_CELL) + " SELECT * FROM significance", BOTH_DIGITS)
def exp11_significance_block(t):
    return _significance(t, SEGMENT_CELL)


@query(slim_sql(SEGMENT_CELL) + " SELECT * FROM slim", SLIM_DIGITS)
def exp12_side_by_side(t):
    return slim(t, SEGMENT_CELL).orderBy(*SEGMENT_CELL)


@query(_both_sql(TAG_CELL) + " SELECT * FROM significance", BOTH_DIGITS)
def exp13_metrics_by_tag(t):
    return _significance(t, TAG_CELL)


@query(
    slim_sql(TAG_CELL)
    + ",\nsegment_delta AS ("
    + slim_sql(SEGMENT_CELL)
    + """ SELECT segment, delta_abs_unit_risk_rate AS total_delta FROM slim)
SELECT s.* EXCLUDE (account_tag), s.account_tag AS "group",
       s.delta_abs_unit_risk_rate / NULLIF(d.total_delta, 0) AS share_defaulted
FROM slim s LEFT JOIN segment_delta d ON s.segment = d.segment""",
    {**SLIM_DIGITS, "share_defaulted": 8},
)
def exp14_contribution_share(t):
    # Written once: the levels need different columns, so Spark would scan the bills for each.
    clients = materialise(exp.client_totals(_accounts(t), [exp.TAG]), "clients")

    def level(cell):
        metrics = exp.cell_metrics(clients, t.holdout, EXCLUDED_SEGMENT, cell[1:])
        return exp.side_by_side(exp.default_rate_significance(metrics, cell), cell)

    shares = exp.with_contribution_share(level(TAG_CELL), level(SEGMENT_CELL))
    return shares.orderBy("segment", "group")


@query(
    slim_sql(SEGMENT_CELL)
    + " UNION ALL ".join(
        f""" SELECT segment, 'total' AS "group", '{m}' AS metric_name,
        total_holdout_treatment + total_holdout_control AS total_segment_holdout,
        {customers} AS relevant_customers, delta_relative_{m} AS delta_relative,
        IC_lower_rel_{m} AS IC_lower, IC_upper_rel_{m} AS IC_upper, {m}_stat_sig AS stat_sig
        FROM slim"""
        for m, customers in (
            ("unit_risk_rate", "unique_defaulted_customers_treatment"),
            ("balance_risk_ratio", "unique_customers_treatment"),
        )
    ),
    digits(d8=["delta_relative", "IC_lower", "IC_upper"]),
)
def exp15_long_summary(t):
    return exp.long_summary(slim(t, SEGMENT_CELL)).orderBy(*exp.summary_order())


@query(
    with_relations("assigned")
    + """ SELECT segment, COUNT(*) AS total_rows, COUNT(DISTINCT customer_id) AS unique_customers,
       COUNT(DISTINCT CASE WHEN defaults_now THEN customer_id END) AS unique_customers_defaulted,
       COUNT(DISTINCT account_id) AS unique_accounts
FROM assigned GROUP BY segment"""
)
def exp16_funnel(t):
    return exp.funnel(exp.attach_assignment(_accounts(t), t.holdout, EXCLUDED_SEGMENT))


@query(
    with_relations("assigned")
    + f""" SELECT segment, COUNT(*) AS total_customers, {mean_sql("n_bills", 0, 2)} AS avg_bills,
       MIN(n_bills) AS min_bills, MAX(n_bills) AS max_bills,
       {mean_sql("n_dates", 0, 2)} AS avg_distinct_dates,
       CAST(SUM(CASE WHEN n_accounts > 1 THEN 1 ELSE 0 END) AS BIGINT) AS customers_multi_account
FROM (SELECT segment, customer_id, COUNT(*) AS n_bills, COUNT(DISTINCT due_date) AS n_dates,
             COUNT(DISTINCT account_id) AS n_accounts
      FROM assigned GROUP BY segment, customer_id)
GROUP BY segment"""
)
def exp17_bills_per_customer(t):
    days = _accounts(t, ("account_id", "due_date"))
    return exp.bills_per_customer(exp.attach_assignment(days, t.holdout, EXCLUDED_SEGMENT))


@query(
    with_relations("base")
    + """ SELECT * FROM (
    SELECT *, CAST(is_urgent AS INTEGER) + CAST(is_partial AS INTEGER)
              + CAST(is_large AS INTEGER) AS flag_count
    FROM base) WHERE flag_count > 1"""
)
def exp18_overlapping_flags(t):
    return exp.overlapping_flags(_base(t), TAG_RULES)
