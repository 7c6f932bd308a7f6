"""Uplift of value facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog._base import digits, query
from cohortry.operators import uplift as up
from cohortry.operators.running import RunningTotals
from cohortry.sources.sinks import materialise, new_location
from cohortry.sources.standins import BRANCHES, PRE_START, ROLLOUT, Standins, with_relations

TOTAL = BRANCHES[0]
PARTS = list(TOTAL.parts)
GRAIN = "month"


def _periods(t: Standins, grain: str = GRAIN):
    metrics = {up.MAIN: TOTAL.metric, **TOTAL.parts}
    return up.customer_periods(t.facts_between(ROLLOUT), t.exposure, metrics, ROLLOUT, grain=grain)


def _periodic_stats(t: Standins):
    return up.period_stats(_periods(t), parts={a: a for a in PARTS})


def periodic_uplift(t: Standins):
    return up.stats_uplift(_periodic_stats(t), PARTS)


# --------------------------------------------------------------------------
# SQL side
# --------------------------------------------------------------------------

_NAMES = up.source_columns(BRANCHES)


def _exposed_sql(columns: dict[str, str], grain: str = GRAIN) -> str:
    """CTEs up to ``periods`` and ``running``: sums per customer and period."""
    period = "f.date" if grain == "day" else "CAST(date_trunc('month', f.date) AS DATE)"
    sums = ", ".join(f"SUM(f.{source}) AS {name}" for name, source in columns.items())
    running = ", ".join(
        f"SUM({n}) OVER (PARTITION BY customer_id, variant ORDER BY period "
        f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_{n}"
        for n in columns
    )
    return with_relations("facts", "first_seen") + f""",
periods AS (
    SELECT f.customer_id, {period} AS period, x.variant, {sums}
    FROM facts f JOIN first_seen x ON f.customer_id = x.customer_id
    WHERE f.date >= DATE '{ROLLOUT}' AND f.date >= x.first_exposition_date
    GROUP BY f.customer_id, {period}, x.variant),
running AS (SELECT *, {running} FROM periods)"""


_TOTAL_COLUMNS = {up.MAIN: TOTAL.metric, **TOTAL.parts}


def _stats_sql(name: str, source: str, prefix: str) -> str:
    parts = ", ".join(f"AVG({prefix}{a}) AS avg_{a}" for a in PARTS)
    return f""",
{name} AS (
    SELECT *, std_metric / SQRT(n_customers) AS se,
           1.96 * std_metric / SQRT(n_customers) AS moe_95
    FROM (SELECT period, variant, COUNT(DISTINCT customer_id) AS n_customers,
                 AVG({prefix}{up.MAIN}) AS avg_metric,
                 STDDEV_SAMP({prefix}{up.MAIN}) AS std_metric, {parts}
          FROM {source} GROUP BY period, variant))"""


def _difference_sql(extra: str = "") -> str:
    """Uplift columns from n_t, n_c, avg_t, avg_c, std_t, std_c."""
    return f"""SELECT *, uplift - moe_95 AS ci_lower, uplift + moe_95 AS ci_upper,
       CASE WHEN uplift - moe_95 > 0 OR uplift + moe_95 < 0 THEN 'YES' ELSE 'NO' END AS stat_sig
FROM (SELECT *, 1.96 * se_uplift AS moe_95, uplift / NULLIF(ABS(avg_c), 0) * 100 AS uplift_pct
      FROM (SELECT *, avg_t - avg_c AS uplift,
                   SQRT(POW(std_t, 2) / n_t + POW(std_c, 2) / n_c) AS se_uplift{extra}
            FROM paired))"""


def uplift_sql(stats: str, aliases: list[str] = PARTS) -> str:
    """Self-join of treatment and control stats, then the difference columns."""
    parts = "".join(f", t.avg_{a} AS avg_{a}_t, c.avg_{a} AS avg_{a}_c" for a in aliases)
    contributions = "".join(f", avg_{a}_t - avg_{a}_c AS uplift_{a}" for a in aliases)
    return f""",
paired AS (
    SELECT t.period, t.variant, t.n_customers AS n_t, c.n_customers AS n_c,
           t.avg_metric AS avg_t, c.avg_metric AS avg_c,
           t.std_metric AS std_t, c.std_metric AS std_c{parts}
    FROM {stats} t JOIN {stats} c ON t.period = c.period AND c.variant = 'control'
    WHERE t.variant <> 'control'),
uplift AS ({_difference_sql(contributions)})"""


# Fact amounts are whole minor units, so sums and means agree to the last bit;
# only what derives from a standard deviation needs rounding.
STATS_DIGITS = digits(d0=["std_metric", "se", "moe_95"])
DIFFERENCE_DIGITS = digits(d0=["std_t", "std_c", "se_uplift", "moe_95", "ci_lower", "ci_upper"])

PERIODIC_SQL = _exposed_sql(_TOTAL_COLUMNS) + _stats_sql("stats", "periods", "")
CUMULATIVE_SQL = _exposed_sql(_TOTAL_COLUMNS) + _stats_sql("stats", "running", "cum_")


# --------------------------------------------------------------------------
# queries
# --------------------------------------------------------------------------


@query(CUMULATIVE_SQL + uplift_sql("stats") + " SELECT * FROM uplift", DIFFERENCE_DIGITS)
def upl01_metric_uplift(t):
    frames = up.metric_uplift(t.exposure, t.facts_between(ROLLOUT), TOTAL, ROLLOUT, grain=GRAIN)
    return frames.cumulative_uplift.orderBy("period", "variant")


@query(with_relations("first_seen") + " SELECT * FROM first_seen")
def upl02_first_exposure(t):
    return up.first_exposure(t.exposure, ROLLOUT)


@query(_exposed_sql(_TOTAL_COLUMNS, "day") + " SELECT * FROM periods")
def upl03_daily_periods(t):
    return _periods(t, "day")


@query(_exposed_sql(_TOTAL_COLUMNS) + " SELECT * FROM periods")
def upl04_customer_periods(t):
    return _periods(t)


@query(_exposed_sql(_TOTAL_COLUMNS) + " SELECT * FROM running")
def upl05_cumulative(t):
    return up.with_running_totals(_periods(t), list(_TOTAL_COLUMNS))


@query(_exposed_sql(_TOTAL_COLUMNS) + " SELECT * FROM running")
def upl05_running_state(t):
    """The same from a state advanced by three batches; facts of some customers come late."""
    periods, late = materialise(_periods(t), "periods"), F.col("customer_id") % 10 == 3
    early = F.col("period") < "1998-04-01"
    state = RunningTotals(t.spark, new_location(t.spark, "running_totals"), list(_TOTAL_COLUMNS))
    state.advance(periods.where(early & ~late), 0)
    state.advance(periods.where(~early), 1)
    return state.advance(periods.where(early & late), 2)


@query(PERIODIC_SQL + " SELECT * FROM stats", STATS_DIGITS)
def upl06_period_stats(t):
    return _periodic_stats(t).orderBy("period", "variant")


@query(
    PERIODIC_SQL + uplift_sql("stats", []) + " SELECT * FROM uplift",
    DIFFERENCE_DIGITS,
)
def upl07_welch_uplift(t):
    return up.stats_uplift(up.period_stats(_periods(t)))


@query(
    PERIODIC_SQL
    + uplift_sql("stats")
    + " SELECT period, variant, "
    + ", ".join(f"uplift_{a}" for a in PARTS)
    + " FROM uplift"
)
def upl08_contributions(t):
    return periodic_uplift(t).select(
        "period", "variant", *[f"uplift_{a}" for a in PARTS]
    )


_LONG_SQL = _exposed_sql({n: n for n in _NAMES}) + ",\nlong_stats AS (" + " UNION ALL ".join(
    f"""SELECT '{frame}' AS frame, '{n}' AS metric, period, variant,
        COUNT(*) AS n_customers, AVG({prefix}{n}) AS avg_metric,
        STDDEV_SAMP({prefix}{n}) AS std_metric FROM running GROUP BY period, variant"""
    for frame, prefix in (("periodic", ""), ("cumulative", "cum_"))
    for n in _NAMES
) + ")"


def _read_once(sql: str) -> str:
    """The same SQL with the parts that several others read computed once."""
    for name in ("facts", "periods", "running", "long_stats"):
        sql = sql.replace(f"{name} AS (", f"{name} AS MATERIALIZED (")
    return sql


@query(_read_once(_LONG_SQL) + " SELECT * FROM long_stats", digits(d0=["std_metric"]))
def upl09_hierarchy_stats(t):
    return up.hierarchy_stats(t.exposure, t.facts_between(ROLLOUT), BRANCHES, ROLLOUT, grain=GRAIN)


_TREE_VALUES = ", ".join(
    f"('{b.name}', '{role}', '{alias}', '{source}', {sign})"
    for b in BRANCHES
    for role, alias, source, sign in [
        ("main", b.name, b.metric, 1),
        *[("part", a, s, b.sign(a)) for a, s in b.parts.items()],
    ]
)


@query(
    _read_once(_LONG_SQL)
    + f""",
paired AS MATERIALIZED (
    SELECT t.frame, t.metric, t.period, t.variant, t.n_customers AS n_t, c.n_customers AS n_c,
           t.avg_metric AS avg_t, c.avg_metric AS avg_c,
           t.std_metric AS std_t, c.std_metric AS std_c
    FROM long_stats t JOIN long_stats c
      ON t.frame = c.frame AND t.metric = c.metric AND t.period = c.period
     AND c.variant = 'control'
    WHERE t.variant <> 'control'),
uplift AS ({_difference_sql()}),
tree(branch, role, alias, metric, sign) AS (VALUES {_TREE_VALUES})
SELECT uplift.*, tree.branch, tree.role, tree.alias, tree.sign
FROM uplift JOIN tree ON uplift.metric = tree.metric""",
    DIFFERENCE_DIGITS,
)
def upl10_drill_down(t):
    stats = up.hierarchy_stats(t.exposure, t.facts_between(ROLLOUT), BRANCHES, ROLLOUT, grain=GRAIN)
    return up.drill_down(up.hierarchy_uplift(stats), BRANCHES)


@query(
    with_relations("assignment_log")
    + """ SELECT variant, COUNT(DISTINCT customer_id) AS n_customers
FROM assignment_log GROUP BY variant"""
)
def upl11_variant_sizes(t):
    return up.variant_sizes(t.assignment_log)


@query(
    with_relations("assignment_log")
    + """ SELECT customer_id, list_sort(list(DISTINCT variant)) AS variants,
       COUNT(DISTINCT variant) AS n_variants
FROM assignment_log GROUP BY customer_id HAVING COUNT(DISTINCT variant) > 1"""
)
def upl12_multi_variant(t):
    return up.multi_variant_customers(t.assignment_log)


@query(
    with_relations("facts", "holdout")
    + f""",
daily AS (
    SELECT f.customer_id, f.date AS period, h.variant,
           {", ".join(f"SUM(f.{s}) AS {n}" for n, s in _TOTAL_COLUMNS.items())}
    FROM facts f JOIN (SELECT DISTINCT customer_id, variant FROM holdout) h
      ON f.customer_id = h.customer_id
    WHERE f.date >= DATE '{PRE_START}' AND f.date < DATE '{ROLLOUT}'
    GROUP BY f.customer_id, f.date, h.variant)"""
    + _stats_sql("stats", "daily", "")
    + uplift_sql("stats")
    + f""" SELECT period, variant, n_t, n_c, ROUND(avg_t, 4) AS avg_treatment,
       ROUND(avg_c, 4) AS avg_control, ROUND(uplift, 4) AS uplift,
       ROUND(uplift_pct, 2) AS uplift_pct, stat_sig,
       {", ".join(f"ROUND(uplift_{a}, 4) AS uplift_{a}" for a in PARTS)}
FROM uplift"""
)
def upl13_pre_period_balance(t):
    return up.pre_period_balance(t.holdout, t.facts_between(PRE_START, ROLLOUT), TOTAL, PRE_START, ROLLOUT)


@query(
    with_relations("facts")
    + """, monthly AS (
    SELECT CAST(date_trunc('month', date) AS DATE) AS period, """
    + ", ".join(f"SUM({n}) AS {n}" for n in _NAMES)
    + " FROM facts GROUP BY 1) "
    + """SELECT *, parent_total - parts_total AS difference,
       ABS(parent_total - parts_total) <= 0.01 AS reconciled
FROM ("""
    + " UNION ALL ".join(
        f"SELECT period, '{b.name}' AS branch, {b.metric} AS parent_total, "
        + " + ".join(f"({b.sign(a)}) * {s}" for a, s in b.parts.items())
        + " AS parts_total FROM monthly"
        for b in BRANCHES
        if b.parts
    )
    + ")"
)
def upl14_additive_check(t):
    return up.additive_check(t.facts, BRANCHES)
