"""Periodic and cumulative uplift of value facts against a control variant.

Facts are summed to customer and date before the exposure join: the join then
carries at most one row per customer and date, whatever the customer's share
of the raw facts. All metrics of a hierarchy travel as columns of one frame,
so a report over many metrics scans and shuffles the facts once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortry.functions import flag, month_start, ratio, square

CUSTOMER = "customer_id"
VARIANT = "variant"
PERIOD = "period"
MAIN = "metric_total"
Z95 = 1.96


@dataclass(frozen=True)
class Branch:
    """A metric and the parts it is made of.

    ``parts`` maps an alias to a source column; ``negative`` names the aliases
    that are subtracted in the composition.
    """

    name: str
    metric: str
    parts: Mapping[str, str] = field(default_factory=dict)
    negative: frozenset[str] = frozenset()

    def sign(self, alias: str) -> int:
        return -1 if alias in self.negative else 1


@dataclass(frozen=True)
class UpliftFrames:
    cumulative_stats: DataFrame
    cumulative_uplift: DataFrame
    periodic_stats: DataFrame
    periodic_uplift: DataFrame


def source_columns(branches: Sequence[Branch]) -> list[str]:
    """Every fact column the branches mention, once, in first-use order."""
    seen: dict[str, None] = {}
    for branch in branches:
        for name in (branch.metric, *branch.parts.values()):
            seen.setdefault(name)
    return list(seen)


def period_of(date: Column, grain: str) -> Column:
    """The date itself at day grain, the month's first day at month grain."""
    if grain not in ("day", "month"):
        raise ValueError(f"unknown grain: {grain!r}")
    return date if grain == "day" else month_start(date)


def _within(df: DataFrame, column: str, start: str, end: str | None) -> DataFrame:
    df = df.filter(F.col(column) >= F.lit(start).cast("date"))
    return df if not end else df.filter(F.col(column) <= F.lit(end).cast("date"))


def first_exposure(exposure: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """First exposure date per customer and variant within the window."""
    return (
        _within(exposure, "exposition_date", start, end)
        .groupBy(CUSTOMER, VARIANT)
        .agg(F.min("exposition_date").alias("first_exposition_date"))
    )


def daily_totals(facts: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """Sum of each metric per customer and date. ``metrics`` is name -> column."""
    return facts.groupBy(CUSTOMER, "date").agg(
        *[F.sum(source).alias(name) for name, source in metrics.items()]
    )


def customer_periods(
    facts: DataFrame,
    exposure: DataFrame,
    metrics: Mapping[str, str],
    start: str,
    end: str | None = None,
    grain: str = "day",
) -> DataFrame:
    """Metric sums per customer, period and variant from first exposure on."""
    exposed = daily_totals(_within(facts, "date", start, end), metrics).join(
        first_exposure(exposure, start, end), CUSTOMER, "inner"
    )
    return (
        exposed.filter(F.col("date") >= F.col("first_exposition_date"))
        .groupBy(CUSTOMER, period_of(F.col("date"), grain).alias(PERIOD), VARIANT)
        .agg(*[F.sum(name).alias(name) for name in metrics])
    )


def with_running_totals(periods: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Add ``cum_*`` columns: the running sum over a customer's own periods.

    A period in which the customer has no row gets none; nothing is filled.
    """
    running = (
        Window.partitionBy(CUSTOMER, VARIANT)
        .orderBy(PERIOD)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return periods.select(
        "*", *[F.sum(name).over(running).alias(f"cum_{name}") for name in metrics]
    )


def period_stats(
    periods: DataFrame, main: str = MAIN, parts: Mapping[str, str] | None = None
) -> DataFrame:
    """Customers, mean, deviation and confidence margin per period and variant.

    ``periods`` has one row per customer, period and variant, so counting rows
    counts customers. ``parts`` maps an alias to the column that is averaged.
    """
    parts = parts or {}
    return (
        periods.groupBy(PERIOD, VARIANT)
        .agg(
            F.count(CUSTOMER).alias("n_customers"),
            F.avg(main).alias("avg_metric"),
            F.stddev_samp(main).alias("std_metric"),
            *[F.avg(source).alias(f"avg_{alias}") for alias, source in parts.items()],
        )
        .withColumn("se", F.col("std_metric") / F.sqrt("n_customers"))
        .withColumn("moe_95", F.lit(Z95) * F.col("se"))
    )


def _difference_columns() -> dict[str, Column]:
    """Welch-style difference of ``*_t`` and ``*_c`` columns."""
    uplift = F.col("avg_t") - F.col("avg_c")
    error = F.sqrt(square(F.col("std_t")) / F.col("n_t") + square(F.col("std_c")) / F.col("n_c"))
    margin = F.lit(Z95) * error
    return {
        "uplift": uplift,
        "se_uplift": error,
        "moe_95": margin,
        "uplift_pct": ratio(uplift, F.abs(F.col("avg_c"))) * 100,
        "ci_lower": uplift - margin,
        "ci_upper": uplift + margin,
        "stat_sig": F.when(
            ((uplift - margin) > 0) | ((uplift + margin) < 0), F.lit("YES")
        ).otherwise(F.lit("NO")),
    }


def uplift_against_control(
    stats: DataFrame,
    values: Mapping[str, str],
    cell: Sequence[str] = (PERIOD,),
    control: str = "control",
) -> DataFrame:
    """Pair every non-control row of a cell with its control row.

    ``values`` maps a stats column to its output stem; each appears as
    ``<stem>_t`` and ``<stem>_c``. Cells without control rows are dropped, as
    are rows without a variant. Several treatment variants keep a row each.
    """
    window = Window.partitionBy(*cell)
    is_control = F.col(VARIANT) == control
    paired = stats.select(
        *cell,
        VARIANT,
        *[F.col(source).alias(f"{stem}_t") for source, stem in values.items()],
        *[
            F.max(F.when(is_control, F.col(source))).over(window).alias(f"{stem}_c")
            for source, stem in values.items()
        ],
        F.max(flag(is_control)).over(window).alias("_has_control"),
    )
    return (
        paired.filter((F.col(VARIANT) != control) & (F.col("_has_control") == 1))
        .drop("_has_control")
        .withColumns(_difference_columns())
    )


_MAIN_VALUES = {"n_customers": "n", "avg_metric": "avg", "std_metric": "std"}


def stats_uplift(
    stats: DataFrame, aliases: Sequence[str] = (), control: str = "control"
) -> DataFrame:
    """Uplift of a ``period_stats`` frame, with ``uplift_<alias>`` contributions."""
    values = {**_MAIN_VALUES, **{f"avg_{a}": f"avg_{a}" for a in aliases}}
    return uplift_against_control(stats, values, control=control).withColumns(
        {f"uplift_{a}": F.col(f"avg_{a}_t") - F.col(f"avg_{a}_c") for a in aliases}
    )


def metric_uplift(
    exposure: DataFrame,
    facts: DataFrame,
    branch: Branch,
    rollout_date: str,
    end_date: str | None = None,
    grain: str = "day",
    control: str = "control",
) -> UpliftFrames:
    """Periodic and cumulative stats and uplift of one metric and its parts.

    The frames are not ordered; sort by period and variant to show them.
    """
    metrics = {MAIN: branch.metric, **branch.parts}
    aliases = list(branch.parts)
    periods = with_running_totals(
        customer_periods(facts, exposure, metrics, rollout_date, end_date, grain), list(metrics)
    )
    periodic = period_stats(periods, MAIN, {a: a for a in aliases})
    cumulative = period_stats(periods, f"cum_{MAIN}", {a: f"cum_{a}" for a in aliases})
    return UpliftFrames(
        cumulative_stats=cumulative,
        cumulative_uplift=stats_uplift(cumulative, aliases, control),
        periodic_stats=periodic,
        periodic_uplift=stats_uplift(periodic, aliases, control),
    )


# --------------------------------------------------------------------------
# all metrics of a hierarchy in one pass
# --------------------------------------------------------------------------


def hierarchy_stats(
    exposure: DataFrame,
    facts: DataFrame,
    branches: Sequence[Branch],
    rollout_date: str,
    end_date: str | None = None,
    grain: str = "month",
) -> DataFrame:
    """Long stats: frame, metric, period, variant, n_customers, avg, std.

    Periodic and cumulative statistics of every metric come from a single
    aggregation; only its few period-by-variant rows are turned long.
    """
    names = source_columns(branches)
    periods = with_running_totals(
        customer_periods(facts, exposure, {n: n for n in names}, rollout_date, end_date, grain),
        names,
    )
    measured = [("periodic", n, n) for n in names] + [("cumulative", n, f"cum_{n}") for n in names]
    wide = periods.groupBy(PERIOD, VARIANT).agg(
        F.count(CUSTOMER).alias("n_customers"),
        *[F.avg(column).alias(f"avg_{column}") for _, _, column in measured],
        *[F.stddev_samp(column).alias(f"std_{column}") for _, _, column in measured],
    )
    entries = [
        F.struct(
            F.lit(frame).alias("frame"),
            F.lit(name).alias("metric"),
            F.col(f"avg_{column}").alias("avg_metric"),
            F.col(f"std_{column}").alias("std_metric"),
        )
        for frame, name, column in measured
    ]
    return wide.select(PERIOD, VARIANT, "n_customers", F.inline(F.array(*entries)))


def hierarchy_uplift(stats: DataFrame, control: str = "control") -> DataFrame:
    """Uplift of every metric in a ``hierarchy_stats`` frame."""
    return uplift_against_control(
        stats, _MAIN_VALUES, cell=("frame", "metric", PERIOD), control=control
    )


def drill_down(uplift: DataFrame, branches: Sequence[Branch]) -> DataFrame:
    """Rows per branch: its own uplift (role ``main``) and each part's.

    The branch list is configuration, a few dozen rows at most.
    """
    spark = uplift.sparkSession
    rows = []
    for branch in branches:
        rows.append((branch.name, "main", branch.name, branch.metric, 1))
        rows += [
            (branch.name, "part", alias, source, branch.sign(alias))
            for alias, source in branch.parts.items()
        ]
    tree = spark.createDataFrame(
        rows, "branch string, role string, alias string, metric string, sign int"
    )
    return uplift.join(tree, "metric", "inner")


# --------------------------------------------------------------------------
# sanity frames
# --------------------------------------------------------------------------


def variant_sizes(assignments: DataFrame) -> DataFrame:
    """Distinct customers per variant."""
    return (
        assignments.groupBy(VARIANT)
        .agg(F.count_distinct(CUSTOMER).alias("n_customers"))
        .orderBy(VARIANT)
    )


def multi_variant_customers(assignments: DataFrame) -> DataFrame:
    """Customers assigned to more than one variant, with the sorted variants.

    The set holds variant labels, whose number the experiment fixes.
    """
    return (
        assignments.groupBy(CUSTOMER)
        .agg(F.array_sort(F.collect_set(VARIANT)).alias("variants"))
        .withColumn("n_variants", F.size("variants").cast("bigint"))
        .filter(F.col("n_variants") > 1)
    )


def null_counts(
    facts: DataFrame,
    exposure: DataFrame,
    branches: Sequence[Branch],
    start: str,
    end: str | None = None,
    grain: str = "day",
) -> DataFrame:
    """Customers per period, variant and metric, and how many have no value.

    A mean covers the customers with a value only; here one sees how many
    that leaves out.
    """
    names = source_columns(branches)
    periods = customer_periods(facts, exposure, {n: n for n in names}, start, end, grain)
    counted = periods.groupBy(PERIOD, VARIANT).agg(
        F.count(F.lit(1)).alias("n_customers"),
        *[F.count_if(F.col(n).isNull()).alias(f"_null_{n}") for n in names],
    )
    entries = [
        F.struct(F.lit(n).alias("metric"), F.col(f"_null_{n}").alias("null_customers")) for n in names
    ]
    return counted.select(PERIOD, VARIANT, "n_customers", F.inline(F.array(*entries)))


def pre_period_balance(
    assignments: DataFrame,
    facts: DataFrame,
    branch: Branch,
    start: str,
    rollout_date: str,
    control: str = "control",
) -> DataFrame:
    """Daily uplift in the half-open window before roll-out.

    Uses the assignment without any exposure filter: the arms should agree.
    """
    metrics = {MAIN: branch.metric, **branch.parts}
    aliases = list(branch.parts)
    before = facts.filter(
        (F.col("date") >= F.lit(start).cast("date"))
        & (F.col("date") < F.lit(rollout_date).cast("date"))
    )
    periods = (
        daily_totals(before, metrics)
        .join(assignments.select(CUSTOMER, VARIANT).distinct(), CUSTOMER, "inner")
        .withColumnRenamed("date", PERIOD)
    )
    uplift = stats_uplift(period_stats(periods, MAIN, {a: a for a in aliases}), aliases, control)
    return uplift.select(
        PERIOD,
        VARIANT,
        "n_t",
        "n_c",
        F.round("avg_t", 4).alias("avg_treatment"),
        F.round("avg_c", 4).alias("avg_control"),
        F.round("uplift", 4).alias("uplift"),
        F.round("uplift_pct", 2).alias("uplift_pct"),
        "stat_sig",
        *[F.round(f"uplift_{a}", 4).alias(f"uplift_{a}") for a in aliases],
    ).orderBy(PERIOD, VARIANT)


def additive_check(
    facts: DataFrame, branches: Sequence[Branch], tolerance: float = 0.01, grain: str = "month"
) -> DataFrame:
    """Does each parent equal the signed sum of its parts, period by period?"""
    parents = [b for b in branches if b.parts]
    names = source_columns(parents)
    totals = facts.groupBy(period_of(F.col("date"), grain).alias(PERIOD)).agg(
        *[F.sum(n).alias(n) for n in names]
    )
    entries = [
        F.struct(
            F.lit(b.name).alias("branch"),
            F.col(b.metric).alias("parent_total"),
            sum(
                (F.lit(b.sign(a)) * F.col(source) for a, source in b.parts.items()), F.lit(0.0)
            ).alias("parts_total"),
        )
        for b in parents
    ]
    gap = F.col("parent_total") - F.col("parts_total")
    return (
        totals.select(PERIOD, F.inline(F.array(*entries)))
        .withColumn("difference", gap)
        .withColumn("reconciled", F.coalesce(F.abs(gap) <= tolerance, F.lit(False)))
    )
