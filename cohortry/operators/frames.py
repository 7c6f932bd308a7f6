"""Chart-ready frames: the data behind uplift and forest plots."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERIOD = "period"
Z95 = 1.96


def arm_bands(uplift: DataFrame) -> DataFrame:
    """Mean and confidence band of each arm, one row per period, variant and arm."""

    def arm(name: str, suffix: str):
        mean = F.col(f"avg_{suffix}")
        margin = F.lit(Z95) * F.col(f"std_{suffix}") / F.sqrt(F.col(f"n_{suffix}"))
        return F.struct(
            F.lit(name).alias("arm"),
            F.col(f"n_{suffix}").alias("n_customers"),
            mean.alias("mean"),
            (mean - margin).alias("lower"),
            (mean + margin).alias("upper"),
        )

    return uplift.select(
        PERIOD, "variant", F.inline(F.array(arm("treatment", "t"), arm("control", "c")))
    )


def contribution_columns(uplift: DataFrame) -> list[str]:
    """The ``uplift_<alias>`` columns of an uplift frame."""
    return [c for c in uplift.columns if c.startswith("uplift_") and c != "uplift_pct"]


def contributions_long(uplift: DataFrame) -> DataFrame:
    """Period, variant, product and the product's contribution."""
    columns = contribution_columns(uplift)
    return uplift.unpivot(
        [PERIOD, "variant"], columns, "product", "contribution"
    ).withColumn("product", F.regexp_replace("product", "^uplift_", ""))


def stacked_contributions(long: DataFrame, order: Sequence[str]) -> DataFrame:
    """Where each product's bar starts and ends, positives up, negatives down.

    ``order`` is the stacking order. A window holds one period's products.
    """
    position = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("product"))
    before = (
        Window.partitionBy(PERIOD, "variant")
        .orderBy("position")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    value = F.col("contribution")
    rising, falling = F.when(value > 0, value).otherwise(0.0), F.when(value < 0, value).otherwise(0.0)
    return (
        long.withColumn("position", position)
        .select(
            "*",
            F.coalesce(F.sum(rising).over(before), F.lit(0.0)).alias("_rising"),
            F.coalesce(F.sum(falling).over(before), F.lit(0.0)).alias("_falling"),
        )
        .withColumn("base", F.when(value < 0, F.col("_falling")).otherwise(F.col("_rising")))
        .withColumn("top", F.col("base") + value)
        .drop("_rising", "_falling")
    )


def contribution_matrix(
    uplift: DataFrame, variant: str, periods: Sequence[str], total: str = "Total"
) -> DataFrame:
    """Products as rows, the given periods as columns, and a total row.

    A row of a period that is not given stops the job rather than going missing.
    """
    arm = uplift.filter(F.col("variant") == variant)
    label = F.date_format(PERIOD, "yyyy-MM-dd")
    outside = F.raise_error(F.concat(F.lit("period outside the matrix: "), label))
    return (
        contributions_long(arm.withColumnRenamed("uplift", f"uplift_{total}"))
        .withColumn(PERIOD, F.when(label.isin(*periods), label).otherwise(outside))
        .groupBy("product")
        .pivot(PERIOD, list(periods))
        .agg(F.first("contribution"))
    )


def months_between(start: str, end: str) -> list[str]:
    """The first day of every month from the month of ``start`` to that of ``end``."""
    first, last = date.fromisoformat(start), date.fromisoformat(end)
    months = range(first.year * 12 + first.month - 1, last.year * 12 + last.month)
    return [date(m // 12, m % 12 + 1, 1).isoformat() for m in months]


def grain_of(frame: DataFrame, threshold_days: int = 15) -> DataFrame:
    """One row: the average gap between distinct periods, and the grain it implies."""
    return (
        frame.select(PERIOD)
        .distinct()
        .agg(
            F.count(F.lit(1)).alias("periods"),
            F.try_divide(
                F.datediff(F.max(PERIOD), F.min(PERIOD)), F.count(F.lit(1)) - F.lit(1)
            ).alias("avg_gap_days"),
        )
        .withColumn(
            "grain",
            F.when(F.col("avg_gap_days") < threshold_days, F.lit("day")).otherwise(F.lit("month")),
        )
    )


def forest_rows(summary: DataFrame) -> DataFrame:
    """Point and interval in percent per segment and metric."""
    return summary.select(
        "segment",
        "metric_name",
        (F.col("delta_relative") * 100).alias("delta"),
        (F.col("IC_lower") * 100).alias("lower"),
        (F.col("IC_upper") * 100).alias("upper"),
        (F.col("stat_sig") == "stat-sig").alias("significant"),
    )
