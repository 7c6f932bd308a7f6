"""Staged dimensions, bucketed stages, incremental writes, mergeable states, named windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.catalog import experiment, offers, uplift
from cohortry.catalog._base import query
from cohortry.operators import engagement as eng
from cohortry.operators import experiment as exp
from cohortry.operators import states
from cohortry.operators import uplift as up
from cohortry.sources import incremental, sinks
from cohortry.sources.buckets import BucketedStages
from cohortry.sources.dimensions import StagedDimensions
from cohortry.sources.standins import AS_OF, ROLLOUT, Standins, with_relations

_PRODUCTS_SQL = "LEFT JOIN (SELECT DISTINCT id, product FROM journeys) j ON a.journey_id = j.id"


# -- staged dimensions -------------------------------------------------------


def shared_dimension(t: Standins, dimensions: StagedDimensions):
    """Archived eligibility and assignments, both looked up in one staged dimension."""
    dimensions.add("journey_products", t.journey_products, ["journey_id"])
    pairs = eng.union_all(
        a.where(F.col("target_date") >= F.date_sub(F.lit(AS_OF).cast("date"), 30)).select("journey_id", "customer_id")
        for a in t.archives.values()
    ).distinct()
    eligible = dimensions.looked_up(pairs, "journey_products", ["journey_id"])
    assigned = t.assignments.groupBy("journey_id").agg(F.count(F.lit(1)).alias("rows"))
    assigned = dimensions.looked_up(assigned, "journey_products", ["journey_id"])
    return (
        eligible.groupBy("product")
        .agg(F.count_distinct("customer_id").alias("total"))
        .select(F.lit("eligible customers").alias("measure"), "product", "total")
        .unionByName(
            assigned.groupBy("product")
            .agg(F.sum("rows").alias("total"))
            .select(F.lit("assignments").alias("measure"), "product", "total")
        )
    )


@query(
    with_relations("archives", "assignments", "journeys")
    + f""" SELECT 'eligible customers' AS measure, j.product, COUNT(DISTINCT a.customer_id) AS total
FROM archives a {_PRODUCTS_SQL} WHERE a.target_date >= DATE '{AS_OF}' - 30 GROUP BY j.product
UNION ALL
SELECT 'assignments', j.product, COUNT(*) FROM assignments a {_PRODUCTS_SQL} GROUP BY j.product"""
)
def snk09_shared_dimension(t):
    return shared_dimension(t, StagedDimensions())


# -- bucketed stages ---------------------------------------------------------

_TOTALS = {up.MAIN: uplift.TOTAL.metric, **uplift.TOTAL.parts}


def running_totals(facts, exposure):
    """Periodic and running totals per customer, each customer on their own."""
    periods = up.customer_periods(facts, exposure, _TOTALS, ROLLOUT, grain=uplift.GRAIN)
    return up.with_running_totals(periods, list(_TOTALS))


@query(uplift._exposed_sql(_TOTALS) + " SELECT * FROM running")
def joi01_bucketed_exposure(t):
    """The exposure join, both folds and the running window on buckets of the customer."""
    stages = BucketedStages({"facts": t.facts_between(ROLLOUT), "exposure": t.exposure}, up.CUSTOMER)
    return stages.per_key(running_totals, "facts", "exposure")


@query(with_relations("assigned") + " SELECT * FROM assigned")
def joi01_bucketed_assignment(t):
    """Row-level bills with the variant and segment of their customer, both in buckets."""
    stages = BucketedStages({"base": experiment._base(t), "assignments": t.holdout}, exp.CUSTOMER)
    return stages.per_key(
        lambda base, assignments: exp.attach_assignment(base, assignments, experiment.EXCLUDED_SEGMENT),
        "base",
        "assignments",
    )


# -- incremental writes ------------------------------------------------------


@query(
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus,
       CAST(year(CAST(o_orderdate AS DATE)) AS INTEGER)
         + CASE WHEN o_orderkey % 97 = 0 AND year(CAST(o_orderdate AS DATE)) < 1996 THEN 1 ELSE 0 END AS year
FROM orders"""
)
def snk10_merged_partitions(t):
    """Orders by year; updates change some and move a part of them to the next year."""
    year = F.year(F.to_date("o_orderdate"))
    orders = t.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", year.alias("year"))
    path = sinks.new_location(t.spark, "orders_by_year")
    sinks.overwrite_partitions(orders, path, ["year"])
    moved = F.col("year") + F.when(F.col("year") < 1996, 1).otherwise(0)
    updates = orders.where("o_orderkey % 97 = 0").withColumns({"o_orderstatus": F.lit("M"), "year": moved})
    return incremental.merge_partitions(path, updates, ["o_orderkey"], ["year"])


@query(
    """SELECT CAST(o_orderkey AS BIGINT) AS order_id, CAST(o_totalprice AS DOUBLE) AS price,
       CASE WHEN o_orderkey % 2 = 1 THEN o_orderpriority END AS priority
FROM orders"""
)
def snk01_generations(t):
    """Two generations of one dataset: the later has a wider key and one more column."""
    orders = t.table("orders")
    early, late = (sinks.new_location(t.spark, f"generation_{n}") for n in (1, 2))
    key = F.col("o_orderkey")
    orders.where("o_orderkey % 2 = 0").select(
        key.cast("int").alias("order_id"), F.col("o_totalprice").cast("double").alias("price")
    ).write.parquet(early)
    orders.where("o_orderkey % 2 = 1").select(
        key.cast("long").alias("order_id"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").cast("double").alias("price"),
    ).write.parquet(late)
    schema = T.StructType().add("order_id", "long").add("price", "double").add("priority", "string")
    return incremental.generations(t.spark, [early, late], schema)


@query(
    with_relations("archives", "journeys")
    + f""" SELECT j.product, COUNT(DISTINCT a.customer_id) AS total_eligibles
FROM archives a {_PRODUCTS_SQL}
WHERE a.target_date BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' AND dayofweek(a.target_date) = 1
GROUP BY j.product"""
)
def src04_partitioned_archives(t):
    """Eligibility on the Mondays before a date, from archives with a folder per month."""
    archive = incremental.archived(t.archives.values(), sinks.new_location(t.spark, "archives"), "target_date")
    return mondays_of(archive, t)


def mondays_of(archive, t: Standins):
    day = F.date_sub(F.lit(AS_OF).cast("date"), F.col("id").cast("int")).alias("target_date")
    mondays = t.spark.range(31).select(day).where(F.dayofweek("target_date") == 2)
    pairs = incremental.on_days(archive, mondays, "target_date").select("journey_id", "customer_id").distinct()
    return (
        pairs.join(t.journey_products, "journey_id", "left")
        .groupBy("product")
        .agg(F.count_distinct("customer_id").alias("total_eligibles"))
    )


@query(
    with_relations("eligibility")
    + """ SELECT COUNT(*) AS rows, COUNT(*) - COUNT(customer_id) AS customer_id_nulls,
       COUNT(*) - COUNT(offered_rate) AS offered_rate_nulls,
       COUNT(*) - COUNT(max_eligible_amount) AS max_eligible_amount_nulls, COUNT(*) AS stored_rows
FROM eligibility"""
)
def dq05_profile_of_a_write(t):
    """Rows and nulls of a stage, known from the job that wrote it, and the rows it holds."""
    metrics = incremental.profile_metrics(["customer_id", "offered_rate", "max_eligible_amount"])
    stage, seen = incremental.materialise_observed(offers.eligibility(t), "eligibility", metrics)
    return stage.agg(*[F.lit(seen[name]).alias(name) for name in metrics], F.count(F.lit(1)).alias("stored_rows"))


# -- mergeable states --------------------------------------------------------


def archived_rows(t: Standins):
    """Archive rows with their product."""
    return eng.union_all(t.archives.values()).join(t.journey_products, "journey_id", "left")


_ROLLING_SQL = with_relations("archives", "journeys") + f""", windows AS (
    SELECT j.product, a.customer_id, a.target_date + CAST(unnest(range(0, 30)) AS INTEGER) AS as_of
    FROM (SELECT DISTINCT journey_id, customer_id, target_date FROM archives) a {_PRODUCTS_SQL})
SELECT product, as_of, COUNT(DISTINCT customer_id) AS total_eligibles{{more}}
FROM windows WHERE as_of <= DATE '{AS_OF}' GROUP BY product, as_of"""


@query(_ROLLING_SQL.format(more=""))
def agg03_rolling_states(t):
    """Customers eligible in the thirty days up to each day, from one bitmap set per day."""
    daily = sinks.materialise(
        states.daily_bitmaps(archived_rows(t), ["product"], "target_date", "customer_id"), "daily_bitmaps"
    )
    found = states.rolling_count(daily, ["product"], "target_date", until=F.lit(AS_OF).cast("date"))
    return found.withColumnRenamed("entities", "total_eligibles")


@query(_ROLLING_SQL.format(more=", TRUE AS within_bound"))
def agg03_rolling_sketches(t):
    """The same from sketches, and whether they err by five standard errors at most."""
    rows, until = archived_rows(t), F.lit(AS_OF).cast("date")
    daily = sinks.materialise(states.daily_sketches(rows, ["product"], "target_date", "customer_id"), "daily_sketches")
    estimated = states.rolling_estimate(daily, ["product"], "target_date", until=until).select(
        F.col("product").alias("its_product"), F.col("as_of").alias("its_day"), F.col("entities").alias("estimate")
    )
    exact = agg03_rolling_states(t)
    same = F.col("product").eqNullSafe(F.col("its_product")) & (F.col("as_of") == F.col("its_day"))
    error = 5 * 1.04 / 2 ** (states.SKETCH_BITS / 2)
    bound = F.greatest(F.lit(1.0), F.col("total_eligibles") * error)
    return exact.join(estimated, same).select(
        "product",
        "as_of",
        "total_eligibles",
        (F.abs(F.col("estimate") - F.col("total_eligibles")) <= bound).alias("within_bound"),
    )


# -- named windows -----------------------------------------------------------


@query(
    with_relations("target_segment")
    + """ SELECT customer_id, contracted_product, best_alternative_product, max_saving
FROM target_segment""",
    {"max_saving": 2},
)
def win02_named_window(t):
    """First values over a named window in SQL: every row is sorted, unlike in win02_first_value."""
    return t.spark.sql(
        """SELECT customer_id, contracted_product, best_alternative_product, max_saving FROM (
            SELECT customer_id,
                FIRST_VALUE(contracted_product) OVER best AS contracted_product,
                FIRST_VALUE(alternative_product) OVER best AS best_alternative_product,
                FIRST_VALUE(saving) OVER best AS max_saving,
                ROW_NUMBER() OVER best AS place
            FROM {suboptimal}
            WINDOW best AS (
                PARTITION BY customer_id
                ORDER BY saving DESC, contract_date DESC, alternative_product, contract_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        WHERE place = 1""",
        suboptimal=offers.suboptimal(t),
    )
