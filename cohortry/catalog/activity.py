"""Merged change requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry.catalog._base import mean_sql, query
from cohortry.functions import matching_lines, occurrences
from cohortry.operators import activity as act
from cohortry.sources.standins import (
    FIELDS,
    MERGED_SINCE,
    SIGNATURES,
    SINGLE_OUTPUT,
    Standins,
    with_relations,
)


def _merged(t: Standins):
    return act.merged_requests(t.change_requests, MERGED_SINCE)


def _tooled(t: Standins):
    return act.attributed(_merged(t), SIGNATURES)


def _estimated(t: Standins):
    return act.with_estimated_outputs(_tooled(t), SINGLE_OUTPUT)


_MONTH = "CAST(date_trunc('month', merged_at) AS DATE)"
_LABEL = "strftime(merged_at, '%Y-%m')"


def _hours(places: int) -> str:
    return f"ROUND((epoch(merged_at) - epoch(created_at)) / 3600, {places})"


@query(with_relations("merged") + " SELECT * FROM merged")
def act01_merged_requests(t):
    return _merged(t)


@query(with_relations("tooled") + " SELECT * FROM tooled")
def act02_attributed(t):
    return _tooled(t)


@query(
    with_relations("tooled")
    + f""" SELECT {_MONTH} AS month, tool, COUNT(DISTINCT request_id) AS total_requests,
       COUNT(DISTINCT author) AS unique_authors,
       CAST(SUM(added_lines) AS BIGINT) AS total_lines_added,
       CAST(SUM(deleted_lines) AS BIGINT) AS total_lines_deleted,
       CAST(SUM(changed_files) AS BIGINT) AS total_files_changed
FROM tooled GROUP BY 1, 2"""
)
def act03_monthly_volume(t):
    return act.monthly_volume(_tooled(t))


@query(
    with_relations("tooled")
    + f""" SELECT {_MONTH} AS month, tool, author, COUNT(DISTINCT request_id) AS requests_merged,
       CAST(SUM(added_lines) AS BIGINT) AS lines_added,
       CAST(SUM(deleted_lines) AS BIGINT) AS lines_deleted
FROM tooled GROUP BY 1, 2, 3"""
)
def act04_by_author(t):
    return act.by_author(_tooled(t))


@query(
    with_relations("tooled")
    + f""" SELECT {_MONTH} AS month, tool, {mean_sql(_hours(1), 1, 1)} AS avg_hours_to_merge,
       MIN({_hours(1)}) AS min_hours, MAX({_hours(1)}) AS max_hours,
       COUNT(DISTINCT request_id) AS total_requests
FROM tooled GROUP BY 1, 2"""
)
def act05_lead_time(t):
    return act.lead_time(_tooled(t))


@query(
    with_relations("tooled")
    + f""" SELECT {_LABEL} AS month, tool, repo_name, request_id, author, title, added_lines,
       deleted_lines, changed_files, {_hours(0)} AS hours_to_merge, merged_at
FROM tooled"""
)
def act06_request_list(t):
    return act.request_list(_tooled(t), ordered=False)


@query(with_relations("estimated") + " SELECT * EXCLUDE (types, bullets) FROM estimated")
def act07_estimated_outputs(t):
    return _estimated(t)


@query(
    r"""SELECT doc_id, len(string_split(text, '**')) - 1 AS bold_markers,
       len(list_filter(string_split(text, E'\n'), lambda x: regexp_matches(x, '^[A-Z][a-z]+ ')))
           AS capitalised_lines
FROM documents"""
)
def act07_marker_counts(t):
    """The two counts behind the estimate, over the whole document texts."""
    text = F.col("text")
    return t.table("documents").select(
        "doc_id",
        occurrences(text, r"\*\*").cast("bigint").alias("bold_markers"),
        matching_lines(text, "^[A-Z][a-z]+ ").cast("bigint").alias("capitalised_lines"),
    )


@query(
    with_relations("estimated")
    + f""" SELECT {_LABEL} AS month, tool, request_id, author, title, estimated_outputs, merged_at
FROM estimated"""
)
def act08_output_list(t):
    return act.output_list(_estimated(t), ordered=False)


@query(
    with_relations("estimated")
    + f""" SELECT {_MONTH} AS month, COUNT(DISTINCT request_id) AS total_requests,
       CAST(SUM(estimated_outputs) AS BIGINT) AS total_outputs,
       {mean_sql("estimated_outputs", 0, 1)} AS avg_outputs_per_request,
       COUNT(DISTINCT author) AS unique_authors
FROM estimated GROUP BY 1"""
)
def act09_monthly_outputs(t):
    return act.monthly_outputs(_estimated(t))


@query(
    with_relations("estimated")
    + """ SELECT CAST(SUM(estimated_outputs) AS BIGINT) AS total_outputs_to_date,
       COUNT(DISTINCT request_id) AS total_requests_to_date,
       COUNT(DISTINCT author) AS unique_authors_to_date
FROM estimated"""
)
def act10_outputs_to_date(t):
    return act.outputs_to_date(_estimated(t))


# DuckDB keeps the null of a null text.
_FIELDS_SQL = ", ".join(f"regexp_extract({f.column}, '{f.pattern}', 1) AS {f.name}" for f in FIELDS)


@query(
    with_relations("estimated")
    + f""" SELECT {_LABEL} AS month, tool, request_id, author, title, {_FIELDS_SQL},
       estimated_outputs, merged_at
FROM estimated"""
)
def act11_request_content(t):
    return act.request_content(_estimated(t), FIELDS, ordered=False)
