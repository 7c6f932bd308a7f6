"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame of documents;
its result is written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortry.llm import decontamination, mixing, near_duplicates, personal_data, toxicity
from cohortry.llm.common import prepared, shared_folder, table

# No SQL can state the toxicity model; the stages are tested one by one.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose expected severity reaches the limit."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    prepared(spark)
    return near_duplicates.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold benchmark passages."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    prepared(spark)
    return personal_data.masked(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    prepared(spark)
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_deduplication),
    ("decontamination", benchmark_decontamination),
    ("personal_data", personal_data_masking),
    ("mixing", source_mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, with each result written and read again.

    The files lie in the cluster's shared folder, where a lost executor does
    not take them along.
    """
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        result = stage(spark, docs, sf_dir)
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
    return docs
