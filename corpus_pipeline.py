"""The corpus pipeline: quality rules, quality classifier, near duplicates, decontamination, packing.

Each stage takes the rows its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archivemill.llm import op2_quality_rules, op4_chosen_path, op7_decontamination, op8_line_crf, op9_packing
from archivemill.llm.shared import prepared, word_count
from archivemill.plans.staging import staging_root


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the n-gram ratio rules keep; trusted are the rows labelled good."""
    prepared(spark)
    trusted = op2_quality_rules.trusted_texts(docs.select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return op2_quality_rules.accepted(docs, op2_quality_rules.log_ratios(docs, trusted))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the field over lines predicts good."""
    prepared(spark)
    return op8_line_crf.accepted(docs, op8_line_crf.train(docs, _table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts."""
    prepared(spark)
    return op4_chosen_path.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the benchmark's passages; n_chars follows the text."""
    prepared(spark)
    cleaned = op7_decontamination.cleaned(docs, _table(spark, sf_dir, "benchmark"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's batch."""
    prepared(spark)
    return op9_packing.pack(docs, word_count(docs["text"]))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The classifier, the join and the boundaries are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _table(spark, sf_dir, "documents"), f"{staging_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
