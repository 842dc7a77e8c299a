"""Corpus pipeline: quality rules, line dedup, near-duplicate join, decontamination, packing.

Each stage is (name, function of (spark, docs, sf_dir)) and works on all that its predecessor
kept; all but the last return the columns of documents. Null, empty and repeated rows are treated
as the operators' docstrings define. A stage's tables are removed when its result is written, and that when the next one is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm.compression_rules import filter_quality, fit_bands
from tickloom.llm.fuzzy_lines import dedup_lines
from tickloom.llm.latent_decontam import drop_leaked
from tickloom.llm.ngram_join import keep_one_of_near
from tickloom.llm.packing import pack_documents
from tickloom.llm.staging import materialise, release, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repetitive or incompressible documents; the table labels fits the limits."""
    return filter_quality(docs, bands=fit_bands(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that repeat an earlier one."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences."""
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary() as keep:
            kept = keep(materialise(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
