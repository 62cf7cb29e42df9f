"""Corpus cleaning in five stages, each an operator of ``strandspark.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; whoever runs the pipeline writes each
result as Parquet and reads it back as the next stage's ``docs``. All stages but the last return the
columns of documents; the last adds the copy's number.

Defined results: null and empty texts are documents like any other and near-duplicates of one another;
rows that repeat an id are judged each, but of those that name a group one stays; ties go to the smaller
id; a very long text is read whole; further columns are kept, whatever their names; an empty table gives
an empty table, and without labels to learn from no document is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandspark.llm import decontaminate, line_dedup, mixing, quality, simhash
from strandspark.llm.common import free_name, one_label, table
from strandspark.session import drop, write_scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the labels of all documents are learned."""
    return quality.keep_quality(docs, one_label(table(spark, sf_dir, "labels"), "quality"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated blocks of lines go from later documents, and documents that nothing is left of; n_chars follows the text."""
    count = free_name(docs, "lines_removed")
    out = line_dedup.remove_repeats(docs).where((F.col(count) == 0) | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        chars = F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", chars)
    return out.select(docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return simhash.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go; others stay as they are."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets an equal share of as many rows as there are, in a global shuffle."""
    return mixing.mix(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_near_dedup", simhash_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("mix_sources", mixing_stage),
]

#: Fitted, hashed and aligned stages are beyond SQL; tests/llm/test_pipeline.py holds them against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written once to the shared folder."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        schema, before, path = out.schema, path, write_scratch(out, name)
        docs = spark.read.schema(schema).parquet(path)
        if before:
            drop(spark, before)
    return docs
