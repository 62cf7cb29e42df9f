"""Small helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, n: int = 5) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids fall into no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """One 0/1 label per document: repeated rows agree on the largest, null labels are no labels."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or with underscores appended until ``df`` has no such column (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Rows of a key from which it is hot, and how many hot keys there may be.
HOT_ROWS, HOT_KEYS = 5_000, 20_000


def join_counted(left: DataFrame, right: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """Inner join with ``right``, one row a key, whose ``n`` says how many of ``left``'s ``total`` rows have it.

    Hot keys are broadcast, HOT_KEYS of them at most, so their rows stay where they are; others are shuffled.
    """
    hot = F.col(n) > max(HOT_ROWS, total // HOT_KEYS)
    few, rest = right.where(hot).drop(n), right.where(~hot).drop(n)
    return left.join(F.broadcast(few), on).unionByName(left.join(F.broadcast(few.select(on)), on, "left_anti").join(rest, on))
