"""Views of the driver's tables that stand in for reads, blocks, paths and runs.

Each view is given twice, as a DataFrame and as SQL, so that queries and their SQL counterparts start
from the same rows. Order keys are unique. A read is one user's events, or READ_BLOCKS vectors in the
order of their ids, so that reads get more and not longer as tables grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _numbered(df: DataFrame, key: str, order: str, name: str) -> DataFrame:
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long"))


def v_signal(spark: SparkSession, sf_dir: str, by: str = "user_id") -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col(by).cast("string").alias("read_id"), "event_id", "value")
    return _numbered(events, "read_id", "event_id", "idx").select("read_id", "idx", "value")


READ_BLOCKS = 50


def v_block(spark: SparkSession, sf_dir: str, width: int = 40, scale: float = 1.0) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / READ_BLOCKS).cast("long").alias("read_id"), "vec_id", F.transform(F.slice("embedding", 1, width), lambda x: x.cast("double") * scale).alias("w"))
    return _numbered(vectors, "read_id", "vec_id", "blk").select("read_id", "blk", "w")


def v_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("read_id"), "event_id", "value")
    rows = _numbered(events, "read_id", "event_id", "pos")
    q = F.when(F.col("pos") > 0, -F.col("value") / 100)
    return rows.select("read_id", "pos", F.pmod(F.floor("value"), F.lit(8)).cast("int").alias("state"), q.alias("q"), (1 + F.col("value") / 100).alias("shape"), (F.col("value") / 50).alias("scale"))


def v_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("read_id"), "event_id", "value")
    rows = _numbered(events, "read_id", "event_id", "run_idx")
    letter = F.substring(F.lit("ACGT"), F.pmod("event_id", F.lit(4)).cast("int") + 1, F.lit(1))
    return rows.select("read_id", "run_idx", letter.alias("base"), (1 + F.col("value") / 100).alias("shape"), (0.1 + F.col("value") / 50).alias("scale"), F.lit(1).alias("dwell"))


def v_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


SIGNAL = "(SELECT user_id::VARCHAR AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, value FROM events)"
PATH = """(SELECT *, CASE WHEN pos > 0 THEN -value / 100 END AS q, 1 + value / 100 AS shape, value / 50 AS scale,
    (((floor(value)::BIGINT % 8) + 8) % 8)::INT AS state
    FROM (SELECT user_id::VARCHAR AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, value FROM events))"""
RUN = """(SELECT user_id::VARCHAR AS read_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS run_idx,
    substr('ACGT', (event_id % 4)::INT + 1, 1) AS base, 1 + value / 100 AS shape, 0.1 + value / 50 AS scale FROM events)"""


def block_sql(width: int = 40, scale: float = 1.0) -> str:
    return f"""(SELECT vec_id // {READ_BLOCKS} AS read_id, row_number() OVER (PARTITION BY vec_id // {READ_BLOCKS} ORDER BY vec_id) - 1 AS blk,
    list_transform(embedding[1:{width}], lambda x: x::DOUBLE * {scale}) AS w FROM embeddings)"""
