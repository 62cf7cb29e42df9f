"""Connected components of a distributed edge table by alternating large and small stars.

Each round points every node at the smallest neighbour it can see and is written to the shared
folder, so lineage stays short and nothing but one row of counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandspark.session import drop, write_scratch


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.withColumnRenamed("m", "v")).where("u != v").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b of one orderable type); a component is its smallest node.

    Loops and repeated or null-ended edges are ignored; no edges give an empty table.
    """
    spark = edges.sparkSession
    schema = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).schema
    now = edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = write_scratch(now, "edges")
    now = spark.read.schema(schema).parquet(path)
    for _ in range(rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        open_ = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down = 1 and up = 1)")
        if open_.isEmpty():
            break
        before, path = path, write_scratch(_stars(now), "edges")
        now = spark.read.schema(schema).parquet(path)
        drop(spark, before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
