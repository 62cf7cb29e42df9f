"""A table function for SQL: the bases that runs stand for, with their places.

``SELECT * FROM expand_runs(TABLE(runs), 1.0)`` takes run records (read_id, run_idx, base, scale, ...) in any order; the
function itself asks Spark for a partition a read and for the order of runs, and holds nothing but a count. A run has
``floor(scale * factor)`` bases, one at least; null bases and scales give none and one. Columns are found by name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from strandspark.session import ship

NEEDED = ("read_id", "run_idx", "base", "scale")


class ExpandRuns:
    @staticmethod
    def analyze(runs: AnalyzeArgument, factor: AnalyzeArgument) -> AnalyzeResult:
        if not runs.isTable:
            raise ValueError("expand_runs takes a table of runs")
        kinds = {f.name: f.dataType for f in runs.dataType.fields}
        if missing := [n for n in NEEDED if n not in kinds]:
            raise ValueError(f"expand_runs needs columns {', '.join(missing)}")
        if factor.value is None or float(factor.value) <= 0:
            raise ValueError("expand_runs takes a positive factor")
        out = T.StructType([T.StructField("read_id", kinds["read_id"]), T.StructField("pos", T.LongType()), T.StructField("run_idx", kinds["run_idx"]), T.StructField("base", T.StringType())])
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn("read_id")], orderBy=[OrderingColumn("run_idx")])

    def __init__(self):
        self.pos = 0

    def eval(self, run, factor) -> Iterator[tuple]:
        if run["base"] is None:
            return
        n = 1 if run["scale"] is None or math.isnan(run["scale"]) else max(1, math.floor(run["scale"] * float(factor)))
        for _ in range(n):
            yield run["read_id"], self.pos, run["run_idx"], run["base"]
            self.pos += 1


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    ship(spark)
    spark.udtf.register("expand_runs", udtf(ExpandRuns))


def expanded(runs: DataFrame, factor: float = 1.0) -> DataFrame:
    """(read_id, pos, run_idx, base) of run records, through the table function."""
    register(runs.sparkSession)
    return runs.sparkSession.sql(f"SELECT * FROM expand_runs(TABLE({{runs}}), {float(factor)!r}D)", runs=runs)
