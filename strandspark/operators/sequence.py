"""From state paths and run records to sequences: windows, gaps and islands, ordered assembly."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.functions.distributions import discrete_weibull_mean
from strandspark.functions.quality import base, phred

# Factors of run scales and shapes for A, C, G, T.
SCALE_FACTORS, SHAPE_FACTORS = (1.02, 1.04, 1.04, 1.02), (1.0, 1.0, 1.0, 1.0)


def by_position() -> Window:
    return Window.partitionBy("read_id").orderBy("pos")


def change_positions(path: DataFrame) -> DataFrame:
    """Rows of ``path`` (read_id, pos, state, ...) whose state differs from the one before."""
    return path.withColumn("before", F.lag("state").over(by_position())).where("state <> before").drop("before")


def change_counts(path: DataFrame) -> DataFrame:
    """(read_id, changes)."""
    moved = path.withColumn("moved", (F.col("state") != F.lag("state").over(by_position())).cast("int"))
    return moved.groupBy("read_id").agg(F.coalesce(F.sum("moved"), F.lit(0)).alias("changes"))


def in_sequence(key: Column, text: Column) -> Column:
    """Aggregate: texts joined in the order of ``key``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), text.alias("t")))), lambda p: p["t"]), "")


def collapse_repeats(path: DataFrame, n_base: int) -> DataFrame:
    """(read_id, sequence): the first base and each change of state, as letters."""
    first = path.withColumn("before", F.lag("state").over(by_position())).where("before is null or state <> before")
    return first.groupBy("read_id").agg(in_sequence(F.col("pos"), base(F.col("state"), n_base)).alias("sequence"))


def emit_bases(path: DataFrame, n_base: int, edges: bool = False, reverse: bool = False) -> DataFrame:
    """(read_id, basecall, quality) from changes of state; ``q`` is the log probability of the step.

    The first state and the step into the last are emitted only with ``edges``.
    """
    last = Window.partitionBy("read_id")
    moved = path.withColumn("before", F.lag("state").over(by_position())).withColumn("end", F.max("pos").over(last))
    kept = moved.where("before is null or state <> before") if edges else moved.where("state <> before and pos < end")
    called = kept.groupBy("read_id").agg(
        in_sequence(F.col("pos"), base(F.col("state"), n_base)).alias("basecall"),
        in_sequence(F.col("pos"), phred(F.exp(F.coalesce("q", F.lit(0.0))))).alias("quality"),
    )
    if reverse:
        called = called.select("read_id", F.reverse("basecall").alias("basecall"), F.reverse("quality").alias("quality"))
    return called


def emit_runs(path: DataFrame, n_base: int) -> DataFrame:
    """(read_id, run_idx, base, shape, scale, dwell) from (read_id, pos, state, shape, scale): a state below ``n_base`` begins a run, others lengthen it."""
    numbered = path.withColumn("run", F.sum((F.col("state") < n_base).cast("int")).over(by_position())).where("run > 0")
    runs = numbered.groupBy("read_id", "run").agg(
        F.min_by(F.struct("state", "shape", "scale"), "pos").alias("first"), F.count("*").cast("int").alias("dwell")
    )
    return runs.select(
        "read_id", (F.col("run") - 1).cast("int").alias("run_idx"), base(F.col("first.state"), n_base).alias("base"), F.col("first.shape").alias("shape"), F.col("first.scale").alias("scale"), "dwell"
    )


def run_length(scale: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(scale).cast("int"))


def weibull_mode(shape: Column, scale: Column) -> Column:
    """Most likely run length under the run's Weibull distribution, one at least."""
    peak = F.when(shape > 1, scale * F.pow((shape - 1) / shape, 1 / shape)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(1), F.ceil(peak).cast("int"))


def decode_runs(runs: DataFrame, expand: bool = True, mode: str = "floor_scale", scale_factors=SCALE_FACTORS, shape_factors=SHAPE_FACTORS) -> DataFrame:
    """(read_id, sequence) of run records; without ``expand`` one letter a run."""
    def factor(values) -> Column:
        return F.coalesce(F.create_map(*[x for b, v in zip("ACGT", values) for x in (F.lit(b), F.lit(float(v)))])[F.col("base")], F.lit(1.0))

    scale, shape = F.col("scale") * factor(scale_factors), F.col("shape") * factor(shape_factors)
    n = run_length(scale) if mode == "floor_scale" else weibull_mode(shape, scale)
    text = F.repeat("base", n) if expand else F.col("base")
    return runs.groupBy("read_id").agg(in_sequence(F.col("run_idx"), text).alias("sequence"))


def run_mean_lengths(runs: DataFrame, terms: int = 100) -> DataFrame:
    """(read_id, total_length): one and the rounded mean of each run's distribution."""
    n = 1 + F.round(discrete_weibull_mean(F.col("shape"), F.col("scale"), terms))
    return runs.groupBy("read_id").agg(F.sum(n).cast("long").alias("total_length"))


def move_counts(path: DataFrame) -> DataFrame:
    """(read_id, total_length): one for each move, none for a stay (state below 0)."""
    return path.groupBy("read_id").agg(F.sum((F.col("state") >= 0).cast("long")).alias("total_length"))


def compress(sequence: Column) -> tuple[Column, Column]:
    """Letters and lengths of a text's runs of equal characters."""
    both = F.pandas_udf(_compressed, "letters string, lengths array<int>")(sequence)
    return both["letters"], both["lengths"]


def _compressed(texts: pd.Series) -> pd.DataFrame:
    letters, lengths = [], []
    for t in texts:
        code = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        letters.append(None if t is None else code[first].tobytes().decode("utf-32-le", "surrogatepass"))
        lengths.append(None if t is None else np.diff(np.concatenate([first, [len(code)]])).astype(np.int32))
    return pd.DataFrame({"letters": pd.Series(letters, dtype=object), "lengths": pd.Series(lengths, dtype=object)})


def compress_texts(sequences: DataFrame, key: str, text: str) -> DataFrame:
    """(key, letters, lengths) of texts, the lengths joined by commas: one Arrow pass, in which nothing but the two texts is made."""
    kind = sequences.schema[key].dataType.simpleString()

    def run(batches):
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            letters, lengths = [], []
            for t in b.column(1).to_pylist():
                code = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                letters.append(None if t is None else code[first].tobytes().decode("utf-32-le", "surrogatepass"))
                lengths.append(None if t is None else ",".join(map(str, np.diff(np.concatenate([first, [len(code)]])).tolist())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(letters, pa.string()), pa.array(lengths, pa.string())], names=[key, "letters", "lengths"])

    return sequences.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, f"{key} {kind}, letters string, lengths string")


def argmax_path(blocks: DataFrame) -> DataFrame:
    """(read_id, pos, state, score) of each block's largest weight; the last state is blank (-1)."""
    best = F.array_max("w")
    at = (F.array_position("w", best) - 1).cast("int")
    return blocks.select("read_id", F.col("blk").alias("pos"), F.when(at == F.size("w") - 1, -1).otherwise(at).alias("state"), best.alias("score"))


def _cells(blocks: DataFrame) -> DataFrame:
    return blocks.select("read_id", "blk", F.posexplode("w").alias("row", "x"))


def column_extrema(blocks: DataFrame) -> DataFrame:
    """(read_id, row, blk, x): each feature's largest value over a read's blocks and the first block that has it."""
    best = F.max(F.struct("x", (-F.col("blk")).alias("back")))
    return _cells(blocks).groupBy("read_id", "row").agg(best.alias("best")).select("read_id", "row", (-F.col("best.back")).alias("blk"), "best.x")


def matrix_extrema(blocks: DataFrame) -> DataFrame:
    """(read_id, largest, smallest, at_max, at_min): of all a read's values, by place in block order; the first of equal ones."""
    width = F.size("w")
    cells = blocks.select("read_id", "blk", width.alias("n"), F.posexplode("w").alias("row", "x")).withColumn("at", F.col("blk") * F.col("n") + F.col("row"))
    found = cells.groupBy("read_id").agg(F.max(F.struct("x", (-F.col("at")).alias("back"))).alias("high"), F.min(F.struct("x", "at")).alias("low"))
    return found.select("read_id", F.col("high.x").alias("largest"), F.col("low.x").alias("smallest"), (-F.col("high.back")).alias("at_max"), F.col("low.at").alias("at_min"))


def path_basecall(path: DataFrame, n_base: int) -> DataFrame:
    """(read_id, sequence) of (read_id, pos, state, length): a moved-into base as often as its length says, stays (below 0) not at all."""
    text = F.when(F.col("state") >= 0, F.repeat(base(F.col("state"), n_base), F.greatest(F.lit(1), F.col("length").cast("int")))).otherwise("")
    return path.groupBy("read_id").agg(in_sequence(F.col("pos"), text).alias("sequence"))
