"""Signal operators over long form: one row a sample, (read_id, idx, value).

Order statistics come from exact ``percentile`` aggregates. Per-read results are far fewer than
samples and join back on ``read_id``, the key by which windows are dealt out as well; Catalyst broadcasts
the per-read side where it is small. Trimming needs a read's chunks in order, so it gathers reads into rows first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandspark.session import ship

#: Makes the median absolute deviation consistent with the normal standard deviation.
MAD_SCALE = 1.4826


def in_order() -> Window:
    return Window.partitionBy("read_id").orderBy("idx")


def scale_to_pa(signal: DataFrame, offset: float, range_: float, digitisation: float) -> DataFrame:
    return signal.withColumn("value", (F.col("value") + F.lit(offset)) * F.lit(range_ / digitisation))


def quantiles(signal: DataFrame, at: list[float]) -> DataFrame:
    """One column a quantile (q0, q1, ...), linear between order statistics."""
    found = signal.where(~F.isnan("value")).groupBy("read_id").agg(F.percentile("value", F.array(*map(F.lit, at))).alias("q"))
    return found.select("read_id", *[F.col("q")[k].alias(f"q{k}") for k in range(len(at))])


def median_mad(signal: DataFrame, by: list[str]) -> DataFrame:
    """Median and scaled median absolute deviation of ``value`` for each group."""
    values = signal.where(F.col("value").isNotNull() & ~F.isnan("value")).select(*by, "value")
    median = values.groupBy(*by).agg(F.percentile("value", F.lit(0.5)).alias("median"))
    apart = values.join(median, by).withColumn("apart", F.abs(F.col("value") - F.col("median")))
    return apart.groupBy(*by).agg(F.first("median").alias("median"), (MAD_SCALE * F.percentile("apart", F.lit(0.5))).alias("mad"))


def normalise(signal: DataFrame) -> DataFrame:
    """(value - median) / MAD of its read; null where the MAD is 0, 0 for a read of one sample."""
    stats = median_mad(signal, ["read_id"]).join(signal.groupBy("read_id").agg(F.count("*").alias("n")), "read_id")
    scaled = F.when(F.col("n") == 1, F.lit(0.0)).when(F.col("mad") != 0, (F.col("value") - F.col("median")) / F.col("mad"))
    return signal.join(stats, "read_id").withColumn("value", scaled).drop("median", "mad", "n")


def chunk_mads(signal: DataFrame, chunk: int) -> DataFrame:
    """(read_id, chunk, mad) of whole chunks; a partial last chunk is left out."""
    sizes = signal.groupBy("read_id").agg(F.floor(F.count("*") / chunk).alias("chunks"))
    whole = signal.join(sizes, "read_id").where(F.col("idx") < F.col("chunks") * chunk).withColumn("chunk", F.floor(F.col("idx") / chunk))
    return median_mad(whole, ["read_id", "chunk"]).select("read_id", "chunk", "mad")


def trim_bounds(signal: DataFrame, chunk: int = 100, percent: float = 0.0, head: int = 0, tail: int = 0) -> DataFrame:
    """(read_id, n, start, end, error): the live part after quiet chunks and fixed ends are cut; error says why none is left.

    One shuffle gathers reads, one Arrow pass over them does the rest.
    """
    ship(signal.sparkSession)
    kind = signal.schema["read_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found = []
            for samples in b.column(1):
                x = np.array(samples.values.to_pylist() if samples.values is not None else [], float)
                start, end = live_bounds(x, chunk, percent, head, tail)
                found.append((len(x), start, end, "too_short" if len(x) < chunk else "trimmed_away" if start >= end else None))
            n, start, end, error = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(error, pa.string())], names=["read_id", "n", "start", "end", "error"])

    return to_reads(signal).select("read_id", F.col("signal").cast("array<double>").alias("signal")).mapInArrow(run, f"read_id {kind}, n long, start long, end long, error string")


def trim(signal: DataFrame, chunk: int = 100, percent: float = 0.0, head: int = 200, tail: int = 10) -> DataFrame:
    """The live part's samples, their ``idx`` unchanged; reads without one are dropped."""
    bounds = trim_bounds(signal, chunk, percent, head, tail).where("error is null").select("read_id", "start", "end")
    return signal.join(bounds, "read_id").where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end"))).drop("start", "end")


def difference(signal: DataFrame, last: float = 0.0) -> DataFrame:
    """Next sample minus this one."""
    return signal.withColumn("value", F.coalesce(F.lead("value").over(in_order()) - F.col("value"), F.lit(last)))


def difference_blocks(blocks: DataFrame, last: float = 0.0) -> DataFrame:
    """Next block's features minus this one's, ``last`` for each in the last block: (read_id, blk, w)."""
    ahead = F.lead("w").over(Window.partitionBy("read_id").orderBy("blk"))
    moved = F.zip_with("w", ahead, lambda x, y: y - x)
    return blocks.select("read_id", "blk", F.coalesce(moved, F.transform("w", lambda x: F.lit(last))).alias("w"))


def studentise(signal: DataFrame) -> DataFrame:
    """(value - mean) / population standard deviation of its read."""
    g = Window.partitionBy("read_id")
    return signal.withColumn("value", (F.col("value") - F.avg("value").over(g)) / F.stddev_pop("value").over(g))


def shift_scale(signal: DataFrame, shift: Column, scale: Column) -> DataFrame:
    return signal.withColumn("value", (F.col("value") - shift) / scale)


def clip(signal: DataFrame, limit: float) -> DataFrame:
    return signal.withColumn("value", F.greatest(F.lit(-limit), F.least(F.lit(limit), F.col("value"))))


def replace_large(signal: DataFrame, limit: float, fill: float = 0.0) -> DataFrame:
    return signal.withColumn("value", F.when(F.abs("value") > limit, F.lit(fill)).otherwise(F.col("value")))


def window_stack(signal: DataFrame, width: int, stride: int = 1) -> DataFrame:
    """Every ``stride``-th sample with ``width`` neighbours around it, zero beyond the ends: (read_id, pos, window)."""
    left = (width - 1) // 2
    columns = [F.coalesce((F.lag("value", left - k) if k < left else F.lead("value", k - left)).over(in_order()), F.lit(0.0)) for k in range(width)]
    rows = signal.withColumn("window", F.array(*columns)).where(F.col("idx") % stride == 0)
    return rows.select("read_id", F.floor(F.col("idx") / stride).alias("pos"), "window")


def convolve(signal: DataFrame, taps: list[float], stride: int = 1, bias: float = 0.0) -> DataFrame:
    """Zero-padded one-dimensional filter: (read_id, pos, value)."""
    total = F.lit(bias)
    for k, t in enumerate(taps):
        total = total + F.lit(float(t)) * F.col("window")[k]
    return window_stack(signal, len(taps), stride).select("read_id", "pos", total.alias("value"))


def to_reads(signal: DataFrame) -> DataFrame:
    """One row a read, its samples in an array in order."""
    pairs = F.array_sort(F.collect_list(F.struct("idx", "value")))
    return signal.groupBy("read_id").agg(F.transform(pairs, lambda p: p["value"]).alias("signal"))


def to_samples(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", F.posexplode("signal").alias("idx", "value")).withColumn("idx", F.col("idx").cast("long"))


# the same for one read's samples, where a stage has the whole read anyway


def _mad(x: np.ndarray) -> tuple[float, float]:
    median = float(np.nanmedian(x))
    return median, MAD_SCALE * float(np.nanmedian(np.abs(x - median)))


def live_bounds(x: np.ndarray, chunk: int, percent: float, head: int, tail: int) -> tuple[int, int]:
    """Start and end of what is between the first and the last chunk whose MAD is above the quantile of all, without the ends."""
    n = len(x)
    mads = np.array([_mad(part)[1] for k in range(0, n - chunk + 1, chunk) if not np.isnan(part := x[k : k + chunk]).all()])
    at = np.array([k for k in range(0, n - chunk + 1, chunk) if not np.isnan(x[k : k + chunk]).all()], int)
    loud = at[mads > np.quantile(mads, percent)] if len(mads) else at
    first, last = (int(loud[0]), int(loud[-1]) + chunk) if len(loud) else (0, 0)
    return first + head if n - first > head else n, max(last - tail, 0)


def live_part(x: np.ndarray, chunk: int, percent: float, head: int, tail: int) -> tuple[int, int]:
    """Start and end as ``trim_bounds`` has them; equal where no part is live."""
    start, end = live_bounds(x, chunk, percent, head, tail)
    return (start, end) if len(x) >= chunk and start < end else (0, 0)


def normalised(x: np.ndarray) -> np.ndarray:
    """By median and MAD as ``normalise`` has it; nothing where the MAD is 0."""
    if len(x) < 2:
        return np.zeros(len(x))
    median, mad = _mad(x)
    return (x - median) / mad if mad else np.zeros(0)
