"""Approximate order statistics that merge: KLL sketches of samples.

A sketch of ``k`` holds a few thousand bytes whatever it has seen, and two of them merge into the sketch of both, so
quantiles of chunks, reads, users and whole tables come from one pass over the samples and one small row a chunk.
``RANK_ERROR`` bounds how far the rank of a returned value may be from the one asked for, with a probability of 99 %
for a single quantile; up to about ``k`` samples a sketch is exact. Nulls and NaN are left out; a group
without other samples has no sketch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.operators.signal import MAD_SCALE

K = 400


def rank_error(k: int = K) -> float:
    """Double-sided normalised rank error of one quantile, as the sketch's authors fitted it."""
    return 2.296 / k**0.9021


def sketch(samples: DataFrame, by: list[str], value: str = "value", k: int = K) -> DataFrame:
    """(by, sketch, n) of each group's samples."""
    rows = samples.where(F.col(value).isNotNull() & ~F.isnan(value))
    made = rows.groupBy(*by).agg(F.kll_sketch_agg_double(value, k).alias("sketch"))
    return made.withColumn("n", F.kll_sketch_get_n_double("sketch"))


def merge(sketches: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """(by, sketch, n) of the sketches of coarser groups; no ``by``: of all."""
    made = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", k).alias("sketch"))
    return made.withColumn("n", F.kll_sketch_get_n_double("sketch"))


def quantile(p: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(p))


def rank(x: Column) -> Column:
    """Share of the samples that are no more than ``x``."""
    return F.kll_sketch_get_rank_double("sketch", x)


def sketched_mad(samples: DataFrame, by: list[str], k: int = K) -> DataFrame:
    """(by, median, mad): one sketch of the values, and one of their distances from its median."""
    medians = sketch(samples, by, k=k).select(*by, quantile(0.5).alias("median"))
    apart = samples.join(medians, by).withColumn("apart", F.abs(F.col("value") - F.col("median")))
    mads = sketch(apart, by, "apart", k).select(*by, (MAD_SCALE * quantile(0.5)).alias("mad"))
    return medians.join(mads, by)


def sketched_normalise(samples: DataFrame, k: int = K) -> DataFrame:
    """(value - median) / MAD as ``signal.normalise`` has it, by sketches; null where the MAD is 0."""
    stats = sketched_mad(samples, ["read_id"], k)
    scaled = F.when(F.col("mad") != 0, (F.col("value") - F.col("median")) / F.col("mad"))
    return samples.join(stats, "read_id").withColumn("value", scaled).drop("median", "mad")
