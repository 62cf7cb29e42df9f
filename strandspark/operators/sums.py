"""Sums that don't depend on the order of addition.

A double is a whole number of units 2**(BITS * bin) for a few bins: the parts of its mantissa that fall in each. Parts
are added as whole numbers, bin by bin, which is exact in any order and partitioning; the bins of a group are put
together as one whole number at the end and rounded once, so the result is the exact sum's nearest double. Partial
sums are tables (by, bin, units, special) that add up like any counts: ``merge_sums`` joins those of separate runs.

Defined results: nulls are left out; a group without values has no row; a NaN, or infinities of both signs, make a sum
NaN, an infinity makes it that infinity; negative zero is zero. A bin holds 2**(63 - BITS) values of a group and more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandspark.session import ship

BITS, _PARTS = 24, 5


def _parts(rows: DataFrame) -> DataFrame:
    """``rows`` with _top and _u0 to _u4: _x is the sum of _uk whole multiples of 2**(BITS * (_top - k)); null for zero and what isn't finite."""
    usable = ~F.isnan("_x") & (F.abs("_x") != F.lit(math.inf)) & (F.col("_x") != 0)
    # one bin above the logarithm's, which may be a little off, down to where 53 bits end
    rows = rows.withColumn("_top", F.when(usable, F.floor(F.log2(F.abs("_x")) / BITS).cast("int") + 1))
    rows = rows.withColumn("_rest", F.when(usable, F.col("_x")))
    for k in range(_PARTS):
        # powers of two are exact; beyond the largest double nothing is that large, and none is finer than the smallest
        rows = rows.withColumn("_unit", F.pow(F.lit(2.0), F.greatest((F.col("_top") - k) * BITS, F.lit(-1074)).cast("double")))
        rows = rows.withColumn(f"_u{k}", (F.col("_rest") / F.col("_unit")).cast("bigint"))
        rows = rows.withColumn("_rest", F.when(F.col(f"_u{k}") == 0, F.col("_rest")).otherwise(F.col("_rest") - F.col(f"_u{k}") * F.col("_unit")))
    return rows


def partial_sums(rows: DataFrame, by: list[str], value: str | Column) -> DataFrame:
    """(by, bin, units, special, n): mergeable sums of ``value``; n counts values, in one row of each group.

    Values of one magnitude have the same bins, so their parts are added side by side and become rows only then.
    """
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    held = _parts(rows.select(*by, x.alias("_x")).where("_x is not null"))
    special = F.when(F.isnan("_x") | (F.abs("_x") == F.lit(math.inf)), F.col("_x"))
    added = held.groupBy(*by, "_top").agg(F.count("*").alias("_n"), F.sum(special).alias("_special"), *[F.sum(f"_u{k}").alias(f"_u{k}") for k in range(_PARTS)])
    row = lambda at, units, special, n: F.struct(at.cast("int").alias("bin"), units.cast("bigint").alias("units"), special.cast("double").alias("special"), n.cast("bigint").alias("n"))
    own = row(F.lit(None), F.lit(0), F.col("_special"), F.col("_n"))
    parts = [row(F.col("_top") - k, F.col(f"_u{k}"), F.lit(None), F.lit(0)) for k in range(_PARTS)]
    return merge_sums(added.select(*by, F.inline(F.array(own, *parts))).where("units <> 0 or n > 0"), by)


def merge_sums(partial: DataFrame, by: list[str]) -> DataFrame:
    """Partial sums of the union of what ``partial``'s rows were made of."""
    return partial.groupBy(*by, "bin").agg(F.sum("units").alias("units"), F.sum("special").alias("special"), F.sum("n").alias("n"))


def whole_sum(bins: list[int], units: list[int]) -> float:
    """The double nearest to the sum of ``units`` in ``bins``."""
    places = [max(b * BITS, -1074) for b in bins]
    low = min(places, default=0)
    exact = sum(u << p - low for p, u in zip(places, units))
    try:  # a quotient of whole numbers is rounded once
        return float(exact << low) if low >= 0 else exact / (1 << -low)
    except OverflowError:
        return math.inf if exact > 0 else -math.inf


def finish_sums(partial: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, n) of partial sums; a group has a row for each of its bins, 90 at most."""
    ship(partial.sparkSession)
    pairs = F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "units")))
    grouped = partial.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("special").alias("special"), pairs.alias("pairs"))
    grouped = grouped.select(*by, "n", "special", F.transform("pairs", lambda p: p["bin"]).alias("bins"), F.transform("pairs", lambda p: p["units"]).alias("units"))
    keys = len(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, special, bins, units = (b.column(keys + k) for k in range(4))
            totals = [s if s is not None else whole_sum(x, u) for s, x, u in zip(special.to_pylist(), bins.to_pylist(), units.to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:keys], pa.array(totals, pa.float64()), n], names=[*b.schema.names[:keys], "total", "n"])

    out = grouped.select(*by, F.lit(0.0).alias("total"), "n")
    return grouped.mapInArrow(run, out.schema)


def exact_sums(rows: DataFrame, by: list[str], value: str | Column) -> DataFrame:
    """(by, total, n): each group's sum, rounded once."""
    return finish_sums(partial_sums(rows, by, value), by)


def studentise_exact(signal: DataFrame) -> DataFrame:
    """(value - mean) / population standard deviation of its read, bit for bit the same under any partitioning; null where that is 0."""
    means = exact_sums(signal, ["read_id"], "value").select("read_id", (F.col("total") / F.col("n")).alias("mean"))
    centred = signal.join(means, "read_id").withColumn("off", F.col("value") - F.col("mean"))
    squares = exact_sums(centred, ["read_id"], F.col("off") * F.col("off")).select("read_id", F.sqrt(F.col("total") / F.col("n")).alias("deviation"))
    return centred.join(squares, "read_id").withColumn("value", F.when(F.col("deviation") != 0, F.col("off") / F.col("deviation"))).drop("mean", "off", "deviation")
